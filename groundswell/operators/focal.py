"""Focal statistics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from groundswell.model import FOCAL_SIZE, GridSpec
from groundswell.operators.blocks import blockwise


def focal(cells: DataFrame, grid: GridSpec, size: int = FOCAL_SIZE, stat: str = "upper_median", missing: float = 0.0, block: int = 112) -> DataFrame:
    """(row, col, value) of every cell: the ``size`` x ``size`` neighbourhood's statistic, half-sample mirror at the edges.

    An even size reaches size / 2 before and size / 2 - 1 after. The upper median is place size^2 // 2 from 0 in order. Cells without a
    value count as ``missing``.
    """
    before, after = size // 2, size - size // 2 - 1
    pick = {"upper_median": lambda w: np.partition(w, size * size // 2, axis=-1)[..., size * size // 2], "mean": lambda w: w.mean(axis=-1), "min": lambda w: w.min(axis=-1), "max": lambda w: w.max(axis=-1)}[stat]

    def kernel(a: np.ndarray, top: int, left: int) -> np.ndarray:
        windows = np.lib.stride_tricks.sliding_window_view(a, (size, size))
        out = np.empty(windows.shape[:2])
        for r in range(0, len(out), 16):  # a few rows of windows are dense at once
            part = windows[r : r + 16]
            out[r : r + 16] = pick(part.reshape(*part.shape[:2], -1))
        return out

    return blockwise(cells, grid, (before, after), kernel, edge="mirror_half", missing=missing, block=block)
