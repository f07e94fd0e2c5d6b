"""Neighbourhood kernels over blocks of cells with a halo: one shuffle of the cells, dense arrays in each task.

Cells are sent to their block and to those whose halo they are in; mirrored edges are taken from the block itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.model import GridSpec
from groundswell.session import importable


def mirror_half(i: np.ndarray, n: int) -> np.ndarray:
    """Half-sample mirror, repeated: -1 is 0, n is n - 1."""
    i = np.mod(i, 2 * n)
    return np.where(i < n, i, 2 * n - 1 - i)


def blockwise(cells: DataFrame, grid: GridSpec, halo: tuple[int, int], kernel: Callable[[np.ndarray, int, int], np.ndarray], edge: str = "none", missing: float | None = None, block: int = 112) -> DataFrame:
    """Run ``kernel(array with halo, first row, first column)`` on each block; its result's cells that aren't nan come out.

    ``halo``: cells before and after in both axes. ``edge``: what lies beyond the grid is none (nan) or mirror_half. ``missing``: the
    value of cells without a row, in all blocks of the grid; else nan, in blocks that hold or adjoin cells.
    """
    importable(cells.sparkSession)
    before, after = halo
    height, width = grid.height, grid.width
    if edge == "mirror_half" and max(before, after) > block:
        raise ValueError("a halo longer than a block")
    last_r, last_c = max(0, (height - 1) // block), max(0, (width - 1) // block)
    if height % block and 0 < height % block < max(before, after):
        last_r = max(0, last_r - 1)  # a thin rest joins the block before, so that mirrored cells are its own
    if width % block and 0 < width % block < max(before, after):
        last_c = max(0, last_c - 1)
    place = lambda i, last: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(i / block))).cast("int")
    span = lambda i, last: F.sequence(place(F.col(i) - after, last), place(F.col(i) + before, last))
    rows = cells.select("row", "col", F.col("value").cast("double").alias("value")).where(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1))
    if missing is not None:  # every block exists
        spots = cells.sparkSession.range((last_r + 1) * (last_c + 1))
        rows = rows.unionByName(spots.select(F.expr(f"cast(id div {last_c + 1} * {block} as int)").alias("row"), F.expr(f"cast(id % {last_c + 1} * {block} as int)").alias("col"), F.lit(None).cast("double").alias("value")))
    dealt = rows.withColumn("br", F.explode(span("row", last_r))).withColumn("bc", F.explode(span("col", last_c)))

    def run(key, table):
        br, bc = key[0].as_py(), key[1].as_py()
        top, left = br * block, bc * block
        bottom, right = height if br == last_r else top + block, width if bc == last_c else left + block
        n, m = bottom - top, right - left
        a = np.full((n + before + after, m + before + after), np.nan)
        r, c, v = (table[x].to_numpy() for x in ("row", "col", "value"))
        got = ~np.isnan(v)
        a[r[got] - top + before, c[got] - left + before] = v[got]
        if missing is not None:
            a = np.where(np.isnan(a), missing, a)
        if edge == "mirror_half":
            rows_ = mirror_half(np.arange(top - before, bottom + after), height) - top + before
            cols_ = mirror_half(np.arange(left - before, right + after), width) - left + before
            a = a[np.ix_(rows_, cols_)]
        else:
            for axis, (first, size, total) in enumerate(((top, n, height), (left, m, width))):
                out = np.arange(first - before, first + size + after)
                cut = (out < 0) | (out >= total)
                a[(cut, slice(None)) if axis == 0 else (slice(None), cut)] = np.nan
        made = kernel(a, top, left)
        i, j = np.nonzero(~np.isnan(made))
        return pa.table({"row": pa.array(i + top, pa.int32()), "col": pa.array(j + left, pa.int32()), "value": pa.array(made[i, j], pa.float64())})

    return dealt.groupBy("br", "bc").applyInArrow(run, "row int, col int, value double")
