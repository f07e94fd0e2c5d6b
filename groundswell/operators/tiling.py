"""Overlapping tiles: plan, padding, augmentation, weights, model calls, weighted blending.

A scene is cut into blocks (arrays, not pixels), which is the only shuffle of pixels. Tiles that lie side by side, of every augmentation, are a
group, and a block goes once to each group that has a part of it: padding, turns and flips are index arithmetic in the group's task. There
the model runs on batches of tiles, each tile once, and predictions, turned back, are summed by weight. A block that only one group gives
is done then; else its sums go on, to be added by block. Weights aren't sent, they follow from the plan of the tiles.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.functions import flipped, rotated, unrotated
from groundswell.model import BLEND_EPS, STRIDE, TILE, GridSpec
from groundswell.operators.predict import caller
from groundswell.session import importable

AUGMENTATIONS = ["identity", "rot90", "flipud"]
GROUP, GROUP_CELLS = 4, 448  # a group is so many tiles along a side, or as many as begin within so many cells


def starts(size: int, tile: int = TILE, stride: int = STRIDE, drop_border: int = 0, strict: bool = False) -> list[int]:
    """First cells of the tiles along an axis: at least one, unless ``strict``, where a side of a stride or less is an error."""
    out = tile - 2 * drop_border
    made = list(range(0, (math.ceil(size / stride) + 1) * stride - out, stride))
    if not made and strict:
        raise ValueError(f"a side of {size} cells has no tile")
    return made or [0]


def padding(size: int, tile: int = TILE, stride: int = STRIDE, drop_border: int = 0) -> int:
    """Cells added after the end, mirrored; the last tile then ends there."""
    return max(0, starts(size, tile, stride, drop_border)[-1] + tile - size - drop_border)


def tile_grid(spark: SparkSession, height: int, width: int, tile: int = TILE, stride: int = STRIDE, drop_border: int = 0) -> DataFrame:
    """(ty, tx, y0, x0) in rows, then columns."""
    ny, nx = len(starts(height, tile, stride, drop_border)), len(starts(width, tile, stride, drop_border))
    n = spark.range(ny * nx)
    ty, tx = F.expr(f"cast(id div {nx} as int)"), (F.col("id") % nx).cast("int")
    return n.select(ty.alias("ty"), tx.alias("tx"), (ty * stride).cast("int").alias("y0"), (tx * stride).cast("int").alias("x0"))


def weights_array(n: int) -> np.ndarray:
    """Weights that fall from the centre to the edges, with mean 1."""
    i = np.arange(n) + 0.5
    edge = np.sqrt(np.minimum(i**2, (i - n) ** 2) + 0.25)
    d_edge = np.minimum(edge[:, None], edge[None, :])
    d_centre = np.sqrt((i[:, None] - n / 2) ** 2 + (i[None, :] - n / 2) ** 2)
    part = d_edge / (d_centre + d_edge)
    return part * (n * n / part.sum())


def pyramid_weights(spark: SparkSession, n: int = TILE) -> DataFrame:
    """(i, j, w) as columns over a range."""
    ids = spark.range(n * n).select(F.expr(f"cast(id div {n} as int)").alias("i"), (F.col("id") % n).cast("int").alias("j"))
    y, x = F.col("i") + F.lit(0.5), F.col("j") + F.lit(0.5)
    side = lambda v: F.sqrt(F.least(v * v, (v - n) * (v - n)) + 0.25)
    centre = F.sqrt((y - n / 2) * (y - n / 2) + (x - n / 2) * (x - n / 2))
    edge = F.least(side(y), side(x))
    part = ids.withColumn("part", edge / (centre + edge))
    total = part.agg(F.sum("part")).first()[0]
    return part.select("i", "j", (F.col("part") * (n * n / total)).alias("w"))


def tile_assign(cells: DataFrame, height: int, width: int, tile: int = TILE, stride: int = STRIDE, drop_border: int = 0) -> DataFrame:
    """Cells with ty, tx, i, j of every tile they belong to."""
    for axis, size, t, o in (("row", height, "ty", "i"), ("col", width, "tx", "j")):
        last = len(starts(size, tile, stride, drop_border)) - 1
        low = F.greatest(F.lit(0), F.expr(f"cast(floor(({axis} - {tile}) / {stride}) + 1 as int)"))
        cells = cells.withColumn("_a", low).withColumn("_b", F.least(F.lit(last), F.expr(f"cast({axis} div {stride} as int)"))).where("_a <= _b")
        cells = cells.withColumn(t, F.explode(F.sequence("_a", "_b"))).drop("_a", "_b").withColumn(o, (F.col(axis) - F.col(t) * stride).cast("int"))
    return cells


def reflect_pad(cells: DataFrame, height: int, width: int, tile: int = TILE, stride: int = STRIDE, drop_border: int = 0) -> DataFrame:
    """Cells of the padded raster: mirrored after the end without repeating the edge (and before the start by ``drop_border``)."""
    for axis, size in (("row", height), ("col", width)):
        after, before = padding(size, tile, stride, drop_border), drop_border
        if max(after, before) >= size:
            raise ValueError(f"a side of {size} cells can't be mirrored over {max(after, before)}")
        own = F.col(axis)
        copies = F.array(own, F.when((size - 1 - own).between(1, after), 2 * (size - 1) - own), F.when(own.between(1, before), -own))
        cells = cells.withColumn(axis, F.explode(F.filter(copies, lambda c: c.isNotNull()))).withColumn(axis, F.col(axis).cast("int"))
    return cells


def augment(cells: DataFrame, op: str, height: int, width: int) -> DataFrame:
    turn = {"identity": (F.col("row"), F.col("col")), "rot90": rotated(F.col("row"), F.col("col"), width), "flipud": flipped(F.col("row"), F.col("col"), height)}[op]
    return cells.withColumns({"row": turn[0].cast("int"), "col": turn[1].cast("int")})


def deaugment(cells: DataFrame, op: str, height: int, width: int) -> DataFrame:
    """Back to the scene of ``height`` x ``width``."""
    turn = {"identity": (F.col("row"), F.col("col")), "rot90": unrotated(F.col("row"), F.col("col"), width), "flipud": flipped(F.col("row"), F.col("col"), height)}[op]
    return cells.withColumns({"row": turn[0].cast("int"), "col": turn[1].cast("int")})


def drop_borders(cells: DataFrame, tile: int, border: int, i: str = "i", j: str = "j") -> DataFrame:
    inside = lambda c: F.col(c).between(border, tile - border - 1)
    return cells.where(inside(i) & inside(j))


def data_window(cells: DataFrame, value: str, nodata: float, inclusive: bool = True) -> tuple[int, int, int, int] | None:
    """(first row, past the last, first column, past the last) of the cells with data; the reference's ends stop one before."""
    r = cells.where(F.col(value).isNotNull() & (F.col(value) != nodata)).agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if r[0] is None:
        return None
    more = 1 if inclusive else 0
    return r[0], r[1] + more, r[2], r[3] + more


def blend(tiles: DataFrame, weights: DataFrame, stride: int = STRIDE, eps: float = BLEND_EPS, drop_border: int = 0) -> DataFrame:
    """(row, col, value) from predictions (ty, tx, i, j, value): weighted sums over overlaps, in row form."""
    met = tiles.join(F.broadcast(weights), ["i", "j"])  # tile^2 rows
    where = [(F.col(t) * stride + F.col(o)).cast("int").alias(n) for t, o, n in (("ty", "i", "row"), ("tx", "j", "col"))]
    return met.groupBy(*where).agg((F.sum(F.col("value") * F.col("w")) / (F.sum("w") + eps)).alias("value"))


def segment(wide: DataFrame, grid: GridSpec, model: Callable | bytes, bands: list[str], tile: int = TILE, stride: int = STRIDE, augmentation: bool = True, drop_border: int = 0, nodata: float | None = None, inclusive_window: bool = True, batch_size: int = 1, providers: list[str] | None = None) -> tuple[DataFrame | None, dict]:
    """(row, col, p) and a run record (prediction present, seconds to plan, data window).

    Missing values go to the model as 0. ``model``: ONNX bytes, or a function from (N, bands, tile, tile) to (N, 1, out, out).
    """
    began = time.time()
    importable(wide.sparkSession)
    height, width, r0, c0 = grid.height, grid.width, 0, 0
    window = None
    if nodata is not None:
        window = data_window(wide, bands[0], nodata, inclusive_window)
        if window is None:
            return None, {"prediction": False, "time": time.time() - began, "nodata_region": None}
        r0, c0, height, width = window[0], window[2], window[1] - window[0], window[3] - window[2]
        wide = wide.where(F.col("row").between(r0, window[1] - 1) & F.col("col").between(c0, window[3] - 1)).withColumns({"row": F.col("row") - r0, "col": F.col("col") - c0})
    out = tile - 2 * drop_border
    ops = AUGMENTATIONS if augmentation else AUGMENTATIONS[:1]
    for size in (height, width):
        if max(padding(size, tile, stride, drop_border), drop_border) >= size:
            raise ValueError(f"a side of {size} cells can't be mirrored over {max(padding(size, tile, stride, drop_border), drop_border)}")
    scene = _predicted(wide, ops, height, width, bands, tile, stride, drop_border, caller(model, batch_size, providers), batch_size)
    if window is not None:  # zeros around the window
        moved = scene.withColumns({"row": F.col("row") + r0, "col": F.col("col") + c0})
        scene = grid.all_cells(wide.sparkSession).join(moved, ["row", "col"], "left").withColumn("p", F.coalesce("p", F.lit(0.0).cast("float")))
    return scene, {"prediction": True, "time": time.time() - began, "nodata_region": window, "out": out}


class _Axis:
    """One axis of an augmented scene: its tiles, and where their cells come from."""

    def __init__(self, size: int, tile: int, stride: int, border: int):
        self.size, self.tile, self.stride, self.border = size, tile, stride, border
        self.tiles = len(starts(size, tile, stride, border))
        self.after = padding(size, tile, stride, border)

    def sources(self, t: int) -> np.ndarray:
        """The scene's index of each cell of a tile; beyond the ends mirrored without repeating the edge."""
        a = np.abs(np.arange(self.tile) + t * self.stride - self.border)
        return np.where(a >= self.size, 2 * (self.size - 1) - a, a)


class _Side:
    """One side of a scene: the tiles of each augmentation as they lie on it, and the groups and blocks they belong to."""

    def __init__(self, number: int, side: int, span: int, tiles: list[tuple[np.ndarray, int, int]]):
        # Of each tile: the scene's index of each of its cells, the first cell it gives, and how many.
        self.cells = [t[0] for t in tiles]
        self.first, self.size = [t[1] for t in tiles], [t[2] for t in tiles]
        self.group = [int(c.min()) // span for c in self.cells]
        self.of: dict[int, list[int]] = {}
        self.over: list[list[int]] = [[] for _ in range(number)]  # tiles that give cells of a block
        self.needed: list[set[int]] = [set() for _ in range(number)]  # groups that take a block
        self.given: list[set[int]] = [set() for _ in range(number)]  # groups that give cells of it
        for t, c in enumerate(self.cells):
            self.of.setdefault(self.group[t], []).append(t)
            for b in range(int(c.min()) // side, int(c.max()) // side + 1):
                self.needed[b].add(self.group[t])
            if self.size[t]:
                for b in range(self.first[t] // side, (self.first[t] + self.size[t] - 1) // side + 1):
                    self.over[b].append(t)
                    self.given[b].add(self.group[t])


def _sides(op: str, height: int, width: int, tile: int, stride: int, border: int, side: int, span: int) -> tuple[_Side, _Side]:
    """A scene's rows and columns under an augmentation; a turn makes rows of columns."""

    def one(size: int, turned: bool) -> _Side:
        axis, tiles = _Axis(size, tile, stride, border), []
        for t in range(axis.tiles):
            cells, first = axis.sources(t), t * stride
            number = max(0, min(tile - 2 * border, size - first))
            tiles.append((size - 1 - cells, size - first - number, number) if turned else (cells, first, number))
        return _Side(-(-size // side), side, span, tiles)

    return one(height, op == "flipud"), one(width, op == "rot90")


def _predicted(wide: DataFrame, ops: list[str], height: int, width: int, bands: list[str], tile: int, stride: int, border: int, call: Callable, batch: int) -> DataFrame:
    """(row, col, p) of a scene: blocks to groups of neighbouring tiles, the model, blocks back."""
    side = math.gcd(stride, tile)
    out = tile - 2 * border
    inner = weights_array(out)
    span = max(GROUP, GROUP_CELLS // stride) * stride
    sides = [_sides(op, height, width, tile, stride, border, side, span) for op in ops]
    needed, given = ([[set().union(*(getattr(s[k], name)[b] for s in sides)) for b in range(len(sides[0][k].over))] for k in (0, 1)] for name in ("needed", "given"))

    def to_scene(p: np.ndarray, op: str) -> np.ndarray:
        """A tile's array, turned back to how it lies in the scene."""
        return p.T[:, ::-1] if op == "rot90" else p[::-1] if op == "flipud" else p

    def cut(a: np.ndarray, op: str, down: int, across: int) -> np.ndarray:
        """Of a tile that has been turned back the cells within the scene: tiles begin within it and may end beyond."""
        a = a[out - down :] if op == "flipud" else a[:down]
        return a[:, out - across :] if op == "rot90" else a[:, :across]

    def mean(up: np.ndarray, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mean over augmentations, and where there is one."""
        number = (under != 0).sum(axis=0)
        total = np.where(under != 0, up / (under + BLEND_EPS), 0).sum(axis=0)
        return total / np.maximum(number, 1), number > 0

    def weights_of(y: int, x: int) -> np.ndarray:
        """The sum of a block's weights for each augmentation, of all tiles."""
        under = np.zeros((len(ops), side, side))
        for k, (op, (rows, cols)) in enumerate(zip(ops, sides)):
            turned = to_scene(inner, op)
            for i in rows.over[y]:
                for j in cols.over[x]:
                    _add(under[k], cut(turned, op, rows.size[i], cols.size[j]), rows.first[i] - y * side, cols.first[j] - x * side)
        return under

    def to_block(key, table):
        a = np.zeros((len(bands), side, side), np.float32)
        r, c = table["row"].to_numpy() % side, table["col"].to_numpy() % side
        for k, b in enumerate(bands):
            a[k, r, c] = np.nan_to_num(table[b].to_numpy().astype(np.float64))
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([a.tobytes()], pa.binary())], names=["by", "bx", "data"])

    def spread(batches):
        """A row for each group of tiles that needs a block."""
        for part in batches:
            for k, (y, x) in enumerate(zip(part.column("by").to_pylist(), part.column("bx").to_pylist())):
                to = [(gy, gx) for gy in sorted(needed[0][y]) for gx in sorted(needed[1][x])]
                if to:
                    n = pa.array(np.zeros(len(to), np.int64))
                    yield pa.RecordBatch.from_arrays([*(pa.array([t[j] for t in to], pa.int32()) for j in (0, 1)), *(part.column(c).slice(k, 1).take(n) for c in ("by", "bx", "data"))], names=["gy", "gx", "by", "bx", "data"])

    def to_sums(key, table):
        """The weighted sums of a group's tiles by block, or what comes of them where no other group adds to the block."""
        gy, gx = (k.as_py() for k in key)
        by, bx = table["by"].to_pylist(), table["bx"].to_pylist()
        ends = [[cell for s in sides for t in s[k].of.get(g, []) for cell in (int(s[k].cells[t].min()), int(s[k].cells[t].max()))] for k, g in ((0, gy), (1, gx))]
        (y0, y1), (x0, x1) = ((min(e) // side, max(e) // side + 1) for e in ends)
        region = np.zeros((len(bands), (y1 - y0) * side, (x1 - x0) * side), np.float32)
        for y, x, d in zip(by, bx, table["data"]):
            if y0 <= y < y1 and x0 <= x < x1:
                region[:, (y - y0) * side : (y - y0 + 1) * side, (x - x0) * side : (x - x0 + 1) * side] = np.frombuffer(d.as_buffer(), np.float32).reshape(len(bands), side, side)
        up, touched = np.zeros((len(ops), *region.shape[1:])), np.zeros((y1 - y0, x1 - x0), bool)
        for k, (op, (rows, cols)) in enumerate(zip(ops, sides)):
            tiles = [(i, j) for i in rows.of.get(gy, []) for j in cols.of.get(gx, []) if rows.size[i] and cols.size[j]]
            for n in range(0, len(tiles), max(1, batch)):
                some = tiles[n : n + max(1, batch)]
                a = np.zeros((len(some), len(bands), tile, tile), np.float32)
                for m, (i, j) in enumerate(some):
                    seen = region[:, rows.cells[i] - y0 * side][:, :, cols.cells[j] - x0 * side]
                    a[m] = seen.transpose(0, 2, 1) if op == "rot90" else seen
                p = np.asarray(call(a), np.float64)[:, 0]
                if p.shape[1] != out:  # a model without borders gives its whole tile
                    p = p[:, border : tile - border, border : tile - border]
                for (i, j), q in zip(some, p):
                    y, x = rows.first[i] - y0 * side, cols.first[j] - x0 * side
                    _add(up[k], cut(to_scene(q * inner, op), op, rows.size[i], cols.size[j]), y, x)
                    touched[y // side : (y + rows.size[i] - 1) // side + 1, x // side : (x + cols.size[j] - 1) // side + 1] = True
        made = []
        for y, x in zip(*np.nonzero(touched)):
            own = up[:, y * side : (y + 1) * side, x * side : (x + 1) * side]
            y, x = int(y) + y0, int(x) + x0
            alone = len(given[0][y]) == 1 and len(given[1][x]) == 1
            if alone:
                v, there = mean(own, weights_of(y, x))
                own = np.where(there, v, np.nan).astype(np.float32)
            made.append((gy, gx, y, x, alone, np.ascontiguousarray(own).tobytes()))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[j] for r in made], k) for j, k in enumerate(kinds)], names=["gy", "gx", "by", "bx", "alone", "data"])

    def add(key, table):
        y, x = (k.as_py() for k in key)
        rows = sorted(zip(*(table[c].to_pylist() for c in ("gy", "gx", "alone", "data"))))
        if rows[0][2]:
            v = np.frombuffer(rows[0][3], np.float32).reshape(side, side)
            there = ~np.isnan(v)
            if not there.all():  # a prediction that is nan is one, a cell without tiles isn't
                there = mean(np.zeros((len(ops), side, side)), weights_of(y, x))[1]
        else:
            up = sum(np.frombuffer(d, np.float64).reshape(len(ops), side, side) for *_, d in rows)
            v, there = mean(up, weights_of(y, x))
        row, col = np.nonzero(there)
        return pa.table({"row": pa.array(row + y * side, pa.int32()), "col": pa.array(col + x * side, pa.int32()), "p": pa.array(v[row, col].astype(np.float32))})

    place = [F.expr(f"cast({c} div {side} as int)").alias(n) for c, n in (("row", "by"), ("col", "bx"))]
    blocks = wide.select("row", "col", *bands, *place).groupBy("by", "bx").applyInArrow(to_block, "by int, bx int, data binary")
    dealt = blocks.mapInArrow(spread, "gy int, gx int, by int, bx int, data binary")
    groups = sorted({(gy, gx) for rows, cols in sides for gy in rows.of for gx in cols.of})
    every = wide.sparkSession.createDataFrame([(gy, gx, -1, -1, b"") for gy, gx in groups], dealt.schema)  # groups without any data are predicted too
    sums = dealt.unionByName(every).groupBy("gy", "gx").applyInArrow(to_sums, "gy int, gx int, by int, bx int, alone boolean, data binary")
    return sums.groupBy("by", "bx").applyInArrow(add, "row int, col int, p float")


def _add(to: np.ndarray, part: np.ndarray, y: int, x: int) -> None:
    """Add an array at a place that may lie partly beyond the other's ends."""
    y0, x0, y1, x1 = max(0, y), max(0, x), min(to.shape[0], y + part.shape[0]), min(to.shape[1], x + part.shape[1])
    if y0 < y1 and x0 < x1:
        to[y0:y1, x0:x1] += part[y0 - y : y1 - y, x0 - x : x1 - x]
