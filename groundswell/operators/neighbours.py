"""Nearest neighbours by block and verify, height above ground, and statistical outliers.

1. Points go to square blocks, build points also to the blocks within a halo of them: one shuffle, of packed columns (``_deal``) and not of
   rows. Within a task points are sorted by cells, in all axes; a probe looks at the cells around its own, and those whose k-th neighbour
   is farther than a cell's edge look again with cells twice as wide, up to the halo. So the cost a probe follows k, not the block.
2. A probe with fewer than k in the halo (a stray point, a sparse place) descends a pyramid of occupied cells, each with its
   count and the box of its points: at each level the cells stay that are no farther than the least distance within which cells hold
   more than k points, nor than the k-th of the points its block knew. Only the points of the last cells are fetched.

Neighbours are more than the cloud itself, so they are not kept between jobs: what is said of each point (its mean distance, its ground) is
made where they are found, and columns of the point go along in place of a join; ``nearest`` searches twice for k over 1. A block's edge
follows the occupied area, not the extent: it is narrowed until occupied blocks hold ``PER_BLOCK`` points or so on average. The
pyramid's top has at most ``TOP`` cells, which travel with the tasks. No probe is left out, and a point's neighbours are exact.
"""

from __future__ import annotations

import functools
import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundswell.model import GROUND_CLASS, NOISE_CLASS, OUTLIER_K, OUTLIER_MULTIPLIER, require
from groundswell.session import free_shuffles, importable, written

PER_BLOCK = 1 << 15
HALO = 8  # halos are a block's edge by this
AT_ONCE = 1 << 19  # rows that a task packs at once
CELLS_AT_ONCE = 1 << 18
BOUND_AT_ONCE = 1 << 24
FINE = 8  # cells of the pyramid's foot along a block's edge
TOP = 4096
LARGE = 1 << 20  # points from which shuffle files are let go of between jobs
FEW_CELLS = 1 << 20  # cells that may be broadcast
NUMBERS = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_()}
HEADER = struct.Struct("<BBq")
ASCENDING, WHOLE = 8, {"f": 16, "d": 32}  # how numbers are packed, beside their kind


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All of start, start + 1, ... for each start, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _plain(column) -> tuple[np.ndarray, np.ndarray | None]:
    """A column of numbers as int64 or as floats, and which of them are there if not all are."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    known = column.is_valid().to_numpy(zero_copy_only=False) if column.null_count else None
    if pa.types.is_boolean(column.type):
        column = column.cast(pa.int8())
    values = (column.fill_null(0) if known is not None else column).to_numpy(zero_copy_only=False)
    return values if values.dtype.kind == "f" else values.astype(np.int64), known


def _pack(values: np.ndarray, known: np.ndarray | None) -> bytes:
    """Integers as differences from the least (of ascending ones: from the one before), as narrow as they come, whole floats like integers;
    a byte each for which are there, if any isn't. Bytes of one place lie together, compressed."""
    base, how = 0, 0
    if values.dtype.kind == "f" and _is_whole(values):
        values, how = values.astype(np.int64), WHOLE[values.dtype.char]
    if values.dtype.kind == "i":
        base = int(values.min())
        if len(values) > 1 and values[0] == base and (values[1:] >= values[:-1]).all():
            over, how = np.diff(values, prepend=base).view(np.uint64), how | ASCENDING
        else:
            over = values.view(np.uint64) - np.array([base]).view(np.uint64)[0]
        values = over.astype(np.min_scalar_type(over.max()))
    mask = b"" if known is None or known.all() else known.tobytes()
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return HEADER.pack("BHILQfd".index(values.dtype.char) | how, len(mask) > 0, base) + pa.compress(planes + mask, "zstd", asbytes=True)


def _is_whole(values: np.ndarray) -> bool:
    """Whether floats are integers that come back as they were: no fraction, no -0.0, none too large, nan or infinite."""
    with np.errstate(invalid="ignore"):
        return bool((np.abs(values) <= 1 << 53).all() and (values == np.floor(values)).all() and not np.signbit(values[values == 0]).any())


def _unpack(packed: bytes, number: int) -> tuple[np.ndarray, np.ndarray | None]:
    how, masked, base = HEADER.unpack_from(packed)
    kind = np.dtype("BHILQfd"[how & 7])
    size = number * kind.itemsize
    body = pa.decompress(memoryview(packed)[HEADER.size :], size + number * masked, "zstd", asbytes=True)
    values = np.ascontiguousarray(np.frombuffer(body, np.uint8, size).reshape(kind.itemsize, number).T).view(kind).ravel()
    if kind.kind == "u":
        over = values.astype(np.uint64)
        over = np.cumsum(over, dtype=np.uint64) if how & ASCENDING else over
        values = (over + np.array([base]).view(np.uint64)[0]).view(np.int64)
    for char, bit in WHOLE.items():
        values = values.astype(char) if how & bit else values
    return values, np.frombuffer(body, bool, number, size) if masked else None


def _deal(columns: list[str], slim: int, dims: list[str], edge, halo, role: int):
    """Rows to packed columns by block. ``role``: 1 probes, 2 build points, 3 both; build points go to all blocks within ``halo``.

    Copies in blocks other than their own have the first ``slim`` columns only.
    """

    def run(batches):
        held, number = [], 0
        for batch in batches:
            held.append(batch)
            number += batch.num_rows
            if number >= AT_ONCE:
                yield from out(pa.Table.from_batches(held))
                held, number = [], 0
        if number:
            yield from out(pa.Table.from_batches(held))

    def out(table):
        cols = [_plain(table[c]) for c in columns]
        at = [_plain(table[d])[0] for d in dims[:2]]
        own = [np.floor(x / edge).astype(np.int64) for x in at]
        parts = [(np.arange(len(own[0])), own[0], own[1], role)]
        if role & 2 and halo:
            spans = [(np.floor((x - halo) / edge).astype(np.int64), np.floor((x + halo) / edge).astype(np.int64)) for x in at]
            for i in (0, 1):
                for j in (0, 1):
                    x, y = spans[0][0] + i, spans[1][0] + j
                    there = np.flatnonzero((x <= spans[0][1]) & (y <= spans[1][1]) & ((x != own[0]) | (y != own[1])))
                    parts.append((there, x[there], y[there], 2))
        made: list[tuple] = []
        for rows, bx, by, kind in parts:
            order = np.lexsort((cols[0][0][rows], by, bx))  # by id within a block: differences are small
            rows, bx, by = rows[order], bx[order], by[order]
            cuts = np.flatnonzero(np.diff(bx, prepend=bx[:1] - 1).astype(bool) | np.diff(by, prepend=by[:1] - 1).astype(bool))
            mine = [(v[rows], None if m is None else m[rows]) for v, m in (cols if kind == role else cols[:slim])]
            for a, b in zip(cuts, [*cuts[1:], len(rows)]):
                made.append((bx[a], by[a], kind, b - a, [_pack(v[a:b], None if m is None else m[a:b]) for v, m in mine]))
        for a in range(0, len(made), 1024):
            bx, by, kind, n, packed = zip(*made[a : a + 1024])
            yield pa.RecordBatch.from_arrays([pa.array(bx, pa.int64()), pa.array(by, pa.int64()), pa.array(kind, pa.int32()), pa.array(n, pa.int32()), pa.array(packed, pa.list_(pa.binary()))], names=["bx", "by", "role", "n", "packed"])

    return run


DEALT = "bx long, by long, role int, n int, packed array<binary>"


def _columns(table, roles: tuple[int, ...], number: int) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """The first ``number`` columns of a block's rows of some roles."""
    kinds, sizes, packed = (table[c].to_pylist() for c in ("role", "n", "packed"))
    picked = [(n, p) for r, n, p in zip(kinds, sizes, packed) if r in roles]
    out = []
    for j in range(number):
        parts = [_unpack(p[j], n) for n, p in picked]
        values = np.concatenate([v for v, _ in parts]) if parts else np.empty(0, np.int64)
        known = np.concatenate([np.ones(len(v), bool) if m is None else m for v, m in parts]) if any(m is not None for _, m in parts) else None
        out.append((values, known))
    return out


def _close(cells: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers of cells with gaps closed: neighbours stay neighbours, others stay apart."""
    every = np.unique(np.concatenate(cells))
    closed = np.cumsum(np.minimum(np.diff(every, prepend=every[:1]), 2)) + 1
    return [closed[np.searchsorted(every, c)] for c in cells]


def _search(k: int, kind: type, halo, p: np.ndarray, pid: np.ndarray, q: np.ndarray, qid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Neighbours within a block: probe's row, rank, d2, row of the near one, for probes that have k within the halo; the rows of the others."""
    far = np.iinfo(np.int64).max if kind is np.int64 else np.inf
    found: list[tuple] = []
    left = todo = np.arange(len(pid))
    if not len(qid):
        todo = todo[:0]
    if len(todo):
        low = np.minimum(p.min(axis=0), q.min(axis=0))
        span = np.ptp(q[:, :2], axis=0).astype(float)
        reach = max(math.sqrt(max(span[0], 1.0e-9) * max(span[1], 1.0e-9) * max(1, k / 3) / len(qid)), float(halo) / 64)
    around = np.stack(np.meshgrid(*[(-1, 0, 1)] * (p.shape[1] - 1), indexing="ij"), axis=-1).reshape(-1, p.shape[1] - 1)
    while len(todo):
        wide = kind(math.ceil(reach) if kind is np.int64 else reach)
        last = wide >= halo
        wide = halo if last else wide
        at_p, at_q = ([np.floor((x[:, j] - low[j]) / wide).astype(np.int64) + 1 for j in range(p.shape[1])] for x in (p[todo], q))
        for j in range(p.shape[1]):
            if max(at_p[j].max(), at_q[j].max()) > 1 << 20:
                at_p[j], at_q[j] = _close([at_p[j], at_q[j]])
        sizes = [int(max(at_p[j].max(), at_q[j].max())) + 2 for j in range(p.shape[1])]
        step = [1, sizes[0], sizes[0] * sizes[1]][: p.shape[1]]
        cell, own = (sum(s * c for s, c in zip(step, at)) for at in (at_q, at_p))
        order = np.argsort(cell)
        cell, q_, qid_ = cell[order], q[order], qid[order]
        near_by = np.argsort(own)
        todo, own = todo[near_by], own[near_by]
        rows_of = around @ np.array(step[1:])
        lo = np.stack([np.searchsorted(cell, own + s - 1, "left") for s in rows_of], axis=1)
        n = np.stack([np.searchsorted(cell, own + s + 1, "right") for s in rows_of], axis=1) - lo
        total = n.sum(axis=1)
        by = np.argsort(total, kind="stable")
        ordered = total[by]
        a = int(np.searchsorted(ordered, k))
        later = [todo[by[:a]]]
        while a < len(by):
            ahead = ordered[a : a + CELLS_AT_ONCE]
            b = a + max(1, int(np.searchsorted(np.arange(1, len(ahead) + 1) * ahead, CELLS_AT_ONCE, "right")))
            rows, most = by[a:b], int(ordered[b - 1])
            a = b
            whose = todo[rows]
            count = total[rows]
            starts = np.cumsum(count) - count
            row = np.repeat(np.arange(len(rows)), count)
            col = np.arange(len(row)) - starts[row]
            near = _ranges(lo[rows].ravel(), n[rows].ravel())
            d = np.zeros(len(near), kind)
            for j in range(p.shape[1]):
                one = p[whose, j][row]
                one -= q_[near, j]
                one *= one
                d += one
            d[pid[whose][row] == qid_[near]] = far
            wide_d = np.full((len(rows), most), far, kind)
            wide_d[row, col] = d
            edge = np.partition(wide_d, k - 1, axis=1)[:, k - 1]
            done = (edge <= wide * wide) & (edge < far)
            later.append(whose[~done])
            pick = np.flatnonzero(d <= np.where(done, edge, -1)[row])
            r, c, e = row[pick], near[pick], d[pick]
            ranked = np.lexsort((qid_[c], e, r))
            r, c, e = r[ranked], c[ranked], e[ranked]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            first = rank < k
            found.append((whose[r[first]], rank[first] + 1, e[first], order[c[first]]))
        left = todo = np.concatenate(later)
        if last:
            break
        reach *= 2
    return (*(np.concatenate(x) for x in zip(*found)), left) if found else (*(np.empty(0, np.int64),) * 4, left)


def _bounds(k: int, p: np.ndarray, pid: np.ndarray, q: np.ndarray, qid: np.ndarray) -> np.ndarray:
    """A squared distance within which each probe has k others: the k-th of the block's points, or of some of them where they are many."""
    out = np.full(len(p), np.inf)
    some = max(1, math.ceil(len(p) * len(q) / BOUND_AT_ONCE))
    q, qid = q[::some].astype(float), qid[::some]
    if len(q) > k:
        for a in range(0, len(p), 16):
            own = p[a : a + 16].astype(float)
            d = sum((own[:, j][:, None] - q[:, j][None, :]) ** 2 for j in range(q.shape[1]))
            d[pid[a : a + 16][:, None] == qid[None, :]] = np.inf
            out[a : a + 16] = np.partition(d, k - 1, axis=1)[:, k - 1]
    return out


def _array(values: np.ndarray, known: np.ndarray | None, kind: pa.DataType) -> pa.Array:
    mask = None if known is None else ~known
    if pa.types.is_boolean(kind):
        return pa.array(values.astype(bool), kind, mask=mask)
    return pa.array(values.astype(kind.to_pandas_dtype()), kind, mask=mask)


def _block(k: int, dims: list[str], kind: type, halo, carried: dict[str, str], places: set[str], payload: dict[str, str], same: bool, say: str):
    """A block's task. ``say``: rows (of neighbours), left (probes with fewer than k), mean or first (of each probe, left ones too)."""
    width = 1 + len(dims)

    def run(table):
        own = _columns(table, (1, 3), width + len(carried))
        other = _columns(table, (2, 3) if same else (2,), width + len(payload))
        pid, qid = own[0][0], other[0][0]
        p, q = (np.stack([v.astype(kind) for v, _ in x[1:width]], axis=1) for x in (own, other))
        rows, rank, d2, near, left = _search(k, kind, halo, p, pid, q, qid)
        if say == "rows":
            made = {"point_id": pid[rows], "rank": pa.array(rank, pa.int32()), "d2": pa.array(d2.astype(kind)), "near_id": qid[near]}
            return pa.table(made | {c: _array(v[near], None if m is None else m[near], NUMBERS[t]) for (c, t), (v, m) in zip(payload.items(), other[width:])})
        bound = _bounds(k, p[left], pid[left], q, qid)
        if say == "left":
            return pa.table({"point_id": pid[left], **{d: p[left, j] for j, d in enumerate(dims)}, "bound": bound})
        there = np.zeros(len(pid), bool)
        there[left] = True  # a place is kept where it is asked for, and of probes that look on
        made = {"point_id": pid, **{d: pa.array(p[:, j], mask=None if d in places else ~there) for j, d in enumerate(dims)}} | {c: _array(v, m, NUMBERS[t]) for (c, t), (v, m) in zip(carried.items(), own[width:])}
        done = np.ones(len(pid), bool)
        done[left] = False
        upto = np.full(len(pid), np.inf)
        upto[left] = bound
        if say == "mean":
            mean = np.bincount(rows, np.sqrt(d2.astype(float)), len(pid)) / k
            made["mean_dist"] = _array(mean, done, pa.float64())
        else:
            at = np.zeros(len(pid), np.int64)
            at[rows] = np.arange(len(rows))
            pick = lambda x, t: _array(x[at] if len(x) else np.zeros(len(pid), np.int64), done, t)
            made |= {"d2": pick(d2, pa.int64() if kind is np.int64 else pa.float64()), "near_id": pick(qid[near], pa.int64())}
            for (c, t), (v, m) in zip(payload.items(), other[width:]):
                known = done if m is None or not len(rows) else done & m[near][at]
                made[f"o_{c}"] = _array(v[near][at] if len(rows) else np.zeros(len(pid), np.int64), known, NUMBERS[t])
        return pa.table(made | {"done": done, "bound": upto})

    return run


def _foot(dims: list[str], edge):
    """The occupied cells of a block: number of points and their box."""

    def run(table):
        cols = _columns(table, (1, 2, 3), 1 + len(dims))
        at = [v for v, _ in cols[1:]]
        cells = [np.floor(x / edge).astype(np.int64) for x in at]
        order = np.lexsort(cells)
        cells = [c[order] for c in cells]
        cuts = np.flatnonzero(np.any([np.diff(c, prepend=c[:1] - 1) != 0 for c in cells], axis=0))
        made = dict(zip(CELL, (c[cuts] for c in cells))) | {"number": np.diff(cuts, append=len(order))}
        for j, x in enumerate(at):
            made |= {f"lo{j}": np.minimum.reduceat(x[order], cuts), f"hi{j}": np.maximum.reduceat(x[order], cuts)}
        return pa.table(made)

    return run


CELL = ("bx", "by", "bz")


def _cells(df: DataFrame, x: str, y: str, edge, *more: str) -> DataFrame:
    cell = lambda c: F.floor(F.col(c) / F.lit(edge)).cast("long")
    return df.withColumns({n: cell(c) for n, c in zip(CELL, (x, y, *more))})


def _block_edge(points: DataFrame, x: str, y: str, number: int, per_block: int) -> float:
    """An edge at which occupied blocks hold some ``per_block`` points: from the extent, narrowed while stray points stretch that."""
    lo_x, hi_x, lo_y, hi_y = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    spans = [max(float((hi or 0) - (lo or 0)), 1e-9) for lo, hi in ((lo_x, hi_x), (lo_y, hi_y))]
    edge = max(math.sqrt(spans[0] * spans[1] * per_block / max(1, number)), max(spans) / 2**30, 1e-9)
    for _ in range(8):
        mean = number / max(1, _cells(points, x, y, edge).select("bx", "by").distinct().count())
        if mean <= 4 * per_block or edge <= max(spans) / 2**30:
            break
        edge *= math.sqrt(per_block / mean)
    return edge


def _pyramid(build: DataFrame, dims: list[str], edge, foot) -> list[DataFrame]:
    """Levels of occupied cells (bx, by[, bz], number, box), each four times as wide as the one below, the last with ``TOP`` cells at most."""
    kinds, keys = dict(build.dtypes), CELL[: len(dims)]
    box = [f(f"{n}{j}").alias(f"{n}{j}") for j in range(len(dims)) for n, f in (("lo", F.min), ("hi", F.max))]
    columns = ["near_id", *[f"o_{d}" for d in dims]]
    schema = ", ".join([*[f"{c} long" for c in keys], "number long", *[f"{n}{j} {_wide(kinds[f'o_{d}'])}" for j, d in enumerate(dims) for n in ("lo", "hi")]])
    dealt = build.select(*columns).mapInArrow(_deal(columns, len(columns), columns[1:], edge, 0, 2), DEALT)
    levels = [written(dealt.groupBy("bx", "by").applyInArrow(_foot(dims, foot), schema).groupBy(*keys).agg(F.sum("number").alias("number"), *box), "cells-0")]
    while levels[-1].count() > TOP:
        up = levels[-1].groupBy(*[F.shiftright(c, 2).alias(c) for c in keys])
        levels.append(written(up.agg(F.sum("number").alias("number"), *box), f"cells-{len(levels)}"))
    return levels


def _near_cells(met: DataFrame, dims: list[str], k: int) -> DataFrame:
    """Of each probe's cells those that may have one of its k nearest others."""
    inside = outside = F.lit(0.0)
    for j, d in enumerate(dims):
        lo, hi, at = (F.col(c).cast("double") for c in (f"lo{j}", f"hi{j}", d))
        inside = inside + F.pow(F.greatest(lo - at, at - hi, F.lit(0.0)), 2)
        outside = outside + F.pow(F.greatest(F.abs(at - lo), F.abs(at - hi)), 2)
    own = Window.partitionBy("point_id")
    upto = F.sum("number").over(own.orderBy("outside").rangeBetween(Window.unboundedPreceding, 0))
    known = met.withColumn("inside", inside).where(F.col("inside") <= F.col("bound") * (1 + 1e-9)).withColumn("outside", outside).withColumn("upto", upto)
    known = known.withColumn("reach", F.min(F.when(F.col("upto") > k, F.col("outside"))).over(own))
    return known.where(F.col("reach").isNull() | (F.col("inside") <= F.col("reach") * (1 + 1e-9))).select("point_id", *dims, "bound", *CELL[: len(dims)])


def _descend(left: DataFrame, build: DataFrame, k: int, dims: list[str], payload: str | None, edge, foot) -> DataFrame:
    """The k nearest others of the few probes that have fewer within a halo."""
    levels, keys = _pyramid(build, dims, edge, foot), CELL[: len(dims)]
    n = len(keys)
    top = [tuple(r) for r in levels[-1].select(*keys, "number", *[f"{n}{j}" for j in range(len(dims)) for n in ("lo", "hi")]).collect()]  # TOP rows at most

    def pick(batches):
        """The top cells of each probe, as ``_near_cells`` would choose them."""
        cells = np.array(top, float).reshape(len(top), -1)
        for batch in batches:
            at = np.stack([batch.column(d).to_numpy(zero_copy_only=False).astype(float) for d in dims], axis=1)
            bound = batch.column("bound").to_numpy(zero_copy_only=False)
            for a in range(0, len(at), 256):
                own = at[a : a + 256]
                inside, outside = np.zeros((len(own), len(cells))), np.zeros((len(own), len(cells)))
                for j in range(len(dims)):
                    lo, hi, x = cells[None, :, n + 1 + 2 * j], cells[None, :, n + 2 + 2 * j], own[:, j][:, None]
                    inside += np.maximum(np.maximum(lo - x, x - hi), 0) ** 2
                    outside += np.maximum(np.abs(x - lo), np.abs(x - hi)) ** 2
                order = np.argsort(outside, axis=1, kind="stable")
                upto = np.cumsum(cells[order, n], axis=1) > k
                at_ = np.where(upto.any(axis=1), upto.argmax(axis=1), len(cells) - 1)
                reach = np.where(upto.any(axis=1), np.take_along_axis(outside, np.take_along_axis(order, at_[:, None], 1), 1)[:, 0], np.inf)
                r, c = np.nonzero(inside <= np.minimum(reach, bound[a : a + 256])[:, None] * (1 + 1e-9))
                part = batch.slice(a, len(own)).take(pa.array(r))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(cells[c, j].astype(np.int64)) for j in range(n))], names=[*part.schema.names, *keys])

    kinds = dict(left.dtypes)
    met = left.select("point_id", *dims, "bound").mapInArrow(pick, ", ".join([*[f"{c} {kinds[c]}" for c in ("point_id", *dims)], "bound double", *[f"{c} long" for c in keys]])) if top else left.select("point_id", *dims, "bound", *[F.lit(0).cast("long").alias(c) for c in keys]).limit(0)
    for level in reversed(levels[:-1]):
        below = level.withColumns({f"u{c}": F.shiftright(c, 2) for c in keys})
        up = met.select("point_id", *dims, "bound", *[F.col(c).alias(f"u{c}") for c in keys])
        met = _near_cells(up.join(below, [f"u{c}" for c in keys]), dims, k)
    met = written(met, "near-cells")
    some = met.select(*keys).distinct()
    there = _cells(build, *[f"o_{d}" for d in dims[:2]], foot, *[f"o_{d}" for d in dims[2:]])
    there = there.join(F.broadcast(some) if some.count() <= FEW_CELLS else some, list(keys), "left_semi")
    d2 = sum((F.pow(F.col(d) - F.col(f"o_{d}"), 2) if "double" in (kinds[d], dict(build.dtypes)[f"o_{d}"]) else (F.col(d) - F.col(f"o_{d}")) * (F.col(d) - F.col(f"o_{d}")) for d in dims), start=F.lit(0))
    ranked = met.join(there, list(keys)).where("point_id <> near_id").withColumn("d2", d2)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("point_id").orderBy("d2", "near_id")))
    return ranked.where(F.col("rank") <= k).select("point_id", "rank", "d2", "near_id", *([F.col(f"o_{payload}")] if payload else []))


def _wide(kind: str) -> str:
    return "double" if kind in ("float", "double") else "long"


def _nowhere(df: DataFrame, dims: list[str]):
    kinds = dict(df.dtypes)
    return functools.reduce(lambda a, b: a | b, [F.col(d).isNull() | (F.isnan(d) if kinds[d] in ("float", "double") else F.lit(False)) for d in dims])


def _kept(df: DataFrame, label: str) -> DataFrame:
    return df if _lasts(df) else written(df, label, "zstd")


def _lasts(df: DataFrame) -> bool:
    """Whether rows are in files already: written by us, or a reader's table, which isn't ours to remove."""
    return hasattr(df, "written_to") or hasattr(df, "lasting")


def settled(table: DataFrame, large: bool | None = None) -> DataFrame:
    """A written table, after the shuffle files of its making have gone, where it is large enough for that to matter."""
    if table.count() >= LARGE if large is None else large:
        free_shuffles(table.sparkSession)
    return table


class _Task:
    """Probes and build points in blocks, ready for one search or several."""

    def __init__(self, probes: DataFrame, build: DataFrame, k: int, dims: list[str], carry: list[str], payload: str | None, edge, per_block: int):
        importable(probes.sparkSession)
        self.spark, self.k, self.dims, self.payload = probes.sparkSession, k, dims, payload
        kinds, others = dict(probes.dtypes), dict(build.dtypes)
        self.whole = all(t[d] in ("bigint", "int", "smallint", "tinyint") for t in (kinds, others) for d in dims)
        self.number = "long" if self.whole else "double"
        self.kinds = {d: self.number for d in dims}
        self.carried = {c: kinds[c] for c in carry if c not in ("point_id", *dims)}
        self.places = {d for d in dims if d in carry}
        self.extra = {payload: others[payload]} if payload else {}
        if payload and self.extra[payload] not in NUMBERS:
            raise ValueError(f"{payload} isn't a number")
        self.same = probes is build and not payload
        real = lambda df: df.where(~_nowhere(df, dims))
        as_number = lambda d: F.col(d).cast(self.number)
        self.asks = real(probes).select("point_id", *[as_number(d).alias(d) for d in dims], *self.carried)
        self.other = real(build).select(F.col("point_id").alias("near_id"), *[as_number(d).alias(f"o_{d}") for d in dims], *[F.col(c).alias(f"o_{c}") if c not in dims else as_number(c).alias("o__") for c in self.extra])
        size = self.other.count()
        self.large = size >= LARGE
        edge = edge or _block_edge(self.other, f"o_{dims[0]}", f"o_{dims[1]}", size, per_block)
        self.edge = math.ceil(edge / (FINE * HALO)) * FINE * HALO if self.whole else edge
        self.halo = self.edge // HALO if self.whole else self.edge / HALO
        self.foot = self.edge // FINE if self.whole else self.edge / FINE

    def say(self, what: str) -> DataFrame:
        dims, width = self.dims, 1 + len(self.dims)
        kind = np.int64 if self.whole else float
        columns = ["point_id", *dims, *self.carried]
        dealt = self.asks.mapInArrow(_deal(columns, width, dims, self.edge, self.halo, 3 if self.same else 1), DEALT)
        if not self.same:
            names = self.other.columns
            dealt = dealt.unionByName(self.other.mapInArrow(_deal(names, len(names), names[1:width], self.edge, self.halo, 2), DEALT))
        own = ["point_id long", *[f"{d} {self.number}" for d in dims]]
        schema = {
            "rows": ["point_id long", "rank int", f"d2 {self.number}", "near_id long", *[f"{c} {t}" for c, t in self.extra.items()]],
            "left": [*own, "bound double"],
            "mean": [*own, *[f"{c} {t}" for c, t in self.carried.items()], "mean_dist double", "done boolean", "bound double"],
            "first": [*own, *[f"{c} {t}" for c, t in self.carried.items()], f"d2 {self.number}", "near_id long", *[f"o_{c} {t}" for c, t in self.extra.items()], "done boolean", "bound double"],
        }[what]
        return dealt.groupBy("bx", "by").applyInArrow(_block(self.k, dims, kind, self.halo, self.carried, self.places, self.extra, self.same, what), ", ".join(schema))

    def rest(self, left: DataFrame) -> DataFrame | None:
        """The neighbours of probes that have fewer than k in a halo, as rows (payload with o_); None without such probes."""
        if not left.limit(1).count():
            return None
        other = self.other.withColumnRenamed("o__", f"o_{self.payload}") if self.payload not in self.dims else self.other.drop("o__")
        return settled(written(_descend(left, other, self.k, self.dims, self.payload, self.edge, self.foot), "neighbours"), self.large)

    def each(self, what: str) -> DataFrame:
        """A row for each probe with what is said of it, null for those without as many others."""
        table = settled(written(self.say(what), "each", "zstd"), self.large)
        left = table.where("NOT done")
        rest = self.rest(left)
        if rest is None:
            return table.drop("done", "bound")
        if what == "mean":
            met = rest.groupBy("point_id").agg((F.sum(F.sqrt(F.col("d2").cast("double"))) / F.count("*")).alias("mean_dist"))
        else:
            met = rest.drop("rank").withColumn("d2", F.col("d2").cast(self.number))
        kept = [c for c in left.columns if c == "point_id" or c not in met.columns]
        return table.where("done").unionByName(left.select(*kept).join(met, "point_id", "left").select(*table.columns)).drop("done", "bound")


def nearest(probes: DataFrame, build: DataFrame, k: int, dims: list[str], payload: str | None = None, edge: float | None = None, per_block: int = PER_BLOCK) -> DataFrame:
    """(point_id, rank, d2, near_id[, payload]) of the k nearest others of each probe, ties by id. ``edge``: of the blocks."""
    same = probes is build
    columns = list(dict.fromkeys(["point_id", *dims]))
    asks = _kept(probes.select(*columns) if not hasattr(probes, "written_to") else probes, "probes")
    other = asks if same and not payload else _kept(build.select(*dict.fromkeys([*columns, *([payload] if payload else [])])) if not hasattr(build, "written_to") else build, "build")
    task = _Task(asks, other, k, dims, [], payload, edge, per_block)
    settled(asks, task.large)
    extra = [payload] if payload else []
    if k == 1:
        found = task.each("first").where("d2 IS NOT NULL")
        return found.select("point_id", F.lit(1).alias("rank"), "d2", "near_id", *[F.col(f"o_{c}").alias(c) for c in extra])
    rest = task.rest(settled(written(task.say("left"), "unresolved"), task.large))
    found = task.say("rows")
    return found if rest is None else found.unionByName(rest.select("point_id", "rank", F.col("d2").cast(task.number).alias("d2"), "near_id", *[F.col(f"o_{c}").alias(c) for c in extra]))


def _of_each(points: DataFrame, probes: DataFrame, build: DataFrame, k: int, dims: list[str], payload: str | None, what: str, edge, carry: list[str]) -> DataFrame:
    """Probes with ``carry`` columns and what is said of each; columns that aren't numbers are joined, probes that lie nowhere have null."""
    kinds = dict(probes.dtypes)
    along = [c for c in carry if kinds[c] in NUMBERS]
    others = [c for c in carry if c not in along]
    task = _Task(probes, build, k, dims, along, payload, edge, PER_BLOCK)
    settled(points, task.large)
    found = task.each(what)
    names = [c for c in found.columns if c not in ("point_id", *dims, *along)]
    found = found.select(*[F.col(c).cast(kinds[c]).alias(c) for c in dict.fromkeys(["point_id", *along])], *names)
    nowhere = probes.where(_nowhere(probes, dims))
    if nowhere.limit(1).count():
        found = found.unionByName(nowhere.select(*[F.lit(None).cast(t).alias(c) if c in names else F.col(c) for c, t in found.dtypes]))
    return found.join(probes.select("point_id", *others), "point_id") if others else found


def height_above_ground(points: DataFrame, ground: int = GROUND_CLASS, x: str = "x", y: str = "y", z: str = "z", max_distance: float | None = None, extrapolate: bool = True, out: str = "hag") -> DataFrame:
    """Points with the height over the nearest ground point in the plane; 0 for ground, null where there is none in reach.

    Without ``extrapolate``, points outside the ground's box have height 0.
    """
    require(points, "point_id", x, y, z, "classification")
    kept = _kept(points, "points")
    is_ground = F.col("classification") == ground
    floor_ = kept.where(is_ground)
    found = _of_each(kept, kept.where(~is_ground), floor_, 1, [x, y], z, "first", None, kept.columns)
    ground_z = F.col(f"o_{z}")
    if max_distance is not None:
        ground_z = F.when(F.col("d2") <= max_distance * max_distance, ground_z)
    found = found.select(*kept.columns, ground_z.alias("ground_z"))
    met = found.unionByName(kept.where(is_ground | is_ground.isNull()).withColumn("ground_z", F.lit(None).cast(dict(found.dtypes)["ground_z"])))
    height = F.when(is_ground, F.lit(0)).otherwise(F.col(z) - F.col("ground_z"))
    if not extrapolate:
        b = floor_.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
        height = F.when(F.col(x).between(b[0], b[1]) & F.col(y).between(b[2], b[3]), height).otherwise(F.lit(0))
    return met.withColumn(out, height.cast(dict(points.dtypes)[z])).drop("ground_z")


def mean_distances(points: DataFrame, k: int = OUTLIER_K, dims: tuple[str, ...] = ("x", "y", "z"), edge: float | None = None) -> DataFrame:
    """(point_id, mean_dist) over the k nearest others in space."""
    kept = _kept(points.select("point_id", *dims) if not hasattr(points, "written_to") else points, "points")
    return _of_each(kept, kept, kept, k, list(dims), None, "mean", edge, ["point_id"]).where("mean_dist IS NOT NULL")


def outlier_stats(means: DataFrame, multiplier: float = OUTLIER_MULTIPLIER, stddev: str = "sample") -> DataFrame:
    spread = (F.stddev_samp if stddev == "sample" else F.stddev_pop)("mean_dist")
    return means.agg(F.avg("mean_dist").alias("mean"), spread.alias("stddev"), (F.avg("mean_dist") + multiplier * spread).alias("threshold"))


def flag_outliers(points: DataFrame, k: int = OUTLIER_K, multiplier: float = OUTLIER_MULTIPLIER, class_code: int = NOISE_CLASS, stddev: str = "sample", dims: tuple[str, ...] = ("x", "y", "z"), edge: float | None = None, columns: list[str] | None = None) -> DataFrame:
    """Points with mean_dist and is_outlier; outliers get the noise class, none is dropped. ``columns``: what is kept of a point, else all."""
    columns = columns or points.columns
    kept = _kept(points if _lasts(points) else points.select(*dict.fromkeys(["point_id", *dims, *columns])), "points")
    met = _of_each(kept, kept, kept, k, list(dims), None, "mean", edge, columns).select(*columns, "mean_dist")
    limit = outlier_stats(met, multiplier, stddev).first()["threshold"]
    flag = F.coalesce(F.col("mean_dist") > F.lit(limit), F.lit(False)) if limit is not None else F.lit(False)
    return met.withColumn("is_outlier", flag).withColumn("classification", F.when(F.col("is_outlier"), class_code).otherwise(F.col("classification")).cast("int"))
