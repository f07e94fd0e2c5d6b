"""Bands: alignment, stacking, exact percentiles, normalisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.functions import mask_nodata, micro_relief, rescale, vegetation_density
from groundswell.model import BANDS, MRM_LIMIT, NORMAL_EPS, VDI_ZERO, GridSpec


def relief(dtm: DataFrame, smooth: DataFrame, limit: float = MRM_LIMIT, missing: float = 0.0) -> DataFrame:
    """(row, col, value) of every smoothed cell: the terrain (``missing`` where it has none) less the smoothed one, within the limit."""
    a, b = dtm.select("row", "col", F.col("value").alias("v")), smooth.select("row", "col", F.col("value").alias("s"))
    return b.join(a, ["row", "col"], "left").select("row", "col", micro_relief(F.coalesce("v", F.lit(missing)), F.col("s"), limit).alias("value"))


def density(low: Column, high: Column, zero_value: float = VDI_ZERO) -> Column:
    return vegetation_density(low, high, zero_value)


def align(a: DataFrame, b: DataFrame, shape_a: tuple[int, int], shape_b: tuple[int, int], policy: str = "shared") -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """Two rasters on one shape: equal shapes (shared), or both cropped from row and column 0 to the least shape (reference)."""
    if policy == "shared":
        if shape_a != shape_b:
            raise ValueError(f"shapes differ: {shape_a} and {shape_b}")
        return a, b, shape_a
    shape = min(shape_a[0], shape_b[0]), min(shape_a[1], shape_b[1])
    inside = (F.col("row") < shape[0]) & (F.col("col") < shape[1])
    return a.where(inside), b.where(inside), shape


def crop(a: DataFrame, b: DataFrame) -> DataFrame:
    """(row, col, a, b) where both have a cell, within the least number of rows and of columns of the two."""
    ends = [x.agg(F.max("row"), F.max("col")).first() for x in (a, b)]
    rows, cols = (min((e[k] for e in ends if e[k] is not None), default=-1) for k in (0, 1))
    inside = (F.col("row") <= rows) & (F.col("col") <= cols)
    left, right = (x.where(inside).select("row", "col", F.col("value").alias(n)) for x, n in ((a, "a"), (b, "b")))
    return left.join(right, ["row", "col"])


def stack(bands: dict[str, DataFrame], shapes: list[tuple[int, int]] | None = None) -> DataFrame:
    """(row, col, a column a band) in one shuffle: bands are tagged, united and grouped by cell."""
    if shapes and len(set(shapes)) > 1:
        raise ValueError(f"bands of different shapes: {shapes}")
    tagged = None
    for k, (_, df) in enumerate(bands.items()):
        one = df.select("row", "col", F.lit(k).alias("band"), F.col("value").cast("double").alias("value"))
        tagged = one if tagged is None else tagged.unionByName(one)
    return tagged.groupBy("row", "col").agg(*[F.max(F.when(F.col("band") == k, F.col("value"))).alias(name) for k, name in enumerate(bands)])


def percentiles(wide: DataFrame, bands: list[str], shares: list[float], bins: int = 2048, least: int = 50_000) -> dict[str, list[float | None]]:
    """Exact percentiles (linear between order statistics at (n - 1) p) of each band's values that aren't null.

    Histograms between known bounds narrow down the bins that hold the ranks, until a bin has few rows, which are sorted: each round is one
    scan with at most ``bins`` counters a rank, so nothing grows with the raster in one task or the driver.
    """
    ends = wide.agg(*[f(b).alias(f"{n}_{b}") for b in bands for n, f in (("n", F.count), ("lo", F.min), ("hi", F.max))]).first()
    wanted = {b: [(ends[f"n_{b}"] - 1) * p for p in shares] for b in bands if ends[f"n_{b}"]}
    open_ = {(b, k): (float(ends[f"lo_{b}"]), float(ends[f"hi_{b}"]), 0, ends[f"n_{b}"]) for b, ps in wanted.items() for p in ps for k in (math.floor(p), math.ceil(p))}
    got: dict[tuple[str, int], float] = {}
    while open_:
        for key, (lo, hi, _, _) in list(open_.items()):
            if lo == hi:
                got[key] = lo
                del open_[key]
        few = [key for key, (_, _, _, n) in open_.items() if n <= least]
        for b, k in few:
            lo, hi, before, _ = open_.pop((b, k))
            values = sorted(r[0] for r in wide.where(F.col(b).between(lo, hi)).select(F.col(b).cast("double")).collect())  # at most ``least``
            got[b, k] = values[k - before]
        if not open_:
            break
        keys, rows = list(open_), []
        for t, (b, k) in enumerate(keys):
            lo, hi, _, _ = open_[b, k]
            v = F.col(b).cast("double")
            rows.append(F.when(v.between(lo, hi), F.struct(F.lit(t).alias("t"), F.least(F.lit(bins - 1), F.floor((v - lo) / (hi - lo) * bins)).cast("int").alias("bin"), v.alias("v"))))
        counts = wide.select(F.explode(F.filter(F.array(*rows), lambda x: x.isNotNull())).alias("x")).groupBy("x.t", "x.bin").agg(F.count("*").alias("n"), F.min("x.v").alias("lo"), F.max("x.v").alias("hi")).collect()
        for t, (b, k) in enumerate(keys):
            upto = open_[b, k][2]
            for r in sorted((r for r in counts if r["t"] == t), key=lambda r: r["bin"]):
                if upto + r["n"] > k:
                    open_[b, k] = (r["lo"], r["hi"], upto, r["n"])
                    break
                upto += r["n"]
    out: dict[str, list[float | None]] = {}
    for b in bands:
        out[b] = []
        for p in shares:
            if b not in wanted:
                out[b].append(None)
                continue
            at = (ends[f"n_{b}"] - 1) * p
            lo, hi = got[b, math.floor(at)], got[b, math.ceil(at)]
            out[b].append(lo + (hi - lo) * (at - math.floor(at)))
    return out


def normalize(wide: DataFrame, bands: list[str] | None = None, low: float = 1.0, high: float = 99.0, nodata: float | None = None, eps: float = NORMAL_EPS) -> DataFrame:
    """Each band between its percentiles, within 0 and 1; cells without data (or equal to ``nodata``) have none.

    A band without any value stays null.
    """
    bands = bands or BANDS
    masked = wide.select("row", "col", *[(mask_nodata(F.col(b), nodata) if nodata is not None else F.col(b)).alias(b) for b in bands])
    found = percentiles(masked, bands, [low / 100, high / 100])
    column = lambda b: F.lit(None).cast("double") if found[b][0] is None else rescale(F.col(b), F.lit(found[b][0]), F.lit(found[b][1]), eps)
    return masked.select("row", "col", *[column(b).alias(b) for b in bands])


def shape_of(grid: GridSpec) -> tuple[int, int]:
    return grid.height, grid.width
