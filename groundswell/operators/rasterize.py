"""Points to grid cells: disc or bin aggregates in one pass, and filling of gaps from cells around.

Points, not their hits, are shuffled: a point goes to the blocks of cells in its reach, mostly one. There it is dealt to every cell whose centre
is strictly within the radius (explode over the few cells in reach), and cells are aggregated where they are, without a shuffle of
their own. Distances are in doubled units, so integer coordinates stay exact.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.model import IDW_POWER, GridSpec, require
from groundswell.operators.blocks import blockwise

BLOCK = 64  # cells along the edge of a block that is aggregated in one task


def cell_hits(points: DataFrame, grid: GridSpec, x: str = "x", y: str = "y", radius: float | None = None, binning: str = "disc") -> DataFrame:
    """Points with row and col of each cell they count for, and q: four times the squared distance to its centre."""
    require(points, x, y)
    dx, dy = F.col(x) - F.lit(grid.x_min), F.col(y) - F.lit(grid.y_min)
    east, north = F.floor(dx / F.lit(grid.res)).cast("int"), F.floor(dy / F.lit(grid.res)).cast("int")
    if binning == "bin":
        made = points.withColumn("_c", east).withColumn("_r", north)
    else:
        reach = 1 if radius is None else math.floor(radius / grid.res + 0.5)
        steps = F.sequence(F.lit(-reach), F.lit(reach))
        made = points.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps)).withColumn("_c", east + F.col("_i")).withColumn("_r", north + F.col("_j")).drop("_i", "_j")
    side = lambda d, k: (2 * d - (2 * F.col(k) + 1) * F.lit(grid.res))
    made = made.withColumn("q", side(dx, "_c") * side(dx, "_c") + side(dy, "_r") * side(dy, "_r"))
    if binning != "bin":
        limit = 8 * grid.res * grid.res if radius is None else 4 * radius * radius
        made = made.where(F.col("q") < F.lit(limit))
    made = made.where(F.col("_c").between(0, grid.width - 1) & F.col("_r").between(0, grid.height - 1))
    return made.withColumn("row", F.lit(grid.height - 1) - F.col("_r")).withColumnRenamed("_c", "col").drop("_r")


def idw(value: Column, power: float = IDW_POWER, tie: str = "point_id") -> Column:
    """Inverse-distance mean of a cell's hits; a point on the centre wins, of several the one of the least id."""
    w = 1 / F.pow(F.col("q").cast("double"), F.lit(power / 2))
    exact = F.min_by(value.cast("double"), F.when(F.col("q") == 0, F.col(tie)))
    far = F.col("q") != 0
    return F.coalesce(exact, F.sum(F.when(far, value * w)) / F.sum(F.when(far, w)))


def rasterize(points: DataFrame, grid: GridSpec, value: str = "z", how: str = "idw", power: float = IDW_POWER, radius: float | None = None, binning: str = "disc", x: str = "x", y: str = "y") -> DataFrame:
    """(row, col, value) of the cells that points reach."""
    one = {"idw": lambda: idw(F.col(value), power), "max": lambda: F.max(value).cast("double"), "count": lambda: F.count("*").cast("double")}[how]()
    return rasterize_all(points, grid, {"value": one}, radius, binning, x, y)


def rasterize_all(points: DataFrame, grid: GridSpec, values: dict[str, Column], radius: float | None = None, binning: str = "disc", x: str = "x", y: str = "y") -> DataFrame:
    """Several aggregates of the same hits in one shuffle, of points by block."""
    reach = 0 if binning == "bin" else 1 if radius is None else math.floor(radius / grid.res + 0.5)
    dealt = points
    for name, c, least, cells in (("_bc", x, grid.x_min, grid.width), ("_br", y, grid.y_min, grid.height)):
        at = F.floor((F.col(c) - F.lit(least)) / F.lit(grid.res))
        first, last = F.greatest(at - reach, F.lit(0)), F.least(at + reach, F.lit(cells - 1))
        place = lambda i: F.floor(i / BLOCK).cast("int")
        dealt = dealt.where(first <= last).withColumn(name, F.explode(F.sequence(place(first), place(last))))
    hits = cell_hits(dealt.repartition("_br", "_bc"), grid, x, y, radius, binning)
    inside = (F.floor(F.col("col") / BLOCK) == F.col("_bc")) & (F.floor((F.lit(grid.height - 1) - F.col("row")) / BLOCK) == F.col("_br"))
    return hits.where(inside).groupBy("_br", "_bc", "row", "col").agg(*[v.alias(k) for k, v in values.items()]).drop("_br", "_bc")


def fill_gaps(cells: DataFrame, grid: GridSpec, window: int, exponent: float = 1.0, metric: str = "chebyshev", block: int = 112) -> DataFrame:
    """All cells with a value: the given ones, and gaps with a given one within ``window`` cells, as their inverse-distance mean.

    Distances of steps weigh by least common multiple over distance where that is an integer (exact sums), else 1 / d.
    """
    whole = math.lcm(*range(1, window + 1)) if exponent == 1 and metric == "chebyshev" and window <= 20 else 1

    def kernel(a: np.ndarray, top: int, left: int) -> np.ndarray:
        n, m = a.shape[0] - 2 * window, a.shape[1] - 2 * window
        core = a[window : window + n, window : window + m]
        have, v = ~np.isnan(a), np.nan_to_num(a)
        up, down = np.zeros((n, m)), np.zeros((n, m))
        if np.isnan(core).any():
            for i in range(-window, window + 1):
                for j in range(-window, window + 1):
                    d = max(abs(i), abs(j)) if metric == "chebyshev" else math.hypot(i, j)
                    if d:
                        w = whole // d if whole > 1 else d**-exponent
                        part = slice(window + i, window + i + n), slice(window + j, window + j + m)
                        up += w * v[part]
                        down += w * have[part]
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(np.isnan(core), np.where(down > 0, up / down, np.nan), core)

    return blockwise(cells, grid, (window, window), kernel, edge="none", block=block)
