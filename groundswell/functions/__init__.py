"""Column functions: band algebra, masks, small string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundswell.model import MRM_LIMIT, NORMAL_EPS, VDI_ZERO


def uri_strip(uri: Column) -> Column:
    """A source address without its scheme ``pdal://`` in any case."""
    return F.regexp_replace(uri, r"^(?i)pdal://", "")


def mask_nodata(value: Column, nodata: float) -> Column:
    return F.nullif(value, F.lit(nodata))


def clip(value: Column, low: float, high: float) -> Column:
    """``value`` within bounds; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def micro_relief(dtm: Column, smooth: Column, limit: float = MRM_LIMIT) -> Column:
    return clip(dtm - smooth, -limit, limit)


def vegetation_ratio(low: Column, high: Column) -> Column:
    return F.when(high != 0, low / high).otherwise(F.lit(0.0)).cast("double")


def vegetation_density(low: Column, high: Column, zero_value: float = VDI_ZERO) -> Column:
    """Share of low points; an exact zero becomes ``zero_value``; within 0 and 1."""
    ratio = vegetation_ratio(low, high)
    return clip(F.when(ratio == 0, F.lit(zero_value)).otherwise(ratio), 0.0, 1.0)


def rescale(value: Column, low: Column, high: Column, eps: float = NORMAL_EPS) -> Column:
    return clip((value - low) / (high - low + eps), 0.0, 1.0)


def rotated(row: Column, col: Column, width: Column | int) -> tuple[Column, Column]:
    """Where a quarter turn counter-clockwise takes a cell of a raster of ``width`` columns."""
    return F.lit(width) - 1 - col, row


def unrotated(row: Column, col: Column, width: Column | int) -> tuple[Column, Column]:
    return col, F.lit(width) - 1 - row


def flipped(row: Column, col: Column, height: Column | int) -> tuple[Column, Column]:
    return F.lit(height) - 1 - row, col


def mirror_whole(i: Column, n: int) -> Column:
    """Index beyond the end, mirrored without repeating the edge."""
    return F.when(i >= n, 2 * (n - 1) - i).otherwise(i)
