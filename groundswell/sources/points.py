"""Point clouds in, as a DataFrame and what is known about it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from groundswell.model import POINTS
from groundswell.operators.validate import crs_of
from groundswell.session import importable
from groundswell.sources import las


def read_points(spark: SparkSession, path: str, fmt: str = "parquet", default_crs: str | None = None, crs: str | None = None) -> tuple[DataFrame, dict]:
    """Points of ``POINTS``' columns, and {"path", "crs", "findings"}. Parquet or uncompressed LAS."""
    importable(spark)
    path = re.sub(r"^(?i:pdal://)", "", path)
    if fmt == "las":
        spark.dataSource.register(las.LasSource)
        points = spark.read.format("las").load(path)
        reader = las.LasReader({"path": path}).partitions()
        crs = crs or (reader[0].head.crs_wkt if reader else None)
    else:
        points = spark.read.parquet(path)
    chosen = points.select(*[points[f.name].cast(f.dataType).alias(f.name) for f in POINTS.fields])
    known, findings = crs_of(crs, default_crs)
    return chosen, {"path": path, "crs": known, "findings": findings}


def merge(*clouds: DataFrame) -> DataFrame:
    """Several clouds as one; ids are the caller's."""
    out = clouds[0]
    for c in clouds[1:]:
        out = out.unionByName(c)
    return out
