"""Validation of a point cloud: one aggregate over the scan, then rules."""

from __future__ import annotations

import importlib.util

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.model import GROUND_CLASS, MIN_DENSITY, WARN_DENSITY


class ValidationError(ValueError):
    """All errors of a cloud, a line each."""


def bbox(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return points.agg(F.min(x).alias("x_min"), F.max(x).alias("x_max"), F.min(y).alias("y_min"), F.max(y).alias("y_max"), F.count("*").alias("n"))


def density(points: DataFrame, x: str = "x", y: str = "y", unit: float = 1.0) -> DataFrame:
    """bbox and points per square unit of its area (``unit``: coordinates in one); infinite for an empty area."""
    area = ((F.col("x_max") - F.col("x_min")) / unit) * ((F.col("y_max") - F.col("y_min")) / unit)
    return bbox(points, x, y).withColumn("area", area.cast("double")).withColumn("density", F.when(F.col("area") > 0, F.col("n") / F.col("area")).otherwise(F.lit(float("inf"))))


def density_class(value: Column, low: float = MIN_DENSITY, high: float = WARN_DENSITY) -> Column:
    return F.when(value < low, "error").when(value > high, "warning").otherwise("ok")


def class_codes(points: DataFrame) -> DataFrame:
    """Distinct class codes, ascending: combined on the map side, at most 256 rows."""
    return points.select(F.col("classification").cast("int").alias("classification")).where("classification IS NOT NULL").distinct()


def class_rules(points: DataFrame, ground: int = GROUND_CLASS) -> DataFrame:
    own = F.col("classification")
    return points.agg(F.coalesce(F.bool_or(own == ground), F.lit(False)).alias("has_ground"), F.coalesce(F.bool_or(own != ground), F.lit(False)).alias("has_other"))


def crs_of(source: str | None, default: str | None) -> tuple[str | None, list[tuple[str, str, str]]]:
    """The source's CRS, or the default with a warning, or an error."""
    if source:
        return source, []
    if default:
        return default, [("warning", "crs", "no CRS in the source: the default is used")]
    return None, [("error", "crs", "no CRS in the source and no default")]


def report(points: DataFrame, min_density: float = MIN_DENSITY, warn_density: float = WARN_DENSITY, x: str = "x", y: str = "y", unit: float = 1.0, ground: int = GROUND_CLASS) -> DataFrame:
    """(severity, code, message) from one pass over the points; severity ok where a rule holds."""
    own = F.col("classification")
    r = points.agg(
        F.count("*").alias("n"), (F.max(x) - F.min(x)).alias("dx"), (F.max(y) - F.min(y)).alias("dy"),
        F.coalesce(F.bool_or(own == ground), F.lit(False)).alias("some_ground"), F.coalesce(F.bool_or(own != ground), F.lit(False)).alias("some_other"),
        F.array_join(F.array_sort(F.collect_set(own.cast("int"))), ", ").alias("codes"),
    )
    area = (F.col("dx") / unit) * (F.col("dy") / unit)
    d = F.when(area > 0, F.col("n") / area).otherwise(F.lit(float("inf")))
    kind = density_class(d, min_density, warn_density)
    shown = F.when(area > 0, F.format_string("%.2f points per square unit", d.cast("double"))).otherwise("no area")
    rows = [
        (kind, "density", shown),
        (F.lit("ok"), "classes", F.concat(F.lit("classes: "), F.col("codes"))),
        (F.when(F.col("some_ground"), "ok").otherwise("error"), "ground", F.when(F.col("some_ground"), "ground points found").otherwise(f"no points of class {ground}")),
        (F.when(F.col("some_other"), "ok").otherwise("error"), "other", F.when(F.col("some_other"), "other points found").otherwise(f"no points but of class {ground}")),
    ]
    made = F.array(*[F.struct(a.alias("severity"), F.lit(b).alias("code"), c.alias("message")) for a, b, c in rows])
    return r.select(F.inline(made))


def validate(points: DataFrame, crs: str | None = None, default_crs: str | None = None, raise_on_error: bool = True, **rules) -> list[tuple[str, str, str]]:
    """All findings but those that hold; raises once with every error, a line each. Warnings come first."""
    if points is None:
        raise ValidationError("no point cloud")
    if "classification" not in points.columns:
        found = [("error", "classification", "points have no classification")]
    else:
        found = [tuple(r) for r in report(points, **rules).collect() if r["severity"] != "ok"]
    found += crs_of(crs, default_crs)[1]
    found.sort(key=lambda f: f[0] != "warning")
    errors = [m for s, _, m in found if s == "error"]
    if errors and raise_on_error:
        raise ValidationError("\n".join(errors))
    return found


def tools() -> dict[str, bool]:
    """Which optional modules there are: ``onnxruntime`` for model files, ``lazrs`` for compressed clouds, ``zstandard`` for scoring texts."""
    return {name: importlib.util.find_spec(name) is not None for name in ("onnxruntime", "lazrs", "zstandard")}


def need(*names: str) -> None:
    """Fail before any work where a module that a run needs is missing."""
    missing = [n for n in names if not tools()[n]]
    if missing:
        raise ValidationError(f"missing modules: {', '.join(missing)}")
