"""Data model: point schema, grids, options."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([
    T.StructField("point_id", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()), T.StructField("classification", T.IntegerType()),
])
CELLS = T.StructType([T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("value", T.DoubleType())])
BANDS = ["dtm", "chm", "mrm", "vdi"]

# Fixed values of the workflow.
GROUND_CLASS = 2
NOISE_CLASS = 7
RESOLUTION = 0.25
MIN_DENSITY = 5.0
WARN_DENSITY = 30.0
OUTLIER_K = 8
OUTLIER_MULTIPLIER = 3.0
IDW_POWER = 6.0
FILL_WINDOWS = {"dtm": 12, "chm": 3, "low": 5, "high": 5}
LOW_HEIGHT = 0.8
HIGH_HEIGHT = 12.0
FOCAL_SIZE = 10
MRM_LIMIT = 1.0
VDI_ZERO = 0.1
PERCENTILES = (1.0, 99.0)
NORMAL_EPS = 1e-10
TILE = 224
STRIDE = 112
BLEND_EPS = 1e-7


def require(df: DataFrame, *columns: str) -> None:
    """Fail early where a column that an operator reads is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid: row 0 is the northernmost, column 0 the westernmost; anchored at the least x and y."""

    x_min: float
    y_min: float
    res: float
    width: int
    height: int
    crs_wkt: str = ""
    nodata: float = 0.0

    @classmethod
    def from_points(cls, points: DataFrame, res: float = RESOLUTION, x: str = "x", y: str = "y", crs_wkt: str = "") -> "GridSpec":
        """floor(range / res) + 1 cells from (least x, least y): a point on the far edge has a cell."""
        r = points.agg(F.min(x).alias("a"), F.max(x).alias("b"), F.min(y).alias("c"), F.max(y).alias("d")).first()
        if r["a"] is None:
            return cls(0, 0, res, 0, 0, crs_wkt)
        return cls(r["a"], r["c"], res, math.floor((r["b"] - r["a"]) / res) + 1, math.floor((r["d"] - r["c"]) / res) + 1, crs_wkt)

    @property
    def y_max(self) -> float:
        return self.y_min + self.height * self.res

    def up(self, y: Column) -> Column:
        """Row counted from the south."""
        return F.floor((y - F.lit(self.y_min)) / F.lit(self.res)).cast("int")

    def cell_of(self, x: Column, y: Column) -> tuple[Column, Column]:
        return (F.lit(self.height - 1) - self.up(y)).cast("int"), F.floor((x - F.lit(self.x_min)) / F.lit(self.res)).cast("int")

    def centre(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.lit(self.x_min) + (col + 0.5) * self.res, F.lit(self.y_max) - (row + 0.5) * self.res

    def all_cells(self, spark) -> DataFrame:
        n = spark.range(self.width * self.height)
        return n.select(F.expr(f"cast(id div {max(1, self.width)} as int)").alias("row"), (F.col("id") % max(1, self.width)).cast("int").alias("col"))

    def record(self) -> dict:
        return asdict(self) | {"y_max": self.y_max}


@dataclass(frozen=True)
class PreprocessOptions:
    """What the first pipeline lets one set. Lengths are in the points' unit."""

    res: float = RESOLUTION
    grid_policy: str = "shared"  # or "reference": extents of each raster's own points, cropped by index
    min_density: float = MIN_DENSITY
    warn_density: float = WARN_DENSITY
    outlier_k: int = OUTLIER_K
    outlier_multiplier: float = OUTLIER_MULTIPLIER
    outlier_stddev: str = "sample"  # or "population"
    noise_class: int = NOISE_CLASS
    hag_max_distance: float | None = None
    hag_extrapolate: bool = True
    binning: str = "disc"  # or "bin"
    radius: float | None = None  # res * sqrt(2) where none
    fill_counts: bool = False
    low_height: float = LOW_HEIGHT
    high_height: float = HIGH_HEIGHT
    mrm_limit: float = MRM_LIMIT
    nodata: float | None = None  # 0 in the reference policy: real zeros count as missing there


@dataclass(frozen=True)
class ModelConfig:
    bands: int = 4
    tile: int = TILE
    stride: int = STRIDE
    batch_size: int = 1
    drop_border: int = 0
    augmentation: bool = True
