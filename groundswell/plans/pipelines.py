"""The two named pipelines: a point cloud to four normalised bands, and bands to a probability map."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.functions import vegetation_density
from groundswell.model import BANDS, FILL_WINDOWS, GROUND_CLASS, GridSpec, ModelConfig, PreprocessOptions
from groundswell.operators import bands as B
from groundswell.operators import neighbours, tiling, validate
from groundswell.operators.focal import focal
from groundswell.operators.rasterize import fill_gaps, idw, rasterize_all
from groundswell.session import importable, written

STEPS = ["validate", "terrain", "heights", "canopy", "relief", "vegetation", "stack", "normalize"]


def preprocess(points: DataFrame, options: PreprocessOptions | None = None, crs: str | None = None, default_crs: str | None = None, progress: Callable[[int, str], bool] | None = None) -> tuple[DataFrame | None, GridSpec | None, list]:
    """(row, col, dtm, chm, mrm, vdi), the grid and the findings; (None, None, findings) where ``progress`` returns False.

    Points are read once and kept as a table in the shared folder; each step is a Spark job group of its name.
    """
    o = options or PreprocessOptions()
    importable(points.sparkSession)
    context = points.sparkSession.sparkContext

    def goes_on(k: int) -> bool:
        context.setJobGroup(STEPS[k], f"step {k + 1} of {len(STEPS)}", interruptOnCancel=True)
        return progress is None or progress(k, STEPS[k])

    if not goes_on(0):
        return None, None, []
    cloud = written(points.select("point_id", "x", "y", "z", "classification"), "points")
    findings = validate.validate(cloud, crs, default_crs, min_density=o.min_density, warn_density=o.warn_density)
    crs = validate.crs_of(crs, default_crs)[0]
    shared = GridSpec.from_points(cloud, o.res, crs_wkt=crs or "")
    own = o.grid_policy == "reference"
    spec = lambda df: GridSpec.from_points(df, o.res, crs_wkt=crs or "") if own else shared
    missing, nodata = 0.0, (0.0 if own and o.nodata is None else o.nodata)

    if not goes_on(1):
        return None, None, findings
    flagged = neighbours.flag_outliers(cloud, o.outlier_k, o.outlier_multiplier, o.noise_class, o.outlier_stddev)
    ground = written(flagged.where(F.col("classification") == GROUND_CLASS), "ground")
    dtm_grid = spec(ground)
    dtm = written(fill_gaps(rasterize_all(ground, dtm_grid, {"value": idw(F.col("z"))}, o.radius, o.binning), dtm_grid, FILL_WINDOWS["dtm"]), "dtm")

    if not goes_on(2):
        return None, None, findings
    tall = written(neighbours.height_above_ground(cloud, max_distance=o.hag_max_distance, extrapolate=o.hag_extrapolate), "heights")

    if not goes_on(3):
        return None, None, findings
    low_grid, high_grid = (spec(tall.where(F.col("hag") < o.low_height)), spec(tall.where(F.col("hag") <= o.high_height))) if own else (shared, shared)
    if own:
        count = lambda df, g: rasterize_all(df, g, {"value": F.count("*").cast("double")}, o.radius, o.binning)
        chm = rasterize_all(tall, shared, {"value": F.max("hag").cast("double")}, o.radius, o.binning)
        low, high = count(tall.where(F.col("hag") < o.low_height), low_grid), count(tall.where(F.col("hag") <= o.high_height), high_grid)
    else:  # one pass over the points' hits for all three
        values = {"chm": F.max("hag").cast("double"), "low": F.count_if(F.col("hag") < o.low_height).cast("double"), "high": F.count_if(F.col("hag") <= o.high_height).cast("double")}
        cells = written(rasterize_all(tall, shared, values, o.radius, o.binning), "canopy")
        chm, low, high = (cells.select("row", "col", F.col(c).alias("value")).where("value IS NOT NULL") for c in ("chm", "low", "high"))
    chm = fill_gaps(chm, shared, FILL_WINDOWS["chm"])
    if o.fill_counts:
        low, high = fill_gaps(low.where("value > 0"), low_grid, FILL_WINDOWS["low"]), fill_gaps(high.where("value > 0"), high_grid, FILL_WINDOWS["high"])
    dtm, chm, shape = B.align(dtm, chm, B.shape_of(dtm_grid), B.shape_of(shared), o.grid_policy)
    low, high, veg_shape = B.align(low, high, B.shape_of(low_grid), B.shape_of(high_grid), o.grid_policy)
    if shape != veg_shape:
        raise ValueError(f"terrain and vegetation rasters have different shapes: {shape} and {veg_shape}")
    grid = GridSpec(dtm_grid.x_min, dtm_grid.y_max - shape[0] * o.res, o.res, shape[1], shape[0], crs or "", 0.0)

    if not goes_on(4):
        return None, None, findings
    relief = B.relief(dtm, focal(dtm, grid, missing=missing), o.mrm_limit, missing)

    if not goes_on(5):
        return None, None, findings
    spots = grid.all_cells(cloud.sparkSession)
    sides = [df.select("row", "col", F.col("value").alias(n)) for df, n in ((low, "low"), (high, "high"))]
    both = spots.join(sides[0], ["row", "col"], "left").join(sides[1], ["row", "col"], "left")
    vdi = both.select("row", "col", vegetation_density(F.coalesce("low", F.lit(0.0)), F.coalesce("high", F.lit(0.0))).alias("value"))

    if not goes_on(6):
        return None, None, findings
    wide = written(B.stack({"dtm": dtm, "chm": chm, "mrm": relief, "vdi": vdi}), "stack")
    if not goes_on(7):
        return None, None, findings
    return B.normalize(wide, BANDS, nodata=nodata), grid, findings


def infer(raster: DataFrame, grid: GridSpec, model: Callable | bytes, config: ModelConfig | None = None, bands: list[str] | None = None, nodata: float | None = None, progress: Callable[[int, str], bool] | None = None) -> tuple[DataFrame | None, dict]:
    """The probability map (row, col, p) of a stacked raster, and the run's record; (None, record) where ``progress`` returns False.

    The map is a table; its making is a Spark job group, which can be cancelled.
    """
    c = config or ModelConfig()
    bands = bands or BANDS
    if raster is None:
        raise ValueError("no raster")
    if len(bands) != c.bands:
        raise ValueError(f"the model takes {c.bands} bands")
    if isinstance(model, bytes | bytearray):
        validate.need("onnxruntime")
    context = raster.sparkSession.sparkContext
    scene, record = None, {"prediction": False, "nodata_region": None}
    for k, step in enumerate(("segment", "predict")):
        context.setJobGroup(step, f"step {k + 1} of 2", interruptOnCancel=True)
        if progress is not None and not progress(k, step):
            return None, record | {"prediction": False}
        if k == 0:
            scene, record = tiling.segment(raster, grid, model, bands, c.tile, c.stride, c.augmentation, c.drop_border, nodata, batch_size=c.batch_size)
        elif scene is not None:
            scene = neighbours.settled(written(scene, "probability"))
    return scene, record


PIPELINES = {"preprocessing": preprocess, "inference": infer}
