"""Stage lists: a JSON list of reader, filter and writer stages becomes a chain of DataFrames.

A list may begin with a file name or a reader, and end with a writer; a writer with a file name writes the raster there. File names and
other options can be given over by stage type. ``packaged`` has the four lists of the first pipeline.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from groundswell.model import FILL_WINDOWS, GROUND_CLASS, HIGH_HEIGHT, IDW_POWER, LOW_HEIGHT, OUTLIER_K, OUTLIER_MULTIPLIER, RESOLUTION, GridSpec
from groundswell.operators import neighbours
from groundswell.operators.rasterize import fill_gaps, rasterize
from groundswell.session import written
from groundswell.sources import files
from groundswell.sources.points import merge, read_points
from groundswell.sources.raster import write_raster

# Fixed values of the format: dimension names and what they are here.
DIMENSIONS = {"Z": "z", "X": "x", "Y": "y", "Classification": "classification", "HeightAboveGround": "hag"}
COMPARE = {"==": "=", "=": "=", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "!=": "<>"}


def load(text_or_path: str) -> list[dict]:
    text = text_or_path if text_or_path.lstrip().startswith(("[", "{")) else files.read(text_or_path).decode()
    stages = json.loads(text)
    return stages.get("pipeline", stages) if isinstance(stages, dict) else stages


def predicate(expression: str) -> str:
    """A comparison of one dimension with a number, joined by && or ||, as SQL."""
    out = []
    for part in re.split(r"(&&|\|\|)", expression):
        if part in ("&&", "||"):
            out.append({"&&": "AND", "||": "OR"}[part])
            continue
        m = re.fullmatch(r"\s*\(?\s*(\w+)\s*(==|<=|>=|!=|<|>|=)\s*(-?[0-9.]+)\s*\)?\s*", part)
        if not m or m[1] not in DIMENSIONS:
            raise ValueError(f"can't read the expression {part!r}")
        out.append(f"{DIMENSIONS[m[1]]} {COMPARE[m[2]]} {m[3]}")
    return " ".join(out)


def packaged(name: str, resolution: float = RESOLUTION) -> list[dict]:
    """The stages behind a raster: "dtm", "chm", "low" or "high"; the file names are left to the caller."""
    heights = {"type": "filters.hag_nn"}
    writer = {"type": "writers.gdal", "resolution": resolution, "window_size": FILL_WINDOWS[name], "nodata": 0}
    above = writer | {"dimension": "HeightAboveGround"}
    chains = {
        "dtm": [{"type": "filters.outlier", "mean_k": OUTLIER_K, "multiplier": OUTLIER_MULTIPLIER}, {"type": "filters.expression", "expression": f"Classification == {GROUND_CLASS}"}, writer | {"output_type": "idw", "power": IDW_POWER, "dimension": "Z"}],
        "chm": [heights, above | {"output_type": "max"}],
        "low": [heights, {"type": "filters.expression", "expression": f"HeightAboveGround < {LOW_HEIGHT}"}, above | {"output_type": "count"}],
        "high": [heights, {"type": "filters.expression", "expression": f"HeightAboveGround <= {HIGH_HEIGHT}"}, above | {"output_type": "count"}],
    }
    return chains[name]


def run(points: DataFrame | None, stages: list, grid: GridSpec | None = None, resolution: float | None = None, spark: SparkSession | None = None, options: dict[str, dict] | None = None) -> tuple[DataFrame, GridSpec | None]:
    """The last stage's rows: points, or cells where it makes a raster (on ``grid``, or the extent of the points that reach it).

    ``points`` stand in for the readers; without them (and with ``spark``) these are run, several as one cloud. ``options``: by stage
    type, laid over the stage's own.
    """
    given, read = points is not None, []
    for stage in stages:
        stage = {"type": "readers.las", "filename": stage} if isinstance(stage, str) else stage
        kind = stage["type"]
        stage = stage | (options or {}).get(kind, {})
        if kind.startswith("readers"):
            if not given:
                fmt = {"readers.las": "las", "readers.parquet": "parquet"}.get(kind)
                if fmt is None or spark is None:
                    raise ValueError(f"no stage {kind}" if fmt is None else "a reader needs a session")
                read.append(read_points(spark, stage["filename"], fmt, default_crs="local")[0])
                points = merge(*read)
                if fmt == "parquet" and len(read) == 1:
                    points.lasting = True  # a table as it is: no copy of it is kept
            continue
        if points is None:
            raise ValueError("no points: give some, or a reader with a file name")
        if kind == "filters.outlier":
            points = neighbours.flag_outliers(points, int(stage.get("mean_k", 8)), float(stage.get("multiplier", 2.0)), int(stage.get("class", 7)))
        elif kind in ("filters.expression", "filters.range"):
            points = points.where(predicate(stage["expression"]))
        elif kind == "filters.hag_nn":
            points = neighbours.height_above_ground(points, max_distance=stage.get("max_distance"), extrapolate=stage.get("allow_extrapolation", True))
        elif kind == "writers.gdal":
            res = resolution or float(stage["resolution"])
            points = written(points, "stage")  # its extent, then its cells
            own = grid or GridSpec.from_points(points, res)
            how = stage.get("output_type", "idw")
            cells = rasterize(points, own, DIMENSIONS[stage.get("dimension", "Z")], how, float(stage.get("power", 1.0)), stage.get("radius"))
            window = int(stage.get("window_size", 0))
            cells = fill_gaps(cells, own, window) if window and how != "count" else cells
            if stage.get("filename"):
                fmt = stage.get("format") or ("geotiff" if stage["filename"].lower().endswith((".tif", ".tiff")) else "parquet")
                cells = written(cells, "raster")
                write_raster(cells, own, stage["filename"], fmt, [c for c in cells.columns if c not in ("row", "col")], float(stage.get("nodata", 0)))
            return cells, own
        else:
            raise ValueError(f"no stage {kind}")
    return points, grid
