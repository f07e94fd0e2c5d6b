"""Raster sources and sinks: cells as Parquet with the grid beside them, a GeoTIFF, or a mosaic of GeoTIFFs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundswell.model import GridSpec
from groundswell.session import importable
from groundswell.sources import files, geotiff

GRID = "x_min double, y_max double, res double, width int, height int, crs_wkt string, nodata double, bands array<string>"
BLOCK = 2048  # rows and columns of a mosaic's files
LIST = "mosaic.json"


def _dense(table: pa.Table, bands: list[str], rows: int, cols: int, nodata: float) -> np.ndarray:
    """(bands, rows, cols) of cells whose row and col are counted from the array's own corner."""
    data = np.full((len(bands), rows, cols), nodata, np.float32)
    r, c = table["row"].to_numpy(), table["col"].to_numpy()
    for k, b in enumerate(bands):
        v = table[b].cast(pa.float64()).to_numpy()
        data[k, r, c] = np.where(np.isnan(v), nodata, v)
    return data


def _write_tiff(cells: DataFrame, grid: GridSpec, path: str, bands: list[str]) -> None:
    """Executors make the strips; the driver puts them into the file one after the other."""
    high, width = geotiff.STRIP_ROWS, grid.width

    def strips(key, table):
        n = key[0].as_py()
        rows = min(high, grid.height - n * high)
        own = table.set_column(table.schema.get_field_index("row"), "row", pa.array(table["row"].to_numpy() - n * high))
        data = _dense(own, bands, rows, width, grid.nodata)
        return pa.table({"band": pa.array(range(len(bands)), pa.int32()), "strip": pa.array([n] * len(bands), pa.int32()), "data": pa.array([a.tobytes() for a in data], pa.binary())})

    made = cells.withColumn("strip", F.expr(f"cast(row div {high} as int)")).groupBy("strip").applyInArrow(strips, "band int, strip int, data binary")

    def parts() -> Iterator[bytes]:
        yield geotiff.head(len(bands), grid, bands)
        wanted = ((b, s) for b in range(len(bands)) for s in range(-(-grid.height // high)))
        empty = lambda s: np.full((min(high, grid.height - s * high), width), grid.nodata, "<f4").tobytes()
        for row in made.orderBy("band", "strip").toLocalIterator():
            for at in wanted:
                if at == (row["band"], row["strip"]):
                    yield bytes(row["data"])
                    break
                yield empty(at[1])
        for _, s in wanted:
            yield empty(s)

    files.write(path, parts())


def _write_mosaic(cells: DataFrame, grid: GridSpec, path: str, bands: list[str], block: int) -> None:
    """Each executor task writes a file a block; the driver writes the list of them."""

    def one(key, table):
        y, x = key[0].as_py(), key[1].as_py()
        rows, cols = min(block, grid.height - y * block), min(block, grid.width - x * block)
        own = table.set_column(table.schema.get_field_index("row"), "row", pa.array(table["row"].to_numpy() - y * block))
        own = own.set_column(own.schema.get_field_index("col"), "col", pa.array(own["col"].to_numpy() - x * block))
        spec = GridSpec(grid.x_min + x * block * grid.res, grid.y_max - (y * block + rows) * grid.res, grid.res, cols, rows, grid.crs_wkt, grid.nodata)
        name = f"block-{y}-{x}.tif"  # a task that is run again writes the same file
        files.write(f"{path}/{name}", [geotiff.encode(_dense(own, bands, rows, cols, grid.nodata), spec, bands)])
        return pa.table({"name": [name], "row": pa.array([y * block], pa.int32()), "col": pa.array([x * block], pa.int32())})

    at = [F.expr(f"cast({c} div {block} as int)").alias(n) for c, n in (("row", "by"), ("col", "bx"))]
    made = cells.select("row", "col", *bands, *at).groupBy("by", "bx").applyInArrow(one, "name string, row int, col int")
    blocks = [r.asDict() for r in made.orderBy("name").collect()]  # a row a file
    about = {k: v for k, v in grid.record().items()} | {"bands": bands, "files": blocks}
    files.write(f"{path}/{LIST}", [json.dumps(about).encode()])


def write_raster(cells: DataFrame, grid: GridSpec, path: str, fmt: str = "parquet", band_names: list[str] | None = None, nodata: float = 0.0, block: int = BLOCK) -> str:
    """Cells (row, col, a column a band) as "parquet", one "geotiff" under 4 GB, or a "mosaic" of them with a list."""
    bands = band_names or [c for c in cells.columns if c not in ("row", "col")]
    importable(cells.sparkSession)
    spec = GridSpec(**{**{k: v for k, v in grid.record().items() if k != "y_max"}, "nodata": nodata})
    chosen = cells.select(F.col("row").cast("int"), F.col("col").cast("int"), *bands)
    if fmt == "parquet":
        chosen.write.parquet(f"{path}/cells")
        r = spec.record()
        one = [(float(r["x_min"]), float(r["y_max"]), float(r["res"]), r["width"], r["height"], r["crs_wkt"], float(nodata), bands)]
        cells.sparkSession.createDataFrame(one, GRID).write.json(f"{path}/grid")
    elif fmt == "geotiff":
        _write_tiff(chosen, spec, path, bands)
    elif fmt == "mosaic":
        _write_mosaic(chosen, spec, path, bands, block)
    else:
        raise ValueError(f"no raster format {fmt}")
    return path


def read_raster(spark: SparkSession, path: str, fmt: str = "parquet", rows_at_once: int = 256) -> tuple[DataFrame, GridSpec]:
    """(row, col, a column a band) without missing cells turned to rows, and the grid. Of TIFF files a task reads some rows' strips."""
    importable(spark)
    if fmt == "parquet":
        r = spark.read.schema(GRID).json(f"{path}/grid").first()
        spec = GridSpec(r["x_min"], r["y_max"] - r["height"] * r["res"], r["res"], r["width"], r["height"], r["crs_wkt"] or "", r["nodata"])
        return spark.read.parquet(f"{path}/cells"), spec
    if fmt == "mosaic":
        about = json.loads(files.read(f"{path}/{LIST}"))
        spec = GridSpec(about["x_min"], about["y_min"], about["res"], about["width"], about["height"], about["crs_wkt"], about["nodata"])
        names, parts = about["bands"], [(f"{path}/{f['name']}", f["row"], f["col"]) for f in about["files"]]
        height = max([min(spec.height - top, BLOCK * 8) for _, top, _ in parts] or [0])
    else:
        found = geotiff.directory(lambda offset, size: files.read(path, offset, size))
        spec, names, parts, height = found.grid, found.names or [f"band{k + 1}" for k in range(found.bands)], [(path, 0, 0)], found.grid.height
    jobs = [(name, top, left, first) for name, top, left in parts for first in range(0, height, rows_at_once)]

    def cells(batches):
        for batch in batches:
            for name, top, left, first in zip(*(c.to_pylist() for c in batch.columns)):
                get = lambda offset, size: files.read(name, offset, size)  # noqa: E731, B023
                about = geotiff.directory(get)
                last = min(first + rows_at_once, about.grid.height)
                for k in range(first // about.rows_per_strip, -(-last // about.rows_per_strip)) if first < last else ():
                    a, begin = geotiff.strip(about, k, get), k * about.rows_per_strip
                    a = a[:, max(0, first - begin) : last - begin]
                    r, c = np.nonzero((a != about.grid.nodata).any(axis=0))
                    cols = [pa.array(np.where(p[r, c] == about.grid.nodata, np.nan, p[r, c]).astype(np.float64), from_pandas=True) for p in a]
                    yield pa.RecordBatch.from_arrays([pa.array(r + max(first, begin) + top, pa.int32()), pa.array(c + left, pa.int32()), *cols], names=["row", "col", *names])

    listed = spark.createDataFrame(jobs, "path string, top int, left int, first int")
    return listed.repartition(max(1, len(jobs))).mapInArrow(cells, "row int, col int, " + ", ".join(f"`{n}` double" for n in names)), spec
