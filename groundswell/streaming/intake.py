"""Point clouds that arrive as files: each micro-batch of new Parquet or LAS files goes through a function, such as a pipeline."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from groundswell.model import POINTS
from groundswell.session import importable
from groundswell.sources import las


def watch(spark: SparkSession, folder: str, handle: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int = 16, once: bool = False, fmt: str = "parquet") -> StreamingQuery:
    """Start a stream over new point files, Parquet or LAS; ``handle`` gets a batch and its number, and must be safe to repeat for a number."""
    if fmt == "las":
        importable(spark)
        arrivals = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.la[sz]").option("maxFilesPerTrigger", files_per_batch)
        stream = arrivals.load(folder).select("path").mapInArrow(_points, POINTS)
    else:
        stream = spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The points of LAS files by path; a file's ids begin at 2^32 times its path's checksum (31 bits)."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            head = las.header(path)
            yield from las.batches(path, head, 0, head.count, (zlib.crc32(path.encode()) >> 1) << 32)
