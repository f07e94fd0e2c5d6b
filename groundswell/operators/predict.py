"""Model calls on tiles: any function of arrays, or an ONNX file with a session a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.session import importable
from groundswell.sources import files

_SESSIONS: dict = {}


def load_model(path: str) -> bytes:
    """An ONNX file's bytes; they travel with the tasks."""
    return files.read(path)


def _session(model: bytes, providers: list[str]):
    key = hash(model), tuple(providers)
    if key not in _SESSIONS:
        import onnxruntime as ort

        options = ort.SessionOptions()
        options.intra_op_num_threads = 1
        _SESSIONS[key] = ort.InferenceSession(model, options, providers=providers)
    return _SESSIONS[key]


def caller(model: Callable | bytes, batch_size: int = 1, providers: list[str] | None = None) -> Callable[[np.ndarray], np.ndarray]:
    """A function from (N, bands, tile, tile) float32 to the model's first output, at most ``batch_size`` tiles a call."""

    def call(batch: np.ndarray) -> np.ndarray:
        run = model
        if isinstance(model, bytes | bytearray):
            session = _session(bytes(model), providers or ["CPUExecutionProvider"])
            name = session.get_inputs()[0].name
            run = lambda a: session.run(None, {name: a.astype(np.float32)})[0]
        return np.concatenate([np.asarray(run(batch[k : k + batch_size].astype(np.float32)), np.float32) for k in range(0, len(batch), batch_size)])

    return call


def predict(tiles: DataFrame, model: Callable | bytes, bands: int, tile: int, batch_size: int = 1, providers: list[str] | None = None, data: str = "data") -> DataFrame:
    """Tiles with their array replaced by the model's: arrays of bands * tile * tile numbers to out * out."""
    importable(tiles.sparkSession)
    call, keys = caller(model, batch_size, providers), [c for c in tiles.columns if c != data]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, max(1, batch_size)):
                part = batch.slice(k, max(1, batch_size))
                a = part.column(data).flatten().to_numpy().reshape(part.num_rows, bands, tile, tile)
                p = call(a).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keys), pa.array(list(p), pa.list_(pa.float32()))], names=[*keys, data])

    schema = tiles.select(*keys, F.col(data).cast("array<float>").alias(data)).schema
    return tiles.select(*keys, F.col(data).cast("array<float>").alias(data)).mapInArrow(run, schema)
