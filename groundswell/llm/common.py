"""Pieces that several operators use: reading documents, slicing Arrow batches by bytes, word splitting, prefix sums."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from groundswell.session import importable

#: White space of the word contracts: space and the controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SLICE_BYTES = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hold_splits(spark: SparkSession) -> None:
    """For operators that number rows by input split in two scans: splits mustn't follow the number of executors, which may change."""
    key = "spark.sql.files.minPartitionNum"
    if not spark.conf.get(key, None):
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer form that no column of ``df`` has (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in pieces of about ``most`` bytes of ``column``; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
        give_back()


def gathered(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, batches put together and cut so that pieces have about ``most`` bytes of ``column``."""
    held, size = [], 0
    for part in slices(batches, column, most):
        n = pc.sum(pc.binary_length(part.column(column))).as_py() or 0
        if held and size + n > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(part)
        size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between stages, beside those of later ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def texts_of(batch: pa.RecordBatch | pa.Table, column: str = "text") -> pa.Array:
    texts = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text: codes of all words in order, the distinct words, and the offsets of each text's words."""
    if lower:
        texts = ascii_lower(texts)
    for space in SPACES[1:]:
        texts = pc.replace_substring(texts, space, " ")
    lists = pc.split_pattern(texts, " ")
    words, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    coded = words.dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), coded.dictionary
    empty = pc.index(names, "").as_py()
    if empty >= 0:  # runs of spaces, and texts without words
        keep = codes != empty
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, names, offsets


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def ascii_lower(texts: pa.Array) -> pa.Array:
    """Lower-case A-Z only, on the bytes: no byte of a longer UTF-8 sequence is in that range."""
    kind = texts.type
    texts = texts.cast(pa.large_string())
    _, ends, data = texts.buffers()
    if data is None or not len(texts):
        return texts.cast(kind)
    raw = np.frombuffer(data, np.uint8)
    low = _LOWER[raw]
    made = pa.Array.from_buffers(pa.large_string(), len(texts), [texts.buffers()[0], ends, pa.py_buffer(low)], texts.null_count, texts.offset)
    return made.cast(kind)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's); a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(w) for w in names.to_pylist()), dtype=np.uint64, count=len(names))


def salt_bits(rows: int, per_bucket: int = 4096) -> int:
    """Bits of a hash that cut ``rows`` into buckets of about ``per_bucket``: follows the input, so no bucket grows."""
    return min(40, max(0, math.ceil(math.log2(max(1, rows) / per_bucket))))


def running_sum(df: DataFrame, group: str, bucket: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` within ``group`` by (bucket, order), in two levels.

    One window inside each (group, bucket) and one over the buckets' totals, so that no task holds a whole group.
    """
    b, t, inner, outer = "rs_bucket", "rs_total", "rs_inner", "rs_outer"
    rows = df.withColumn(b, bucket)
    w = Window.partitionBy(group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn(inner, F.coalesce(F.sum(value).over(w), F.lit(0)))
    over = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(group, b).agg(F.sum(value).alias(t)).withColumn(outer, F.coalesce(F.sum(t).over(over), F.lit(0))).drop(t)
    return inside.join(totals, [group, b]).withColumn(out, F.col(inner) + F.col(outer)).drop(b, inner, outer)
