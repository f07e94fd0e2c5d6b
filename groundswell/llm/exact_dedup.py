"""Exact duplicates by an extendible-hash index on shared files.

1. A scan counts the hashes' leading bits (at most 2^``max_depth`` counters reach the driver). The directory starts with
   one bucket and doubles as long as a bucket holds more than ``capacity`` entries and its local depth is below ``max_depth``.
2. Each slice of input is combined first: equal texts, compared by their bytes, become one entry (hash, text, largest id,
   count), so a text that a third of all rows share is an entry a slice, not a row each.
3. Entries go to the owner of their bucket. An owner reads its buckets in hash order, chains entries of one hash and
   compares their bytes, so texts whose hashes collide stay apart; a chain is as long as the number of different texts with
   one 64-bit hash. Its index rows (bucket, hash, digest of the text, id kept, group size) are files in the shared
   folder, in place of the texts.
4. Every document looks up its hash and digest in the index. The join may be split where a text is hot.

A lost executor costs a rerun of its owner tasks or of the scan; the index is committed as a whole by Spark's writer.

Cases: null text counts as empty; all empty texts are one group; rows with a null id count in their group, and a group with
null ids only keeps a null id; repeated rows each give a row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.session import written

from .common import salt_bits, slices, texts_of, unused

ENTRY = "hash long, text string, keep_id long, n long"
INDEX = "bucket int, hash long, text_sha256 string, keep_id long, group_size long, chain int"


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a slice, by bytes: one entry with the largest id and the count."""
    for part in slices(batches):
        table = pa.table({"hash": part.column("hash"), "text": texts_of(part), "keep_id": part.column("doc_id"), "n": pa.repeat(1, part.num_rows)})
        made = table.group_by(["hash", "text"]).aggregate([("keep_id", "max"), ("n", "sum")])
        yield from pa.table([made["hash"], made["text"].cast(pa.string()), made["keep_id_max"], made["n_sum"]], names=["hash", "text", "keep_id", "n"]).combine_chunks().to_batches()


def directory(counts: dict[int, int], capacity: int, max_depth: int) -> list[tuple[int, int, int]]:
    """Buckets (prefix, local depth, entries) after doubling, in key order."""
    done, todo = [], [(0, 0, sum(counts.values()), sorted(counts))]
    while todo:
        prefix, depth, n, keys = todo.pop()
        if n <= capacity or depth == max_depth:
            done.append((prefix, depth, n))
            continue
        shift = max_depth - depth - 1
        for bit in (1, 0):  # the lower half is taken up next
            half = [k for k in keys if (k >> shift) & 1 == bit]
            todo.append((prefix * 2 + bit, depth + 1, sum(counts[k] for k in half), half))
    return done


def _owner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket and hash; the entries of one hash are held as a chain of different texts."""
    import hashlib

    rows: list[tuple] = []
    at, chain = None, []

    def close():
        for k, (text, keep, n) in enumerate(chain):
            rows.append((at[0], at[1], hashlib.sha256(text).hexdigest(), keep, n, k))

    def out():
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    for part in slices(batches):
        texts = part.column("text").cast(pa.large_string()).cast(pa.large_binary())
        ids, counts = part.column("keep_id").to_pylist(), part.column("n").to_pylist()
        keys = zip(part.column("bucket").to_pylist(), part.column("hash").to_pylist())
        for key, text, i, n in zip(keys, texts, ids, counts):
            if key != at:
                if at is not None:
                    close()
                at, chain = key, []
            own = text.as_py()
            for entry in chain:
                if entry[0] == own:
                    entry[1] = i if entry[1] is None else entry[1] if i is None else max(entry[1], i)
                    entry[2] += n
                    break
            else:
                chain.append([own, i, n])
        if len(rows) > 20_000:
            yield out()
            rows = []
    if at is not None:
        close()
    if rows:
        yield out()


def build_index(docs: DataFrame, capacity: int = 2_000, max_depth: int = 20) -> DataFrame:
    """The index over ``docs`` (doc_id, text, hash), written to the shared folder: a row a different text."""
    spark = docs.sparkSession
    deepest = min(max_depth, salt_bits(docs.count(), capacity) + 4)  # 16 counters a bucket let the directory follow the hashes
    lead = lambda bits: (F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0)).cast("int")
    counts = {r[0]: r[1] for r in docs.groupBy(lead(deepest).alias("lead")).count().collect()}  # at most 2^max_depth rows
    buckets = directory(counts, capacity, deepest)
    depth = max(d for _, d, _ in buckets)
    cells = [(cell, k) for k, (prefix, d, _) in enumerate(buckets) for cell in range(prefix << (depth - d), (prefix + 1) << (depth - d))]
    table = F.broadcast(spark.createDataFrame(cells, "lead int, bucket int"))  # the directory: at most 2^max_depth rows
    entries = docs.mapInArrow(_combine, ENTRY).withColumn("lead", lead(depth)).join(table, "lead")
    owned = entries.repartition("bucket").sortWithinPartitions("bucket", "hash")
    return written(owned.select("bucket", "hash", "text", "keep_id", "n").mapInArrow(_owner, INDEX), "exact-index")


def find_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=None, **options) -> DataFrame:
    """One row a document: doc_id, keep_id (largest id of its group), group_size, kept, text_sha256.

    ``hashed``: a column function for the 64-bit hash of a text, xxhash64 if none (tests force collisions with it).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    base = base.withColumn("hash", (hashed or F.xxhash64)("text"))
    index = build_index(base, **options).select(F.col("hash").alias("h"), F.col("text_sha256").alias("s"), "keep_id", "group_size")
    asked = base.select("doc_id", "hash", F.sha2("text", 256).alias("text_sha256"))
    found = asked.join(index, (F.col("hash") == F.col("h")) & (F.col("text_sha256") == F.col("s")), "left")
    return found.select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts one row.

    Of rows that share the kept id and text one stays; where all ids are null one of them stays.
    """
    key, digest = unused(docs, "kept_id"), unused(docs, "kept_sha")
    found = find_duplicates(docs, id_col, text_col, **options).select(F.col("keep_id").alias(key), F.col("text_sha256").alias(digest)).distinct()
    text = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    marked = docs.withColumn(digest, text).join(found, [digest]).where(F.col(id_col).cast("long").eqNullSafe(F.col(key)))
    return marked.dropDuplicates([digest]).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       coalesce(doc_id = max(doc_id) OVER g, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
