"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its shingles of ``words`` words, by their 64-bit hashes (terms), with their counts. For each of
``samples`` draws a term of weight w has r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1), fixed by term and draw; with
t = floor(ln w / r + b) and y = exp(r (t - b)) its rank is a = c / (y exp(r)), and the least rank of the text is its sample
(Ioffe's scheme). Two texts agree in a sample with probability sum min(w) / sum max(w), the generalised Jaccard
similarity; a rank stands for its (term, t), so a fingerprint is ``samples`` 16-bit hashes of least ranks in hexadecimal.

Each text is fingerprinted in one pass without a shuffle. Ranks are drawn when a term is met at a weight; a worker keeps those last
met in ``1 << width`` slots (``samples`` floats each, 64 MB as set), keyed by the whole hash, which changes no result.

Cases: null counts as empty; empty and wordless texts have the fingerprint of zeros, alike only to each other; fewer words
than a shingle are one term; long texts are used whole; equal texts have equal fingerprints anywhere; repeated rows
each give a row; an empty table gives no rows; other columns are ignored. With the next document: order is by id, null
ids first, ties by the text's hash; a document alone is its own next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, split_words, word_hashes

SEED = np.uint64(0x51ED270B7A1F3C2D)
STEP = np.uint64(0x9E3779B97F4A7C15)
_KEPT: dict = {}


def _draws(term: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, c and b of each term, a row a term: 24 bits for each uniform from two words of the stream that the term starts."""
    base = (term.astype(np.uint64) ^ SEED)[:, None] + np.arange(2, 2 * samples + 2, 2, dtype=np.uint64)[None, :] * STEP
    x, y = mix64(base), mix64(base + STEP)
    low, u24 = np.uint64((1 << 24) - 1), lambda v: (v.astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)
    unit = [u24(v) for v in (x >> np.uint64(40), (x >> np.uint64(16)) & low, y >> np.uint64(40), (y >> np.uint64(16)) & low, ((x & np.uint64(0xFFFF)) << np.uint64(8)) | (y & np.uint64(0xFF)))]
    return -np.log(unit[0] * unit[1]), -np.log(unit[2] * unit[3]), unit[4]


def ranks(term: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """Ranks of terms at their weights, a row a term."""
    r, c, b = _draws(term, samples)
    t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
    return c * np.exp(r * (b - t - np.float32(1)))


def _kept(samples: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A worker's slots: which are used, their keys, their ranks."""
    if (samples, width) not in _KEPT:
        _KEPT[samples, width] = np.zeros(1 << width, bool), np.zeros(1 << width, np.uint64), np.empty((1 << width, samples), np.float32)
    return _KEPT[samples, width]


def _least(text: np.ndarray, term: np.ndarray, weight: np.ndarray, rows: int, samples: int, width: int) -> np.ndarray:
    """The least ranks of each text (ascending), a bounded block of terms at a time."""
    out = np.full((rows, samples), np.inf, np.float32)
    used, keys, table = _kept(samples, width)
    key = np.where(weight == 1, term, mix64(term + STEP * weight.astype(np.uint64)))
    block = max(1, (1 << 21) // samples)
    for a in range(0, len(text), block):
        own, slot = key[a : a + block], (key[a : a + block] >> np.uint64(64 - width)).astype(np.int64)
        new = np.flatnonzero(~used[slot] | (keys[slot] != own))
        values = table[slot]
        if len(new):
            _, first, which = np.unique(own[new], return_index=True, return_inverse=True)
            first = new[first]
            drawn = np.concatenate([ranks(term[a + first[k : k + 1024]], weight[a + first[k : k + 1024]], samples) for k in range(0, len(first), 1024)])
            values[new] = drawn[which]
            to, one = np.unique(slot[first], return_index=True)
            used[to], keys[to], table[to] = True, own[first[one]], drawn[one]
        here = text[a : a + block]
        start = np.flatnonzero(np.diff(here, prepend=-1))
        who = here[start]
        out[who] = np.minimum(out[who], np.minimum.reduceat(values, start, axis=0))
    return out


def fingerprint(texts: pa.Array, words: int, samples: int, width: int) -> np.ndarray:
    """16-bit symbols, a row a text; zeros without words."""
    codes, names, offsets = split_words(texts)
    flat = mix64(word_hashes(names))[codes] if len(names) else np.empty(0, np.uint64)
    sizes = np.diff(offsets)
    number = np.where(sizes >= words, sizes - words + 1, np.minimum(sizes, 1))
    run = np.zeros(len(flat), np.uint64)
    length = np.repeat(np.minimum(sizes, words), sizes)
    for k in range(words):  # shingles of fewer words only where the text has no more
        run = np.where(k < length, run * np.uint64(0x9E3779B97F4A7C15) + flat[np.minimum(np.arange(len(flat)) + k, max(0, len(flat) - 1))], run)
    text = np.repeat(np.arange(len(sizes)), number)
    place = np.repeat(offsets[:-1] - (np.cumsum(number) - number), number) + np.arange(len(text))
    coded = pa.array(mix64(run[place])).dictionary_encode()
    terms, deep = coded.dictionary.to_numpy(), max(1, len(coded.dictionary).bit_length())
    key = np.sort((text << deep) | coded.indices.to_numpy().astype(np.int64))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    weight = np.diff(np.append(first, len(key)))
    out = _least(key[first] >> deep, terms[key[first] & ((1 << deep) - 1)], weight, len(sizes), samples, width)
    marks = mix64(out.view(np.uint32).astype(np.uint64)).astype(np.uint16)
    marks[number == 0] = 0
    return marks


def _hex(marks: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in marks.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal symbols; a text without words is like such texts only."""
    none = ~a.any(axis=1), ~b.any(axis=1)
    return np.where(none[0] | none[1], (none[0] & none[1]).astype(float), (a == b).mean(axis=1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, samples: int = 64, width: int = 18) -> DataFrame:
    """One row a document: doc_id, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            marks = fingerprint(part.column("text").cast(pa.large_string()), words, samples, width)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_hex(marks))], names=["doc_id", "fingerprint"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(words: int, samples: int, width: int):
    """Rows by (bucket, last, id, print): a row's next is the row that follows; a bucket's row ``last`` only ends it."""

    def made(rows: list[tuple], ending: tuple) -> pa.RecordBatch:
        texts = [t for _, t in rows]
        after = [*texts[1:], ending[1]]
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + n[:h] for t, n, h in zip(texts, after, halves)]
        both = [t for pair in zip(texts, edited) for t in pair]  # side by side: they share most of their terms
        marks = fingerprint(pa.array([*both, ending[1]], pa.large_string()), words, samples, width)
        own, new = marks[::2], marks[1::2]
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in rows], pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(_hex(own[:-1])), pa.array(_hex(new)), pa.array(likeness(own[:-1], new)), pa.array(likeness(own[:-1], own[1:])),
        ], names=[x.split()[0] for x in EDITED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in slices(batches, most=2 << 20):
            for i, text, last in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "last"))):
                if last:
                    if held:
                        yield made(held, (i, text))
                    held = []
                else:
                    held.append((i, text))
            if len(held) > 1:
                yield made(held[:-1], held[-1])
                held = held[-1:]
        if held:
            raise ValueError("a bucket without an end")

    return run


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, samples: int = 64, width: int = 18, per_bucket: int = 4096) -> DataFrame:
    """One row a document, with its text's last half replaced by the first half as long of the next document.

    Documents are cut into ranges of ids at quantiles (about ``per_bucket`` rows; the driver sees an id a range), sorted there, and
    a range's end gets the first text of the next one: a text is shuffled once, a task sorts its ranges (on disk where they are long) and holds a slice.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    rows = base.count()
    ranges = min(2048, max(1, -(-rows // per_bucket)))  # more rows make longer ranges: a task streams through its range
    edges = sorted(set(base.select("doc_id").where("doc_id IS NOT NULL").approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    cut = [int(e) for e in edges]
    where = F.col("doc_id").cast("long")
    # A binary search in the ranges' first ids; null ids are before all.
    bucket = F.when(where.isNull(), F.lit(0)).otherwise(_search(where, cut))
    dealt = base.withColumn("bucket", bucket.cast("int"))
    order = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", F.xxhash64("text").alias("print"))
    firsts = dealt.groupBy("bucket").agg(F.min_by("text", order).alias("text"), F.min_by("doc_id", order).alias("doc_id"))
    found = sorted((r["bucket"] for r in firsts.select("bucket").collect()))
    before = {b: found[k - 1] for k, b in enumerate(found)}  # the first range follows the last
    turn = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("bucket")) if before else F.col("bucket")
    ends = firsts.select("doc_id", "text", turn.cast("int").alias("bucket"), F.lit(True).alias("last"))
    rows_ = dealt.withColumn("last", F.lit(False)).unionByName(ends)
    rows_ = rows_.repartition("bucket").sortWithinPartitions("bucket", "last", "doc_id", F.xxhash64("text"))
    return rows_.select("doc_id", "text", "last").mapInArrow(_edit(words, samples, width), EDITED)


def _search(value, cut: list[int]):
    """How many of the ascending ``cut`` are at most ``value``, by nested halving."""
    if not cut:
        return F.lit(0)

    def half(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < cut[mid], half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(cut))
