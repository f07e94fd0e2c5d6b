"""Removal of repeated byte strings by blockwise sorting of suffixes with a difference cover.

Every string of ``length`` bytes that starts at two places or more (of any documents) goes. The suffixes that matter are
found and sorted without holding all of them:

1. A difference cover D modulo v (v = q^2 + q + 1 for a prime q, |D| = q + 1: each difference modulo v once, after Singer) picks
   the sample: positions p of a document with p mod v in D, about 1/q of all. Two equal strings of ``length`` bytes at i and j
   have some d < v with i + d and j + d both in the sample, so their sample windows of length + 1 - v bytes are equal.
2. Cover-sample ranks: sample windows are named by fingerprint and sorted bucket by bucket; a window that is met
   once has no rank. A suffix that has no ranked window at its first v places differs from every other within ``length``
   bytes, and no long comparison is needed.
3. The suffixes left are sorted by the fingerprint of their first ``length`` bytes, one bucket of fingerprints a task at a
   time; equal neighbours are repeated strings.

The same is done over words for passages: strings of ``passage`` words that another document has too. These are counted beside
the bytes and remove nothing, since a passage may be shorter than ``length`` bytes. Both units share their chunks and jobs.

Buckets are cut by leading fingerprint bits, their number follows the input. A map task sends each bucket one array of
64-bit fingerprints (a value that it has several times goes once, marked) and gets back a bit an entry, so a string that a
third of all documents share is an entry a task, and what is shuffled is at most 8 bytes a sample window or suffix left.
Equal documents are merged first, by bytes, with their count. Order within a bucket is by fingerprint, not by the
alphabet: only equality matters here. Fingerprints are 64-bit polynomials; two different strings out of n share one with
probability n^2 / 2^65.

Cases: null and empty texts have no bytes; texts shorter than ``length`` keep all; overlapping repeats, also within one
document, count; equal documents of ``length`` bytes or more lose all; a passage that one document alone repeats is
none, and equal documents of ``passage`` words or more are passages as a whole; repeated rows each give a row; null ids pass
through; removing bytes may cut UTF-8 sequences, so what is kept is bytes; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, salt_bits, slices, split_words, texts_of, word_hashes

CHUNK_BYTES = 4 << 20
BUCKET_ENTRIES = 1 << 20
BYTES, WORDS = 0, 1  # units
STRIDE = 1 << 19  # positions that are fingerprinted at once


def difference_cover(q: int) -> np.ndarray:
    """Singer's perfect difference set modulo q^2 + q + 1, for a prime q: the logarithms of a line of PG(2, q)."""
    v = q * q + q + 1
    for c in range(q**3):  # x^3 = a + b x + e x^2, until x is primitive enough
        a, b, e = c % q, c // q % q, c // (q * q)
        if not a:
            continue
        x, seen, found = (1, 0, 0), set(), []
        for k in range(v):
            lead = next(y for y in reversed(x) if y)
            point = tuple(y * pow(lead, -1, q) % q for y in x)
            if point in seen:
                break
            seen.add(point)
            if x[2] == 0:
                found.append(k)
            x = (x[2] * a % q, (x[0] + x[2] * b) % q, (x[1] + x[2] * e) % q)
        else:
            return np.array(found)
    raise ValueError(f"no difference cover for {q}")


_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64, and a random 64-bit word a byte value."""
    if not _POWERS:
        base = 0x9E3779B97F4A7C15
        n = STRIDE + 4096
        for b in (base, pow(base, -1, 1 << 64)):
            with np.errstate(over="ignore"):
                _POWERS.append(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]))
        _POWERS.append(np.random.default_rng(20_041).integers(0, 2**64, 256, dtype=np.uint64))
    return tuple(_POWERS)


def fingerprints(data: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Of the ``length`` symbols at each of the ascending places ``at``; all lie within ``data`` (bytes, or hashes of words)."""
    up, down, word = _powers()
    out = np.empty(len(at), np.uint64)
    for a in range(0, len(data), STRIDE):
        lo, hi = np.searchsorted(at, [a, a + STRIDE])
        if lo == hi:
            continue
        part = data[a : a + STRIDE + length]
        part = word[part] if data.dtype == np.uint8 else part
        sums = np.concatenate([[np.uint64(0)], np.cumsum(part * down[: len(part)])])
        p = at[lo:hi] - a
        out[lo:hi] = (sums[p + length] - sums[p]) * up[p]
    return mix64(out)


def sample_places(sizes: np.ndarray, starts: np.ndarray, cover: np.ndarray, v: int, window: int) -> np.ndarray:
    """Places in the chunk of all sample windows that lie within their documents."""
    longest = int(sizes.max(initial=0))
    pattern = (np.arange(0, longest + v, v)[:, None] + cover[None, :]).ravel()
    counts = np.searchsorted(pattern, sizes - window, side="right")
    return np.concatenate([s + pattern[:n] for s, n in zip(starts.tolist(), counts.tolist())] or [np.empty(0, np.int64)]).astype(np.int64)


def left_suffixes(sizes: np.ndarray, starts: np.ndarray, places: np.ndarray, tied: np.ndarray, v: int, length: int) -> np.ndarray:
    """Places of the suffixes of ``length`` bytes or more that have a tied sample window at one of their first ``v`` places."""
    n = int(sizes.sum())
    near = np.zeros(n + 1, np.int32)
    hits = places[tied]
    np.add.at(near, np.maximum(hits - v + 1, 0), 1)
    np.add.at(near, hits + 1, -1)
    within = np.zeros(n + 1, np.int32)
    enough = sizes >= length
    within[starts[enough]] += 1
    np.add.at(within, starts[enough] + sizes[enough] - length + 1, -1)
    return np.flatnonzero((np.cumsum(near[:-1]) > 0) & (np.cumsum(within[:-1]) > 0))


def _pack(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte by byte of all: the leading bytes are zeros that compression takes away."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(8, -1).T).view("<u8").ravel(), dtype=np.uint64)


def _blobs(chunk: int, print_: np.ndarray, bits: int, unit: int, text: np.ndarray | None) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """(unit, bucket, chunk, distinct fingerprints ascending, a bit each: met several times in this chunk).

    With ``text`` (each fingerprint's), several times means in several texts.
    """
    if text is not None:
        order = np.lexsort((text, print_))
        print_, text = print_[order], text[order]
        once = np.concatenate([[True], (print_[1:] != print_[:-1]) | (text[1:] != text[:-1])]) if len(print_) else np.empty(0, bool)
        print_ = print_[once]
    values, n = np.unique(print_, return_counts=True)
    bucket = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(values) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield unit, int(bucket[a]), chunk, _pack(values[a:b]), np.packbits(n[a:b] > 1).tobytes()


BLOB = pa.schema([("unit", pa.int32()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("prints", pa.binary()), ("several", pa.binary())])
MARK = pa.schema([("unit", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int64()), ("tied", pa.binary())])
BLOBS, MARKS = "unit int, bucket long, chunk long, prints binary, several binary", "unit int, chunk long, bucket long, tied binary"


def _chunk_of(table: pa.Table) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's distinct texts in the order of their bytes (so the same each time), with counts, bytes, sizes and starts."""
    made = table.select(["text", "n"]).group_by("text").aggregate([("n", "sum")])
    rows = sorted(zip((t.as_py() for t in made["text"].combine_chunks()), made["n_sum"].to_pylist()))
    texts, counts = [t for t, _ in rows], [n for _, n in rows]
    sizes = np.array([len(t) for t in texts], np.int64)
    return texts, counts, np.frombuffer(b"".join(texts), np.uint8), sizes, np.cumsum(sizes) - sizes


def _words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, each text's number of them and their starts."""
    codes, names, offsets = split_words(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
    flat = mix64(word_hashes(names))[codes] if len(names) else np.empty(0, np.uint64)
    return flat, np.diff(offsets), offsets[:-1]


class Plan:
    """The parameters of a run over one unit; it travels to the workers."""

    def __init__(self, unit: int, length: int, q: int, sample_bits: int, suffix_bits: int):
        self.unit, self.length, self.v = unit, length, q * q + q + 1
        self.cover, self.window = difference_cover(q), length + 1 - self.v
        self.sample_bits, self.suffix_bits = sample_bits, suffix_bits
        if self.window < 1:
            raise ValueError(f"a cover modulo {self.v} needs strings of at least as many symbols")

    def sample(self, data, sizes, starts) -> tuple[np.ndarray, np.ndarray]:
        places = sample_places(sizes, starts, self.cover, self.v, self.window)
        return places, fingerprints(data, places, self.window)

    def suffixes(self, data, sizes, starts, ranks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        places, names = self.sample(data, sizes, starts)
        left = left_suffixes(sizes, starts, places, _tied(names, ranks, self.unit), self.v, self.length)
        return left, fingerprints(data, left, self.length)

    def blobs(self, chunk: int, found: tuple[np.ndarray, np.ndarray], starts: np.ndarray, bits: int) -> list[dict]:
        places, names = found
        text = np.searchsorted(starts, places, side="right") if self.unit == WORDS else None
        return [dict(zip(BLOB.names, r)) for r in _blobs(chunk, names, bits, self.unit, text)]

    def covered(self, data, sizes, starts, ranks: pa.Table, answers: pa.Table) -> np.ndarray:
        """For each symbol whether a repeated string covers it."""
        left, names = self.suffixes(data, sizes, starts, ranks)
        hit = left[_tied(names, answers, self.unit)]
        change = np.zeros(len(data) + 1, np.int64)
        change[hit] += 1
        change[hit + self.length] -= 1  # no place twice
        return np.cumsum(change[:-1]) > 0


def _tied(prints: np.ndarray, marks: pa.Table, unit: int) -> np.ndarray:
    """For each fingerprint whether it is met elsewhere, from the buckets' answers."""
    values, inverse = np.unique(prints, return_inverse=True)
    marks = marks.filter(pc.equal(marks["unit"], unit))
    got = sorted(zip(marks["bucket"].to_pylist(), marks["tied"].to_pylist()))
    parts = []
    for _, packed in got:
        n = int.from_bytes(packed[:4], "little")
        parts.append(np.unpackbits(np.frombuffer(packed, np.uint8, offset=4), count=n).astype(bool))
    flags = np.concatenate(parts) if parts else np.empty(0, bool)
    if len(flags) != len(values):
        raise ValueError(f"{len(flags)} answers for {len(values)} fingerprints")
    return flags[inverse] if len(values) else np.empty(0, bool)


def _views(plans: list[Plan], texts: list[bytes], data: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[Plan, tuple]]:
    """Each plan with its symbols, their number by text, and the texts' starts."""
    for plan in plans:
        yield plan, (data, sizes, starts) if plan.unit == BYTES else _words_of(texts)


def _to_sample(plans: list[Plan]):
    def run(key, table):
        texts, _, *own = _chunk_of(table)
        return pa.Table.from_pylist([r for plan, view in _views(plans, texts, *own) for r in plan.blobs(key[0].as_py(), plan.sample(*view), view[2], plan.sample_bits)], schema=BLOB)

    return run


def _to_suffixes(plans: list[Plan]):
    def run(key, table, ranks):
        if not table.num_rows:
            return BLOB.empty_table()
        texts, _, *own = _chunk_of(table)
        return pa.Table.from_pylist([r for plan, view in _views(plans, texts, *own) for r in plan.blobs(key[0].as_py(), plan.suffixes(*view, ranks), view[2], plan.suffix_bits)], schema=BLOB)

    return run


def _sort_bucket(key, table):
    """One bucket: all chunks' fingerprints sorted; an entry is tied if its chunk has it several times or a neighbour equals it."""
    blobs = [_unpack(x.as_py()) for x in table["prints"]]
    several = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(b)).astype(bool) for x, b in zip(table["several"], blobs)]
    values = np.concatenate(blobs)
    order = np.argsort(values)
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    tied = np.zeros(len(values), bool)
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    tied |= np.concatenate(several)
    out, at = [], 0
    for b in blobs:
        out.append(len(b).to_bytes(4, "little") + np.packbits(tied[at : at + len(b)]).tobytes())
        at += len(b)
    return pa.Table.from_arrays([table["unit"], table["chunk"], table["bucket"], pa.array(out, pa.binary())], schema=MARK)


RESULT = "text_sha256 string, n_bytes long, n_removed long, n_spans long, spans binary, kept binary, n_passages long, n_passage_words long"


def _runs(flags: np.ndarray) -> np.ndarray:
    """Begin and end of each maximal run."""
    step = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], axis=1)


def _remove(plans: list[Plan]):
    import hashlib

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def run(table, ranks, answers):
        texts, counts, data, *own = _chunk_of(table)
        gone = {plan: (view, plan.covered(*view, ranks, answers)) for plan, view in _views(plans, texts, data, *own)}
        rows = []
        for k, (text, n) in enumerate(zip(texts, counts)):
            flags = []
            for plan, ((_, sizes, starts), hit) in gone.items():
                a, m = int(starts[k]), int(sizes[k])
                flags.append(np.ones(m, bool) if n > 1 and m >= plan.length else hit[a : a + m])
            out, *words = flags
            spans, a = _runs(out), int(own[1][k])
            passages = (len(_runs(words[0])), int(words[0].sum())) if words else (0, 0)
            rows.append((hashlib.sha256(text).hexdigest(), len(text), int(out.sum()), len(spans), spans.astype("<i8").tobytes(), data[a : a + len(text)][~out].tobytes(), *passages))
        return rows

    def both(key, table, marks):
        if not table.num_rows:
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=[x.split()[0] for x in RESULT.split(", ")])
        kind = marks["kind"]
        ranks, answers = (marks.filter(pc.equal(kind, k)) for k in (0, 1))
        rows = run(table, ranks, answers)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RESULT.split(", ")])

    return both


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal texts of a slice are a row with a count."""
    for part in slices(batches):
        made = pa.table({"text": texts_of(part).cast(pa.large_binary()), "n": pa.repeat(1, part.num_rows)}).group_by("text").aggregate([("n", "sum")])
        yield from pa.table([made["text"].cast(pa.binary()), made["n_sum"]], names=["text", "n"]).combine_chunks().to_batches()


def repeated_spans(docs: DataFrame, text_col: str = "text", length: int = 400, q: int = 11, passage: int = 50, passage_q: int = 5) -> DataFrame:
    """One row a different text: text_sha256, n_bytes, n_removed, n_spans, spans (pairs of little-endian 64-bit begin and end), kept (bytes),
    n_passages and n_passage_words (runs of words that strings of ``passage`` words cover which another document has; 0: don't look)."""
    text = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-total // CHUNK_BYTES))
    plans = [Plan(BYTES, length, q, salt_bits(total // q, BUCKET_ENTRIES), salt_bits(total // 8, BUCKET_ENTRIES))]
    if passage:
        plans.append(Plan(WORDS, passage, passage_q, salt_bits(total // (6 * passage_q), BUCKET_ENTRIES), salt_bits(total // 48, BUCKET_ENTRIES)))
    parts = max(chunks, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parted = text.mapInArrow(_merge, "text binary, n long").withColumn("chunk", F.pmod(F.xxhash64("text"), F.lit(chunks)))
    parted = parted.repartition(parts, "chunk")
    by = lambda df: df.groupBy("chunk")
    ranks = by(parted).applyInArrow(_to_sample(plans), BLOBS).groupBy("unit", "bucket").applyInArrow(_sort_bucket, MARKS)
    answers = by(parted).cogroup(by(ranks)).applyInArrow(_to_suffixes(plans), BLOBS).groupBy("unit", "bucket").applyInArrow(_sort_bucket, MARKS)
    marks = ranks.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)))
    return by(parted).cogroup(by(marks)).applyInArrow(_remove(plans), RESULT)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, n_passage_words."""
    found = repeated_spans(docs, text_col, **options).withColumn("kept_sha256", F.sha2("kept", 256)).drop("spans", "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    asked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    return asked.join(found, "text_sha256", "left").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "n_passage_words")
