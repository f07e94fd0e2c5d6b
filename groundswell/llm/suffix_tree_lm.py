"""Language-model scoring with a probabilistic suffix tree over words.

A symbol is a word (A-Z lower-cased) or the end of a text. The root gives a symbol the add-0.1 share of its count among all training
tokens (unseen words are one symbol). A context is the symbols before, back to the text's start, and is looked at if it is seen at least twice in
training (so its suffixes are too), at whatever length. It is a state if its next-symbol counts diverge from its suffix's by a
deleted estimate: each training occurrence is predicted from the others, and the gain in log-likelihood over the next shorter
state must exceed the log of the context's count. So a context whose next symbols are all new teaches nothing, and one that repeats does.
A state's probabilities are smoothed with the next shorter one's: p = (c + k p') / (n + k), where the context has n occurrences and
k = n^(3/4). A symbol's score is that of the longest suffix that is a state.

A context is closed, and longer ones aren't looked at, when none of these can be a state: a symbol seen c times gains at most
c log(((c - 1) / p + k) / (c - 1 + k)) with k = c^(3/4) under any longer context, once-seen symbols gain nothing, and the sum has to exceed
log 2; of one symbol alone, the log of as many occurrences as it has. Closing changes no result: it follows the counts, and
it is what makes the levels beyond the fourth small.

Data flow: the tree isn't collected, it is as large as the corpus makes it.
1. A pass cuts the input into chunks: documents as word numbers, and the chunk's distinct word hashes. Texts aren't shuffled.
2. Each chunk sends each bucket of hashes one sorted array with training counts and gets counts back: the root.
3. Length by length up to ``near``, each chunk sends its distinct (context, symbol) pairs of open contexts, by the context's hash, with
   training counts and the shorter state's p; the bucket has all of a context, tests it, and answers with the pair's and the context's
   counts, whether it is a state and whether it is open. The pairs of a context seen ``frequent`` times or more are dealt out by
   classes of the next symbol, so that no task has all of it; its classes' gains are summed in a table, joined to the chunks that asked, and
   decide once. Such a context is never closed.
4. From there on a chunk sends each open (context, symbol) once with the ``WINDOW`` symbols before it, then with three and at last eight
   times as many as the context has; a bucket grows the whole subtree over them. So rounds are as many as the logarithm of the longest
   repeated passage. Neighbours in a text mostly go to one bucket and share the text they send.
5. From length 3 on, a chunk's open symbols with their p, and the sums of the closed ones by document, are a table; the sums are the
   result. Once windows are sent, the texts with open symbols go along, and the chunks aren't read again.

An entry is sent once a chunk, so a word or phrase of a third of all documents is as many entries as there are chunks. Words, contexts
and windows go by 64-bit hashes, the symbols of one context by the numbers that the root's buckets give all words, the commonest the least
(from length 3 on by 40 bits of a hash); p' in the test by its surprise, in steps of 1/200 of its
logarithm.
Texts are read once, for the chunks.

Cases: null and empty texts are the end symbol alone; a null id counts as the text without characters for the fold; repeated rows
each give a row; with no training rows all counts are 0; long texts are used whole; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundswell.session import discard, free_shuffles, shared_folder, written

from .common import gathered, mix64, salt_bits, split_words, texts_of, word_hashes

END, START, NONE = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179), np.uint64(0)
STEP, BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93
SYMBOL_BITS = np.uint64(40)
LAST = np.uint64((1 << 40) - 1)  # the number of the end symbol
BUCKET_ENTRIES = 1 << 19
FREQUENT = 1 << 20
CHUNK_BYTES = 8 << 20
NEAR, WINDOW, GRAM = 4, 8, 4
LONG = 64  # bytes of a word that is hashed by itself
STEPS, LEAST = 200.0, 1e-9  # of a surprise's logarithm


_COMPRESS, _DECOMPRESS = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def planes(x: np.ndarray, kind: str = "<i8") -> bytes:
    """Values byte by byte of all, compressed: small values take little. First the number of bytes a value, without leading zeros of all."""
    x = np.ascontiguousarray(x, kind)
    size = max(1, (int(x.view(f"<u{x.itemsize}").max(initial=0)).bit_length() + 7) // 8)
    by_byte, out = x.view(np.uint8).reshape(-1, x.itemsize), np.empty((size, len(x)), np.uint8)
    for i in range(size):  # a column at a time takes a tenth of the time of a transposed copy
        out[i] = by_byte[:, i]
    return bytes([size]) + _COMPRESS.compress(out)


def unplanes(b: bytes, kind: str = "<i8") -> np.ndarray:
    by_byte = np.frombuffer(_DECOMPRESS.decompress(memoryview(b)[1:]), np.uint8).reshape(b[0], -1)
    out = np.zeros((by_byte.shape[1], np.dtype(kind).itemsize), np.uint8)
    for i, x in enumerate(by_byte):
        out[:, i] = x
    return out.view(kind).ravel()


def ascending(x: np.ndarray) -> bytes:
    return planes(np.diff(x, prepend=np.uint64(0)).astype(np.uint64), "<u8")


def unascending(b: bytes) -> np.ndarray:
    return np.cumsum(unplanes(b, "<u8"), dtype=np.uint64)


def _hashes(names: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, eight bytes of all of them at a time; the few long ones apart."""
    names = names.cast(pa.large_string())
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1] if len(names) else np.zeros(1, np.int64)
    start, size = offsets[:-1] - offsets[0], np.diff(offsets)
    raw = np.frombuffer(names.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    padded = np.append(raw, np.zeros(8, np.uint8))
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    out, j, at = mix64(size), 0, np.flatnonzero((size > 0) & (size <= LONG))
    while len(at):
        left = size[at] - j
        unused = (8 * np.maximum(8 - left, 0)).astype(np.uint64)
        out[at] = mix64(out[at] * STEP + ((eight[start[at] + j] << unused) >> unused))
        at, j = at[left > 8], j + 8
    long = np.flatnonzero(size > LONG)
    out[long] = word_hashes(names.take(pa.array(long)))
    return out


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks: rows, sizes, words by their place among the chunk's words (the commonest first), word hashes ascending with these places."""
    number = TaskContext.get().partitionId() << 32
    for part in gathered(batches, most=CHUNK_BYTES):
        codes, names, offsets = split_words(texts_of(part), lower=True)
        times = np.bincount(codes, minlength=len(names))
        used = np.flatnonzero(times)
        prints, of = np.unique(_hashes(names.take(pa.array(used))), return_inverse=True)
        total = np.bincount(of, weights=times[used], minlength=len(prints))
        rank = np.empty(len(prints), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(prints))
        place = np.zeros(len(names) + 1, np.int64)
        place[used] = rank[of]
        ids = part.column("doc_id")
        ids = np.append(ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False))
        train = part.column("train").to_numpy(zero_copy_only=False).astype(bool)
        row = [number, planes(ids), train.tobytes(), planes(np.diff(offsets)), planes(place[codes], "<i4"), ascending(prints), planes(rank, "<i4")]
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, [pa.int64(), *[pa.binary()] * 6])], names=[x.split()[0] for x in CHUNKS.split(", ")])
        number += 1


class Chunk:
    """A chunk's symbols in a row, an end after each document."""

    def __init__(self, row: dict):
        both = unplanes(row["ids"])
        self.number, (self.ids, self.none) = row["chunk"], np.split(both, 2)
        self.train, tokens, codes = np.frombuffer(row["train"], bool), unplanes(row["tokens"]), unplanes(row["codes"], "<i4")
        self.prints = unascending(row["prints"])
        by_rank = np.argsort(unplanes(row["ranks"], "<i4"))
        self.sizes = tokens + 1
        self.doc = np.repeat(np.arange(len(tokens)), self.sizes)
        self.at_end = np.cumsum(self.sizes) - 1
        word = np.ones(len(self.doc), bool)
        word[self.at_end] = False
        self.code = np.full(len(word), len(self.prints))  # the end symbol's number
        self.code[word] = by_rank[codes]
        self.symbol = np.append(self.prints, END)[self.code]
        self.teaches = self.train[self.doc]

        self.place = np.arange(len(self.doc)) - np.repeat(self.at_end - self.sizes + 1, self.sizes)

    def context(self, k: int, at: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Hashes of the k symbols before each of ``at`` (the start counts as one) from those of k - 1."""
        return mix64(shorter * STEP + self.before(k, at))

    def before(self, k: int, at: np.ndarray) -> np.ndarray:
        """The k-th symbol before each of ``at``: the start before the first one, none before the start."""
        there = self.symbol[np.maximum(0, at - k)]
        return np.where(self.place[at] >= k, there, np.where(self.place[at] == k - 1, START, NONE))


def surprise_sent(p: np.ndarray) -> np.ndarray:
    """-log p in even steps of its logarithm, as 16 bits."""
    return np.clip(np.round(np.log(np.maximum(-np.log(p), LEAST) / LEAST) * STEPS), 0, 65535).astype(np.uint16)


def p_tested(sent: np.ndarray) -> np.ndarray:
    return np.exp(-LEAST * np.exp(sent / STEPS))


def weight_of(n):
    """The weight of the next shorter state against n occurrences."""
    return n**0.75


def most_gain(c: np.ndarray, p: np.ndarray) -> np.ndarray:
    """What a symbol seen c times can gain at most under any longer context."""
    k = weight_of(np.maximum(c, 1.0))
    return np.where(c >= 2, c * np.log((np.maximum(c - 1, 0) / p + k) / np.maximum(c - 1 + k, 1e-9)), 0.0)


def divergence(c: np.ndarray, p: np.ndarray, n: np.ndarray, of: np.ndarray, contexts: int) -> np.ndarray:
    """Each context's gain over the shorter state, from its symbols' counts c, their p and its own n (by symbol)."""
    k = weight_of(np.maximum(n, 1.0))
    left = (np.maximum(c - 1, 0) + k * p) / (np.maximum(n, 1) - 1 + k)
    return np.bincount(of, weights=c * (np.log(left) - np.log(p)), minlength=contexts)


def is_open(c: np.ndarray, p: np.ndarray, of: np.ndarray, contexts: int) -> np.ndarray:
    """Whether a longer context can be a state. p (after the context's own test) may be sent with a step's error next time."""
    p = np.exp(np.log(p) * (1 + 1.5 / STEPS))
    gains, several = most_gain(c, p), c >= 2
    total, number = np.bincount(of, weights=gains, minlength=contexts), np.bincount(of, weights=several, minlength=contexts)
    out = total > np.log(2)
    alone = several & (number[of] == 1)  # of one symbol, the gain less the log of its count is largest at 2 or at all
    two = most_gain(np.full(int(alone.sum()), 2.0), p[alone])
    out[of[alone]] &= (two > np.log(2)) | (gains[alone] > np.log(c[alone]))
    return out


CHUNKS = "chunk long, ids binary, train binary, tokens binary, codes binary, prints binary, ranks binary"
SENT = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("symbols", pa.binary()), ("counts", pa.binary()), ("often", pa.binary()), ("shorter", pa.binary()), ("window", pa.binary()), ("text", pa.binary()), ("lengths", pa.binary()), ("carry", pa.list_(pa.binary()))])
SENTS = "chunk long, bucket long, keys binary, symbols binary, counts binary, often binary, shorter binary, window binary, text binary, lengths binary, carry array<binary>"
ANSWER = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("times", pa.binary()), ("whole", pa.binary()), ("flags", pa.binary()), ("p", pa.binary()), ("asked", pa.list_(pa.int64())), ("contexts", pa.list_(pa.int64())), ("gains", pa.list_(pa.float64())), ("often", pa.list_(pa.int64()))])
ANSWERS = "chunk long, bucket long, times binary, whole binary, flags binary, p binary, asked array<long>, contexts array<long>, gains array<double>, often array<long>"
STATE, OPEN, PENDING = 1, 2, 4  # flags


def _edges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, Iterator[tuple[int, int]]]:
    """The bucket of each of the ascending keys by their leading bits, and where buckets begin and end."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    return bucket, zip(edges[:-1].tolist(), edges[1:].tolist())


def _send_words(bits: int):
    """The distinct words of each chunk with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = Chunk(row)
                counts = np.bincount(own.code, weights=own.teaches, minlength=len(own.prints) + 1)[:-1].astype(np.int64)
                bucket, edges = _edges(own.prints, bits)
                yield from pa.Table.from_pylist([{"chunk": own.number, "bucket": int(bucket[a]), "keys": ascending(own.prints[a:b]), "counts": planes(counts[a:b], "<i4")} for a, b in edges], schema=SENT).to_batches()

    return run


ROOTS = "chunk long, bucket long, times binary, numbers binary, known long, total long"


def _count_words(key, table):
    """The words' counts and numbers within the bucket; a bucket's first answer has the bucket's numbers of known words and of tokens."""
    keys = [unascending(x) for x in table["keys"].to_pylist()]
    counts = np.concatenate([unplanes(x, "<i4") for x in table["counts"].to_pylist()])
    names, which = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(which, weights=counts, minlength=len(names)).astype(np.int64)
    number = np.empty(len(names), np.int64)
    number[np.argsort(-sums, kind="stable")] = np.arange(len(names))
    ends, rest = np.cumsum([len(k) for k in keys])[:-1], [0] * (len(keys) - 1)
    parts, numbers = np.split(sums[which], ends), np.split(number[which], ends)
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "times": pa.array([planes(x, "<i4") for x in parts], pa.binary()), "numbers": pa.array([planes(x) for x in numbers], pa.binary()), "known": pa.array([int((sums > 0).sum()), *rest], pa.int64()), "total": pa.array([int(sums.sum()), *rest], pa.int64())})


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of 64-bit keys, and the keys in it.

    Their leading bits are sorted as one number with their places, a fraction of the time of an argsort; rows that these bits don't tell
    apart are put in order after.
    """
    bits = np.uint64(max(1, len(keys) - 1).bit_length())
    both = np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64))
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    out = keys[order]
    rows = _mixed(both >> bits, out[1:] < out[:-1]) if len(keys) else order
    if len(rows):
        again = rows[np.argsort(out[rows], kind="stable")]
        order[rows], out[rows] = order[again], out[again]
    return order, out


def _mixed(runs: np.ndarray, differ: np.ndarray) -> np.ndarray:
    """The rows of those runs of equal values in which a row differs from the one before."""
    differ = np.flatnonzero(differ)
    differ = differ[runs[differ + 1] == runs[differ]]
    if not len(differ):
        return differ
    run = np.cumsum(_starts(runs)) - 1
    which = np.zeros(int(run[-1]) + 1, bool)
    which[run[differ]] = True
    return np.flatnonzero(which[run])


def _order(keys: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order in which equal keys, and within them equal symbols, are together, keys ascending; keys and symbols in that order.

    Within keys, as many bits of the symbol (of its hash, if it has more) as are free are sorted with the place; again the rest is put in order after.
    """
    order, keys = _sorted(keys)
    if not len(order):
        return order, keys, symbols
    group = np.cumsum(_starts(keys)).astype(np.uint64)
    bits = np.uint64(len(order).bit_length())
    free = 64 - int(group[-1]).bit_length() - int(bits)
    whole = int(symbols.max()).bit_length() <= free
    part = symbols.astype(np.uint64) if whole else mix64(symbols) >> np.uint64(64 - free)
    both = np.sort((group << np.uint64(free) | part[order]) << bits | order.astype(np.uint64))
    order = (both & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    if whole:
        return order, keys, (both >> bits) & np.uint64((1 << free) - 1)
    symbols = symbols[order]
    rows = _mixed(both >> bits, symbols[1:] != symbols[:-1])
    if len(rows):
        again = rows[np.lexsort((symbols[rows], both[rows] >> bits))]
        order[rows], symbols[rows] = order[again], symbols[again]
    return order, keys, symbols


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of each distinct hash, ascending by hash, and each row's place among these."""
    order, hashes = _sorted(hashes)
    new = _starts(hashes)
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before."""
    n = len(columns[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
    return new


def _test_contexts(key, table):
    """Answers to a bucket's pairs. The first answer has the classes of frequent contexts here, with their gains and n."""
    keys = [unascending(x) for x in table["keys"].to_pylist()]
    cat = lambda name, kind: np.concatenate([unplanes(x, kind) for x in table[name].to_pylist()])
    route, symbol, count, often, sent = np.concatenate(keys), cat("symbols", "<u8"), cat("counts", "<i4"), cat("often", "<i8"), cat("shorter", "<u2")
    order, route, symbol = _order(route, symbol)
    new = _starts(route, symbol)
    pair = np.cumsum(new) - 1
    c = np.bincount(pair, weights=count[order])
    p, often_ = p_tested(sent[order][new]), often[order][new]
    fresh = _starts(route[new])
    of = np.cumsum(fresh) - 1
    m = int(of[-1]) + 1 if len(of) else 0
    n = np.where(often_ > 0, often_, np.bincount(of, weights=c, minlength=m)[of])
    gain, whole, pending = divergence(c, p, n, of, m), n[fresh], often_[fresh] > 0
    state = ~pending & (whole >= 2) & (gain > np.log(np.maximum(whole, 1)))
    k = weight_of(np.maximum(n, 1.0))
    after = np.where(state[of], (c + k * p) / (n + k), p)
    open_ = pending | ((whole >= 2) & is_open(c, after, of, m))
    flags = (STATE * state + OPEN * open_ + PENDING * pending).astype(np.uint8)[of]
    said = {"times": ("<i4", c), "whole": ("<i4", np.where(flags & STATE, n, 0)), "flags": ("u1", flags)}
    ends = np.cumsum([len(x) for x in keys])[:-1]
    out = {"chunk": table["chunk"], "bucket": table["bucket"]}
    for name, (kind, values) in said.items():
        back = np.empty(len(order), np.int64)
        back[order] = values[pair]
        out[name] = pa.array([planes(x, kind) for x in np.split(back, ends)], pa.binary())
    out["p"] = pa.nulls(table.num_rows, pa.binary())
    # A frequent context's classes: the chunks that have it, and once its gain here.
    asked = [unplanes(x, "<u8").view(np.int64).tolist() if x is not None else None for x in table["window"].to_pylist()]
    names, rest = {}, [None] * (table.num_rows - 1)
    if any(asked):
        all_routes = [k[_starts(k) & (unplanes(o, "<i8") > 0)] for k, o in zip(keys, table["often"].to_pylist())]
        for r, c_ in zip(all_routes, asked):
            names.update(zip(r.tolist(), c_ or []))
    hot = np.flatnonzero(pending)
    routes = route[new][fresh][hot]
    first = ([names[r] for r in routes.tolist()], gain[hot].tolist(), whole[hot].astype(np.int64).tolist()) if len(hot) else (None, None, None)
    out["asked"] = pa.array([x or None for x in asked], pa.list_(pa.int64()))
    for name, x, kind in zip(("contexts", "gains", "often"), first, (pa.int64(), pa.float64(), pa.int64())):
        out[name] = pa.array([x, *rest], pa.list_(kind))
    return pa.table(out, schema=ANSWER)


class Rolled:
    """Hashes of runs of an array, each in one step, from sums of its prefixes."""

    def __init__(self, symbols: np.ndarray):
        self.up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(symbols), b, np.uint64))) for b in (BASE, pow(BASE, -1, 1 << 64)))
        self.sums = np.append(np.uint64(0), np.cumsum(symbols * down[:-1]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.up[start])


def _alike(rolled: Rolled, end: np.ndarray, leader: np.ndarray, done: int, most: int) -> int:
    """How many symbols, a power of two or none, all entries share with the ``leader`` of their group beyond those ``done``."""
    far, step = 0, 1
    while step <= most:
        here = rolled.of(end - done - step, end - done)
        if (here != here[leader]).any():
            break
        far, step = step, 2 * step
    return far


def _grow(width: int):
    """The subtrees over a bucket's contexts, as far as ``width`` symbols reach: each entry's p, and whether it is still open."""

    def run(key, table):
        cat = lambda name, kind: np.concatenate([unplanes(x, kind) for x in table[name].to_pylist()])
        sizes = [len(unplanes(x, "<u8")) for x in table["keys"].to_pylist()]
        texts = [unplanes(x, "<u8") for x in table["text"].to_pylist()]
        first = np.repeat(np.cumsum([0, *map(len, texts)])[:-1], sizes)  # where the chunk's text begins
        text, keys, symbol, length = np.concatenate(texts), cat("keys", "<u8"), cat("symbols", "<u8"), cat("lengths", "<i4")
        end = first + np.concatenate([np.cumsum(unplanes(x, "<i4"), dtype=np.int64) for x in table["window"].to_pylist()])
        rolled = Rolled(text)
        same = mix64(mix64(mix64(keys * STEP + symbol) * STEP + rolled.of(end - length, end)) * STEP + length.astype(np.uint64))
        one, back = _distinct(same)
        count, p = np.bincount(back, weights=cat("counts", "<i4")), np.exp(-cat("shorter", "<f4").astype(float))[one]
        group, symbol, end, length = keys[one], symbol[one], end[one], length[one]
        at, j = np.arange(len(one)), 0
        while j < width:
            there = length[at] >= j  # after its last symbol, an entry that is shorter than the window has the start
            at, group = at[there], group[there]
            group = mix64(group * STEP + np.where(length[at] > j, text[np.maximum(end[at] - 1 - j, 0)], START))
            order, group, symbols = _order(group, symbol[at])
            at = at[order]
            new = _starts(group, symbols)
            pair = np.cumsum(new) - 1
            c, own = np.bincount(pair, weights=count[at]), p[at][new]
            fresh = _starts(group[new])
            of = np.cumsum(fresh) - 1
            m = int(of[-1]) + 1 if len(of) else 0
            whole = np.bincount(of, weights=c, minlength=m)
            n = whole[of]
            state = (whole >= 2) & (divergence(c, p_tested(surprise_sent(own)), n, of, m) > np.log(np.maximum(whole, 1)))
            k = weight_of(np.maximum(n, 1.0))
            after = np.where(state[of], (c + k * own) / (n + k), own)
            p[at] = after[pair]
            open_ = ((whole >= 2) & is_open(c, after, of, m))[of][pair]
            still = not state[of][pair][open_].any()
            at, group, j = at[open_], group[open_], j + 1
            if not len(at):
                break
            if still:  # while no group splits and none was a state, the tests go as they did
                begins = _starts(group)
                far = _alike(rolled, end[at], np.flatnonzero(begins)[np.cumsum(begins) - 1], j, min(width, int(length[at].min())) - j)
                j += far
        p = -np.log(p)
        flags = np.zeros(len(p), np.uint8)
        flags[at] = OPEN
        ends = np.cumsum(sizes)[:-1]
        out = {"chunk": table["chunk"], "bucket": table["bucket"], "p": pa.array([planes(x, "<f4") for x in np.split(p[back], ends)], pa.binary()), "flags": pa.array([planes(x, "u1") for x in np.split(flags[back], ends)], pa.binary())}
        return pa.table([out.get(f.name, pa.nulls(table.num_rows, f.type)) for f in ANSWER], schema=ANSWER)

    return run


class Model:
    """What the workers need to go from a chunk and its answers to probabilities."""

    def __init__(self, total: int, kinds: int, ends: int, bits: int, frequent: int):
        self.total, self.kinds, self.ends, self.bits, self.frequent = total, kinds, ends, bits, frequent

    def root(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.total + 0.1 * (self.kinds + 1))


def _joined(answers: pa.Table, level: int, column: str, kind: str) -> np.ndarray:
    """The answers to what a chunk has sent for a level, in its order."""
    rows = answers.filter(pc.and_(pc.equal(answers["level"], level), pc.is_valid(answers["bucket"])))
    got = sorted(zip(rows["bucket"].to_pylist(), rows[column].to_pylist()))
    return np.concatenate([unplanes(b, kind) for _, b in got if b is not None] or [np.empty(0, kind)])


class Walk:
    """A chunk's open symbols (``at``): the hashes of their contexts of length ``k``, and all symbols' probabilities so far."""

    def __init__(self, model: Model, own: Chunk, answers: pa.Table):
        self.model, self.own = model, own
        counts = np.append(_joined(answers, 0, "times", "<i4").astype(np.int64), model.ends)
        buckets = _edges(own.prints, model.bits)[0]
        numbers = (_joined(answers, 0, "numbers", "<i8") << model.bits) | buckets
        self.numbers = np.append(numbers.astype(np.uint64), LAST)
        self.root = counts[own.code]
        self.p = model.root(self.root)
        self.at, self.hashes, self.k = np.arange(len(own.doc)), np.zeros(len(own.doc), np.uint64), 0
        self.seen = np.where(own.place == 0, model.ends, np.concatenate([[0], self.root[:-1]]))  # the start is seen once a training text
        self.keep(self.seen > 1)

    def keep(self, which: np.ndarray) -> None:
        which = np.flatnonzero(which)
        self.at, self.hashes, self.seen = self.at[which], self.hashes[which], self.seen[which]

    def longer(self) -> None:
        """On to contexts one symbol longer; symbols whose contexts have reached the start are done."""
        self.keep(self.own.place[self.at] >= self.k)
        self.k += 1
        self.hashes = self.own.context(self.k, self.at, self.hashes)

    def short(self) -> np.ndarray:
        """The chunk's symbols in 40 bits; from length 3 on the root's answers aren't at hand."""
        return self.numbers if self.k < 3 else mix64(np.append(self.own.prints, END)) >> (np.uint64(64) - SYMBOL_BITS)

    def pairs(self) -> dict:
        """The distinct pairs in the order in which they are sent, and each open symbol's place among them."""
        short, code = self.short(), self.own.code[self.at]
        often, hashes = np.where(self.seen >= self.model.frequent, self.seen, 0), self.hashes
        if often.any():
            hashes = hashes + mix64(short[code]) % (1 + often // self.model.frequent).astype(np.uint64)
        order, route, code = _order(mix64(hashes), code)
        new = _starts(route, code)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        one = order[new]
        return {"place": place, "one": one, "keys": route[new], "symbols": short[code[new]], "often": often[one]}

    def heard(self, answers: pa.Table, sent: dict) -> None:
        """Take a level's answers in: new probabilities, and only open symbols stay."""
        times, whole, flags = (_joined(answers, self.k, c, kind) for c, kind in (("times", "<i4"), ("whole", "<i4"), ("flags", "u1")))
        if len(flags) != len(sent["keys"]):
            raise ValueError(f"{len(flags)} answers for {len(sent['keys'])} pairs")
        place = sent["place"]
        c, n, flags = times[place].astype(float), np.where(sent["often"] > 0, sent["often"], whole)[place].astype(float), flags[place]
        said = answers.filter(pc.and_(pc.equal(answers["level"], self.k), pc.is_valid(answers["verdict"])))
        yes = np.concatenate([np.empty(0, np.int64), *(np.array(x, np.int64) for x in said["verdict"].to_pylist())]).view(np.uint64)
        state = ((flags & STATE) > 0) | (((flags & PENDING) > 0) & np.isin(self.hashes, yes))
        here, k = self.at[state], weight_of(n[state])
        self.p[here] = (c[state] + k * self.p[here]) / (n[state] + k)
        # How often a longer context is seen is the count of the pair before it, where that was open (as a frequent context's always is).
        pair = np.full(len(self.own.doc) + 1, -1, np.int64)
        pair[self.at + 1] = c
        self.seen = pair[self.at]
        self.keep(((flags & OPEN) > 0) & ((self.seen < 0) | (self.seen > 1)))

    def after(self, answers: pa.Table, level: int) -> "Walk":
        """On to contexts of ``level`` symbols, from the answers to all shorter ones."""
        while True:
            self.longer()
            if self.k == level:
                return self
            self.heard(answers, self.pairs())

    def rows(self, sent: dict) -> list[dict]:
        own, out = self.own, []
        n = np.bincount(sent["place"], weights=own.teaches[self.at], minlength=len(sent["keys"])).astype(np.int64)
        shorter = surprise_sent(self.p[self.at[sent["one"]]])
        whole = self.hashes[sent["one"]]
        bucket, edges = _edges(sent["keys"], self.model.bits)
        for a, b in edges:
            often = sent["often"][a:b]
            asked = whole[a:b][_starts(sent["keys"][a:b]) & (often > 0)]  # one for a class
            out.append({"chunk": own.number, "bucket": int(bucket[a]), "keys": ascending(sent["keys"][a:b]), "symbols": planes(sent["symbols"][a:b], "<u8"), "counts": planes(n[a:b], "<i4"), "often": planes(often, "<i8"), "shorter": planes(shorter[a:b], "<u2"), "window": planes(asked, "<u8") if len(asked) else None})
        return out


def _send_pairs(model: Model, level: int):
    """The pairs of the contexts of ``level`` symbols (at most 3); at 3 with the walk so far."""

    def run(key, chunks, answers):
        walk = Walk(model, Chunk(chunks.to_pylist()[0]), answers).after(answers, level)
        rows = walk.rows(walk.pairs())
        return pa.Table.from_pylist([*rows, _carried(walk, _sums(walk))] if level == 3 else rows, schema=SENT)

    return run


def _sums(walk: Walk) -> list[np.ndarray]:
    """By document: known tokens, base score, and the score of the symbols that are closed."""
    own = walk.own
    add = lambda x: np.bincount(own.doc, weights=x, minlength=len(own.sizes))
    closed = np.log10(walk.p)
    closed[walk.at] = 0
    return [add(walk.root > 0), add(np.log10(walk.model.root(walk.root))), add(closed)]


def _carried(walk: Walk, sums: list[np.ndarray]) -> dict:
    often = np.where(walk.seen >= walk.model.frequent, walk.seen, 0)
    steps = np.diff(walk.at, prepend=0)
    carry = [planes(steps, "<i8"), planes(-np.log(walk.p[walk.at]), "<f4"), planes(often, "<i8"), *(planes(x, "<f8") for x in sums)]
    return {"chunk": walk.own.number, "bucket": None, "carry": carry}


class Resumed(Walk):
    """A walk from what the level before has left."""

    def __init__(self, model: Model, own: Chunk, carry: list[bytes], k: int):
        self.model, self.own, self.k = model, own, k
        steps, p, self.seen = (unplanes(b, kind) for b, kind in zip(carry[:3], ("<i8", "<f4", "<i8")))
        self.at = np.cumsum(steps)
        self.p = np.ones(len(own.doc))
        self.p[self.at] = np.exp(-p.astype(float))
        self.sums = [unplanes(b, "<f8") for b in carry[3:]]

    def recall(self) -> None:
        """The hashes of the contexts, symbol by symbol as for pairs."""
        self.hashes = np.zeros(len(self.at), np.uint64)
        for j in range(1, self.k + 1):
            self.hashes = self.own.context(j, self.at, self.hashes)

    def close(self, before: np.ndarray) -> None:
        """Add what has been closed since ``before`` was open."""
        done = np.ones(len(before), bool)
        done[np.searchsorted(before, self.at)] = False
        self.sums[2] = self.sums[2] + np.bincount(self.own.doc[before[done]], weights=np.log10(self.p[before[done]]), minlength=len(self.own.sizes))


class Deep:
    """The open symbols of a chunk beyond the pairs, with the texts up to them and no others: all of it goes from round to round."""

    def __init__(self, model: Model, number: int, carry: list[bytes], k: int):
        self.model, self.number, self.k = model, number, k
        self.codes, self.prints = unplanes(carry[0], "<i4"), unplanes(carry[1], "<u8")
        self.at = np.cumsum(unplanes(carry[2], "<i4"), dtype=np.int64)
        self.place, self.doc = unplanes(carry[3], "<i4").astype(np.int64), np.cumsum(unplanes(carry[4], "<i4"), dtype=np.int64)
        self.teaches, self.asked = unplanes(carry[5], "u1"), unplanes(carry[6], "<i4")
        self.sums, self.symbol = [unplanes(b, "<f8") for b in carry[7:]], self.prints[self.codes]

    @classmethod
    def of(cls, walk: Resumed) -> "Deep":
        """From a walk by pairs; symbols whose contexts reach the start are closed in its sums before."""
        deep, own = cls.__new__(cls), walk.own
        deep.model, deep.number, deep.k, deep.at, deep.sums = walk.model, own.number, walk.k, walk.at, walk.sums
        deep.codes, deep.prints = own.code, np.append(own.prints, END)
        deep.place, deep.doc, deep.teaches, deep.p = own.place[walk.at], own.doc[walk.at], own.teaches[walk.at], walk.p[walk.at]
        return deep.trimmed()

    def trimmed(self) -> "Deep":
        """Only texts with open symbols, up to the last of them."""
        last = np.flatnonzero(np.append(self.doc[1:] != self.doc[:-1], True)) if len(self.doc) else np.empty(0, np.int64)
        sizes = self.place[last] + 1
        begin = np.cumsum(sizes) - sizes
        codes = self.codes[np.arange(int(sizes.sum())) + np.repeat(self.at[last] - self.place[last] - begin, sizes)]
        self.at = np.repeat(begin, np.diff(last, prepend=-1)) + self.place
        used = np.bincount(codes, minlength=len(self.prints)) > 0
        self.codes, self.prints = (np.cumsum(used) - 1)[codes], self.prints[used]
        self.symbol = self.prints[self.codes]
        return self

    def carried(self, asked: np.ndarray) -> dict:
        steps = lambda x: planes(np.diff(x, prepend=0), "<i4")
        carry = [planes(self.codes, "<i4"), planes(self.prints, "<u8"), steps(self.at), planes(self.place, "<i4"), steps(self.doc), planes(self.teaches, "u1"), planes(asked, "<i4"), *(planes(x, "<f8") for x in self.sums)]
        return {"chunk": self.number, "bucket": None, "carry": carry}

    def entries(self, width: int) -> dict:
        """The distinct open (context, symbol, ``width`` symbols before the context), told apart by rolling hashes, by bucket and place.

        A context's bucket is that of its least hash of ``GRAM`` symbols: neighbours in a text mostly share it, and so the text sent.
        """
        symbols, k = mix64(self.symbol) >> (np.uint64(64) - SYMBOL_BITS), self.k
        symbol, end = symbols[self.at], self.at - k
        rolled, length = Rolled(self.symbol), np.minimum(width, self.place - k)
        keys = rolled.of(end, self.at)
        same = mix64(mix64(mix64(keys * STEP + symbol) * STEP + rolled.of(end - length, end)) * STEP + length.astype(np.uint64))
        one, back = _distinct(same)
        gram = min(GRAM, k)
        least = mix64(rolled.of(np.arange(len(self.symbol) - gram + 1), np.arange(gram, len(self.symbol) + 1)))
        grams, wide = k - gram + 1, 1  # the least of as many, from the first on
        while wide < grams:
            step = min(wide, grams - wide)
            least, wide = np.minimum(least[:-step], least[step:]), wide + step
        bits = max(0, self.model.bits - 2)
        bucket = (mix64(least[end[one]]) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
        order = np.lexsort((one, bucket))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        one, bucket = one[order], bucket[order]
        return {"place": place[back], "first": one, "bucket": bucket, "keys": keys[one], "symbols": symbol[one], "end": end[one], "length": length[one], "texts": symbols}

    def grown(self, answers: pa.Table, width: int) -> None:
        """Take the answers to entries in."""
        place = self.asked
        p, flags = _joined(answers, self.k, "p", "<f4"), _joined(answers, self.k, "flags", "u1")
        if len(p) != (place.max(initial=-1) + 1):
            raise ValueError(f"{len(p)} answers for {place.max(initial=-1) + 1} entries")
        self.p, self.k = np.exp(-p.astype(float))[place], self.k + width
        open_ = ((flags[place] & OPEN) > 0) & (self.place >= self.k)
        self.sums[2] = self.sums[2] + np.bincount(self.doc[~open_], weights=np.log10(self.p[~open_]), minlength=len(self.sums[2]))
        self.at, self.place, self.doc, self.teaches, self.p = (x[open_] for x in (self.at, self.place, self.doc, self.teaches, self.p))

    def entry_rows(self, sent: dict) -> list[dict]:
        n = np.bincount(sent["place"], weights=self.teaches, minlength=len(sent["keys"])).astype(np.int64)
        surprise = -np.log(self.p[sent["first"]])
        bucket, end, length = sent["bucket"], sent["end"], sent["length"]
        begin = end - length
        if len(end):  # what the entry before has sent in the same bucket isn't sent again
            begin[1:] = np.where(bucket[1:] == bucket[:-1], np.maximum(begin[1:], end[:-1]), begin[1:])
        more = np.maximum(end - begin, 0)
        upto = np.cumsum(more)
        text = sent["texts"][np.arange(int(more.sum())) + np.repeat(begin - (upto - more), more)]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist() if len(bucket) else []
        cuts = np.append(0, upto)
        return [{"chunk": self.number, "bucket": int(bucket[a]), "keys": planes(sent["keys"][a:b], "<u8"), "symbols": planes(sent["symbols"][a:b], "<u8"), "counts": planes(n[a:b], "<i4"), "shorter": planes(surprise[a:b], "<f4"), "window": planes(more[a:b], "<i4"), "text": planes(text[cuts[a] : cuts[b]], "<u8"), "lengths": planes(length[a:b], "<i4")} for a, b in zip(edges, edges[1:])]

    def round(self, width: int) -> pa.Table:
        sent = self.entries(width)
        return pa.Table.from_pylist([*self.entry_rows(sent), self.carried(sent["place"])], schema=SENT)


def _resume(model: Model, k: int, width: int):
    """One round more after pairs of length k: ``width`` is the next one's window (0: pairs)."""

    def run(key, chunks, given):
        carry = given.filter(pc.is_valid(given["carry"]))["carry"].to_pylist()
        if not carry:
            raise ValueError("a chunk without a walk")
        answers = given.filter(pc.is_null(given["carry"]))
        walk = Resumed(model, Chunk(chunks.to_pylist()[0]), carry[0], k)
        before = walk.at
        walk.recall()
        walk.heard(answers, walk.pairs())
        if width:
            walk.keep(walk.own.place[walk.at] >= walk.k)
            walk.close(before)
            return Deep.of(walk).round(width)
        walk.longer()
        rows = walk.rows(walk.pairs())
        walk.close(before)
        return pa.Table.from_pylist([*rows, _carried(walk, walk.sums)], schema=SENT)

    return run


def _deepen(model: Model, k: int, heard: int, width: int):
    """One round more after a window of ``heard`` symbols from length k on; the texts that it needs are in the carry."""

    def run(key, given):
        carry = given.filter(pc.is_valid(given["carry"]))
        if not carry.num_rows:
            raise ValueError("a chunk without a walk")
        walk = Deep(model, carry["chunk"][0].as_py(), carry["carry"].to_pylist()[0], k)
        walk.grown(given.filter(pc.is_null(given["carry"])), heard)
        return walk.trimmed().round(width)

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    def run(key, chunks, carried):
        own, sums = Chunk(chunks.to_pylist()[0]), [unplanes(b, "<f8") for b in carried["carry"].to_pylist()[0][-3:]]
        return pa.Table.from_arrays([
            pa.array(own.ids, pa.int64(), mask=own.none.astype(bool)), pa.array(~own.train), pa.array(own.sizes), pa.array(sums[0].astype(np.int64)),
            pa.array(np.full(len(own.sizes), model.total), pa.int64()), pa.array(sums[1]), pa.array(sums[2]),
        ], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def trained_on(id_col: str = "doc_id", folds: int = 10) -> Column:
    """Whether a document teaches: crc32 of its id as text modulo ``folds`` is not 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds != 0


def _judged(tested: DataFrame, level: int) -> DataFrame:
    """A level's answers, with the frequent contexts of each chunk that are states: the gains of a context's classes together exceed the log of its n."""
    answers = tested.select("chunk", "bucket", "times", "whole", "flags", "p").withColumn("verdict", F.lit(None).cast("array<long>"))
    if tested.where("contexts IS NOT NULL").limit(1).count():
        parts = tested.where("contexts IS NOT NULL").select(F.explode(F.arrays_zip("contexts", "gains", "often")).alias("x")).select("x.*")
        states = parts.groupBy("contexts").agg(F.sum("gains").alias("gain"), F.max("often").alias("n")).where("gain > ln(n)").select(F.col("contexts").alias("context"))
        asked = tested.where("asked IS NOT NULL").select("chunk", F.explode("asked").alias("context")).distinct()
        verdicts = asked.join(states, "context").groupBy("chunk").agg(F.collect_list("context").alias("verdict"))
        answers = answers.unionByName(verdicts, allowMissingColumns=True)
    return answers.withColumn("level", F.lit(level)).withColumn("carry", F.lit(None).cast("array<binary>"))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train: Column | None = None, frequent: int = FREQUENT, near: int = NEAR, window: int = WINDOW) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. ``frequent``, ``near`` (3 at least)
    and ``window`` change how work is dealt out, not the result."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    teach = F.coalesce(trained_on(id_col) if train is None else train, F.lit(False))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), teach.alias("train"))
    size, ends = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    bits = salt_bits(size // 8, BUCKET_ENTRIES)
    shared_folder(spark)  # where the checkpoint goes
    parts, adaptive = int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get("spark.sql.adaptive.enabled")
    try:  # every round reads the chunks; a plan that isn't adaptive keeps its partitioning through the checkpoint
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        dealt = base.mapInArrow(_chunk, CHUNKS).repartition(parts, "chunk").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    words = dealt.mapInArrow(_send_words(bits), SENTS).groupBy("bucket")
    roots = written(words.applyInArrow(_count_words, ROOTS), "lm-roots")
    del words
    free_shuffles(spark)
    known, total = roots.agg(F.coalesce(F.sum("known"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    model = Model(total + ends, known + (ends > 0), ends, bits, frequent)
    meet = lambda other, run, schema: dealt.groupBy("chunk").cogroup(other.groupBy("chunk")).applyInArrow(run, schema)

    def tested(sent: DataFrame, run, label: str) -> DataFrame:
        made = written(sent.groupBy("bucket").applyInArrow(run, ANSWERS), label)
        free_shuffles(spark)
        return made

    answers, read = roots.select("chunk", "bucket", "times", "numbers").withColumn("level", F.lit(0)), [roots]
    for level in (1, 2):
        got = tested(meet(answers, _send_pairs(model, level), SENTS), _test_contexts, f"lm-tested-{level}")
        answers = answers.unionByName(_judged(got, level), allowMissingColumns=True)
        read.append(got)
    step = written(meet(answers, _send_pairs(model, 3), SENTS), "lm-walk-3")
    discard(*read)
    k, heard = 3, 0
    while step.where("bucket IS NOT NULL").limit(1).count():
        got = tested(step.where("bucket IS NOT NULL"), _grow(heard) if heard else _test_contexts, f"lm-tested-{k}")
        given = _judged(got, k).unionByName(step.where("bucket IS NULL").select("chunk", "carry"), allowMissingColumns=True)
        width, last = 0 if k < near else (3 if k < 40 else 8) * k if heard else window, step
        more = given.groupBy("chunk").applyInArrow(_deepen(model, k, heard, width), SENTS) if heard else meet(given, _resume(model, k, width), SENTS)
        step = written(more, "lm-walk")
        discard(got, last)
        # Pairs are of one symbol more; entries are of what has been heard, with symbols before it.
        k, heard = (k + heard if heard else k if width else k + 1), width
    scored = written(meet(step.where("bucket IS NULL").select("chunk", "carry"), _score(model), SCORED), "lm-scored")
    discard(step)
    return scored
