"""Packing: documents cut and laid into token windows of near-equal load by Karmarkar-Karp multiway differencing.

Each document becomes its token ids and an end id. Whole windows are cut off its front; what is left is cut into
pieces of at most ``piece`` ids. The pieces of a group of documents are the items of a partition into m windows:
every item starts as a partial partition with one loaded window, the two partial partitions of the largest
imbalance are merged with their loads in opposing order, and so on until one is left. m starts at the least number that
could hold the items and rises as long as a window exceeds its capacity.

Groups are runs of documents of one input partition, closed by a token budget; there is no shuffle, and a
task's memory is bounded by one slice of input, one group and the ids of ``KNOWN_WORDS`` words. A lost task is run again as a whole and gives the same
windows from the same rows. ``sequence_id`` is the partition's number times 2^36 plus a count.

Cases: null or empty text is the end id alone; a long text is cut into as many windows as it needs; rows with equal or
null ids are packed as separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
SLICE_BYTES = 2 << 20
KNOWN_WORDS = 1 << 19  # words whose ids a worker keeps: some 20 MB
LETTERS = "^[a-zÀ-ÖØ-öø-ÿ]+$"  # lower-casing keeps these single letters
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[10] = 32
_JOINS, _STOPS = np.zeros(256, bool), np.zeros(256, bool)
_JOINS[[*range(48, 58), *range(97, 123)]] = True
_STOPS[[ord(c) for c in ".,!?;:|"]] = True
MARK = "\x01"  # stands alone between words on their way through the tokenizer
_TOKENIZERS: dict = {}


def stretches(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased, spaces for line ends, and a space where one of .,!?;:| follows a letter a-z or a digit."""
    _, ends, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    ends = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = _LOWER[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    at = np.flatnonzero(_JOINS[raw[:-1]] & _STOPS[raw[1:]]) + 1 if len(raw) else np.empty(0, np.int64)
    at = at[~np.isin(at, ends)]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(ends + np.searchsorted(at, ends)), pa.py_buffer(np.insert(raw, at, 32))])


class Vocabulary:
    """The tokenizer at a path, called as it is; ids of words seen before are kept where that changes no result.

    Words can be encoded one by one (``apart``) if the tokenizer lower-cases, joins nothing across white space or from a letter or
    digit to one of .,!?;:| and adds nothing at the ends: its normaliser and pre-tokenizer must be the ones written out here. Texts
    with a special token's string, and all texts of other tokenizers, go to the plain call.
    """

    #: The normaliser and the pre-tokenizer of a lower-case BPE with word ends.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        about = json.loads(self.plain.to_str())
        normal, before = about.get("normalizer") or {}, about.get("pre_tokenizer") or {}
        steps = before.get("pretokenizers") or [{}]
        self.special = [t["content"] for t in about["added_tokens"]]
        self.apart = (
            normal.get("normalizers") == self.NORMALIZERS
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"]
            and (steps[0].get("pattern"), steps[0].get("behavior"), steps[0].get("invert")) == ({"Regex": self.SPLIT}, "Removed", True)
            and not steps[1].get("add_prefix_space")
            and (about["model"].get("type"), about["model"].get("end_of_word_suffix")) == ("BPE", "</w>")
            and about.get("post_processor") is None
            and not about.get("truncation")
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] for t in about["added_tokens"])
        )
        self.mark = self.plain.encode(MARK, add_special_tokens=False).ids
        self.apart &= len(self.mark) == 1
        self.last = np.zeros(self.plain.get_vocab_size(), bool)
        for word, k in self.plain.get_vocab().items():
            self.last[k] = word.endswith("</w>")
        self.clear()

    def clear(self) -> None:
        self.words, self.flat, self.ends = pa.array([], pa.large_string()), np.empty(0, np.uint32), np.zeros(1, np.int64)

    def spell(self, words: pa.Array, together: int = 1000) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has: words go in lines, told apart by a mark between them."""
        plain = pc.match_substring_regex(words, LETTERS).to_numpy(zero_copy_only=False)
        ids, sizes = [], np.empty(len(words), np.int64)
        for marked, at in ((False, np.flatnonzero(plain)), (True, np.flatnonzero(~plain))):
            own = words.take(pa.array(at))
            blocks = [own.slice(a, together).to_pylist() for a in range(0, len(own), together)]
            lines = [(f" {MARK} " if marked else " ").join(block) for block in blocks]
            made = [np.array(x.ids, np.uint32) for x in self.plain.encode_batch_fast(lines, add_special_tokens=False)]
            if marked:
                made, n = zip(*(self._between(block, x) for block, x in zip(blocks, made))) if made else ((), ())
                sizes[at] = np.concatenate([np.empty(0, np.int64), *n])
                made = np.concatenate([np.empty(0, np.uint32), *made])
            else:  # a word of letters is one unit, whose last id ends a word
                made = np.concatenate([np.empty(0, np.uint32), *made])
                sizes[at] = np.diff(np.flatnonzero(self.last[made]), prepend=-1)
            ids.append(made)
        # Back into the order of ``words``.
        flat = np.concatenate(ids)
        order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), kind="stable")
        n = np.concatenate([sizes[plain], sizes[~plain]])
        begin = (np.cumsum(n) - n)[order]
        return flat[np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))], sizes

    def _between(self, block: list[str], made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids between marks, and how many; a block with the mark itself in a word is spelt word by word."""
        at = np.flatnonzero(made == self.mark[0])
        if any(MARK in w for w in block):
            parts = [np.array(self.plain.encode(w, add_special_tokens=False).ids, np.uint32) for w in block]
            return np.concatenate(parts), np.array([len(x) for x in parts])
        return np.delete(made, at), np.diff(np.concatenate([[-1], at, [len(made)]])) - 1

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The places of distinct words among the known ones, new ones added; all are forgotten when they would be too many."""
        at = pc.index_in(words, value_set=self.words)
        absent = at.is_null().to_numpy(zero_copy_only=False)
        if len(self.words) + int(absent.sum()) > KNOWN_WORDS:
            self.clear()
            absent = np.ones(len(words), bool)
        place = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if absent.any():
            new = words.filter(pa.array(absent))
            place[absent] = len(self.words) + np.arange(len(new))
            ids, sizes = self.spell(new)
            self.words = pa.concat_arrays([self.words, new])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, ids])
        return place

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and each text's offsets."""
        if not self.apart:
            return self.whole(texts)
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False).astype(bool)
        if odd.any():  # a special token's string is that token
            parts = [self.whole(texts.slice(k, 1)) if odd[k] else self.encode(texts.slice(k, 1)) for k in range(len(texts))]
            return np.concatenate([ids for ids, _ in parts]), np.concatenate([[0], np.cumsum([upto[-1] for _, upto in parts])])
        lists = pc.split_pattern(stretches(texts), " ")
        ends = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = self.numbers(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        begins = self.ends[codes]
        each = self.ends[codes + 1] - begins
        upto = np.concatenate([[0], np.cumsum(each)])
        at = np.repeat(begins - upto[:-1], each) + np.arange(upto[-1])
        return self.flat[at], upto[ends - ends[0]]

    def whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        made = [np.array(self.plain.encode(t, add_special_tokens=False).ids, np.uint32) for t in texts.to_pylist()]
        return np.concatenate([np.empty(0, np.uint32), *made]), np.concatenate([[0], np.cumsum([len(x) for x in made])]).astype(np.int64)


def vocabulary(path: str) -> Vocabulary:
    """The tokenizer at ``path``, once a worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Vocabulary(path)
    return _TOKENIZERS[path]


def difference(sizes: list[int], windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: each item's window, and the windows' loads."""
    if windows == 1:
        return np.zeros(len(sizes), np.int64), np.array([sum(sizes)], np.int64)
    parent = list(range(len(sizes)))
    # A partial partition: loads less the least one, descending, and the item sets behind them (-1: none).
    heap = []
    for k, n in enumerate(sizes):
        heap.append((-n, k, np.array([n], np.int64), np.array([k], np.int64)))
    heapq.heapify(heap)
    count = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        if len(a) + len(b) <= windows:  # the opposing halves don't meet
            load, own = np.concatenate([a, b]), np.concatenate([x, y])
        else:
            load, own = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
            load[: len(a)], own[: len(a)] = a, x
            load[windows - len(b) :] += b[::-1]
            both = np.arange(windows - len(b), len(a))
            other = y[::-1]
            joined = other[both - (windows - len(b))]
            free = np.arange(len(a), windows)
            own[free] = other[free - (windows - len(b))]
            for at, right in zip(both.tolist(), joined.tolist()):
                left = int(own[at])
                if right >= 0 and left >= 0:
                    parent[right] = left
                elif right >= 0:
                    own[at] = right
        order = np.argsort(-load, kind="stable")
        load, own = load[order], own[order]
        if len(load) == windows:
            load = load - load[-1]
        heapq.heappush(heap, (-int(load[0] - (load[-1] if len(load) == windows else 0)), count, load, own))
        count += 1
    own = heap[0][3]
    window_of = {int(r): k for k, r in enumerate(own) if r >= 0}
    place = np.empty(len(sizes), np.int64)
    for k in range(len(sizes)):
        r = k
        while parent[r] != r:
            parent[r] = parent[parent[r]]
            r = parent[r]
        place[k] = window_of[r]
    return place, np.bincount(place, weights=sizes, minlength=windows).astype(np.int64)


def windows_of(sizes: list[int], capacity: int) -> np.ndarray:
    """Each item's window under ``capacity``; the number of windows rises whenever one exceeds it."""
    m = max(1, -(-sum(sizes) // capacity))
    while True:
        place, loads = difference(sizes, m)
        if loads.max(initial=0) <= capacity:
            return place
        m += 1


def _packer(path: str, window: int, end_id: int, piece: int, group_tokens: int, checksum: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()) if checksum else ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def laid(held: list[tuple], number: int) -> tuple[pa.RecordBatch, int]:
        """The pieces of a group of documents, and the next window's number. A piece is a run of the group's ids."""
        docs, total, ids = pa.concat_arrays([d for d, _, _ in held]), np.concatenate([n for _, n, _ in held]), np.concatenate([x for _, _, x in held])
        windows = total // window
        pieces = windows + -(-(total % window) // piece)
        doc = np.repeat(np.arange(len(total)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        cut = windows[doc]
        full = nth < cut
        start = np.where(full, nth * window, cut * window + (nth - cut) * piece)
        length = np.where(full, window, np.minimum(piece, total[doc] - start))
        sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        sequence[full] = number + np.arange(full.sum())
        number += int(full.sum())
        rest = np.flatnonzero(~full)
        if len(rest):
            place = windows_of(length[rest].tolist(), window)
            _, place = np.unique(place, return_inverse=True)
            sequence[rest] = number + place
            number += int(place.max()) + 1
            by = np.argsort(place, kind="stable")
            upto = np.cumsum(length[rest][by]) - length[rest][by]
            new = np.concatenate([[True], np.diff(place[by]) > 0])
            offset[rest[by]] = upto - np.maximum.accumulate(np.where(new, upto, 0))
        raw = np.ascontiguousarray(ids, "<u4").view(np.uint8)
        ends = np.concatenate([[0], np.cumsum(length)]) * 4
        if checksum:
            view = memoryview(raw)
            said = pa.array(np.fromiter((zlib.crc32(view[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())), np.int64, len(doc)))
        else:
            said = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
        cols = [docs.take(pa.array(doc)), pa.array(start), pa.array(length), said, pa.array(total[doc]), pa.array(sequence), pa.array(offset)]
        return pa.RecordBatch.from_arrays(cols, schema=schema), number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        known = vocabulary(path)
        held, tokens = [], 0
        for part in slices(batches, most=SLICE_BYTES):
            flat, upto = known.encode(texts_of(part))
            own = np.insert(flat, upto[1:], np.uint32(end_id))
            upto = upto + np.arange(len(upto))
            docs = part.column(0)
            a = 0
            while a < len(docs):  # a group closes with the document that reaches its budget
                b = min(len(docs), int(np.searchsorted(upto, upto[a] + group_tokens - tokens)))
                held.append((docs.slice(a, b - a), np.diff(upto[a : b + 1]), own[upto[a] : upto[b]]))
                tokens += int(upto[b] - upto[a])
                if tokens >= group_tokens:
                    made, number = laid(held, number)
                    yield made
                    held, tokens = [], 0
                a = b
        if held:
            made, number = laid(held, number)
            yield made

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, piece: int = 384, group_tokens: int = 600_000, checksum: bool = False) -> DataFrame:
    """One row a piece: its document, place in it, ids (little-endian unsigned 32-bit), sequence and offset there.

    With ``checksum``, ids_crc32 (the ids' CRC-32, worked out where they are made) in place of ids.
    """
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_packer(tokenizer_path, window, end_id, piece, group_tokens, checksum), SCHEMA.replace("ids binary", "ids_crc32 long") if checksum else SCHEMA)


def digest(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """The pieces of ``pack`` with the checksum of their ids in place of the ids."""
    return pack(docs, tokenizer_path, checksum=True, **options)
