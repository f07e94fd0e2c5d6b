"""Language identification by rank-order profiles.

A profile is a list of the most frequent character n-grams (1 to ``longest`` characters, words padded with a mark) in
falling order of count, ties in code-point order. A document's profile is compared to each language's by out-of-place
distance: for each n-gram of the document the difference of its two ranks, or the profile's length where the language's
lacks it. The least distance wins, ties by the language's name.

Learning counts over all training documents: slices count words by language first (n-grams lie within words), Spark
sums the words, and n-grams are taken from the distinct words, weighted. Only the languages' profiles (``size`` rows a
language) reach the driver. Prediction is one pass without a shuffle.

Words are runs of letters in lower case. Cases: null text and text without a letter is ``und`` with score 0; with no
training rows every document is ``und``; long texts are used whole; repeated rows each give a row; rows with a null
language teach nothing; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, texts_of, unused

UNKNOWN = "und"
EDGE = "_"


def _letters(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Codes of the words of letters, the distinct words, offsets."""
    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL]+", " ")
    lists = pc.split_pattern(plain, " ")
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    keep = codes != names.index("") if "" in names else np.ones(len(codes), bool)
    return codes[keep], names, np.concatenate([[0], np.cumsum(keep)])[offsets - offsets[0]]


def grams(word: str, longest: int) -> list[str]:
    """The n-grams of a padded word; the mark alone is none."""
    padded = EDGE + word + EDGE
    return [padded[i : i + n] for n in range(1, longest + 1) for i in range(len(padded) - n + 1) if n > 1 or padded[i] != EDGE]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        codes, names, offsets = _letters(texts_of(part))
        langs = part.column("lang").dictionary_encode()
        of_word = np.repeat(langs.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets))
        keys, n = np.unique(of_word * len(names) + codes, return_counts=True)
        lang, word = np.divmod(keys, max(1, len(names)))
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), pa.array(names, pa.string()).take(pa.array(word)), pa.array(n, pa.int64())], names=["lang", "word", "n"])


def _count_grams(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict = {}
            for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for g in grams(word, longest):
                    sums[lang, g] = sums.get((lang, g), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array(sums.values(), pa.int64())], names=["lang", "gram", "n"])

    return run


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, size: int = 300) -> dict[str, list[str]]:
    """Each language's profile from every row with a text and a language."""
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    words = rows.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = words.mapInArrow(_count_grams(longest), "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    out: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "rank").collect():  # size rows a language
        out.setdefault(r["lang"], []).append(r["gram"])
    return out


class _Grams:
    """The n-grams of words seen, as codes: a worker's bounded cache. Codes follow no order; names do."""

    def __init__(self, longest: int, most: int = 200_000):
        self.longest, self.most = longest, most
        self.words: dict = {}
        self.code: dict = {}
        self.spelled: list = []

    def of(self, names: list[str]) -> list[np.ndarray]:
        if len(self.words) > self.most:
            self.words, self.code, self.spelled = {}, {}, []
        out = []
        for w in names:
            got = self.words.get(w)
            if got is None:
                got = self.words[w] = np.array([self.code.setdefault(g, len(self.code)) for g in grams(w, self.longest)], np.int64)
            out.append(got)
        if len(self.spelled) < len(self.code):
            self.spelled += list(self.code)[len(self.spelled) :]
        return out

    def in_order(self, used: np.ndarray) -> np.ndarray:
        """``used`` codes in the code-point order of their n-grams."""
        names = self.spelled
        return np.array(sorted(used.tolist(), key=names.__getitem__), np.int64)


def _profiles(codes, offsets, flat, sizes, begins, total: int, size: int):
    """Rows of all documents' profiles: document, n-gram (its place in code-point order), rank.

    Counts are dense over blocks of documents, at most some 4 million cells at once.
    """
    out = [(np.empty(0, np.int64),) * 3]
    rows, block = len(offsets) - 1, max(1, (4 << 20) // total)
    width = int(total).bit_length()
    for at in range(0, rows, block):
        upto = min(rows, at + block)
        word = codes[offsets[at] : offsets[upto]]
        doc = np.repeat(np.arange(upto - at), np.diff(offsets[at : upto + 1]))
        each = sizes[word]
        ends = np.cumsum(each)
        if not len(ends) or not ends[-1]:
            continue
        cell = np.repeat(doc * total, each) + flat[np.repeat(begins[word] - (ends - each), each) + np.arange(ends[-1])]
        count = np.bincount(cell, minlength=1)
        cell = np.flatnonzero(count)
        count = count[cell]
        doc, gram = np.divmod(cell, total)
        deep = int(count.max()).bit_length()
        key = np.sort((doc << (deep + width)) | ((count.max() - count) << width) | gram)
        doc, gram = key >> (deep + width), key & ((1 << width) - 1)
        rank = np.arange(len(doc)) - np.searchsorted(doc, np.arange(upto - at))[doc]
        top = rank < size
        out.append((doc[top] + at, gram[top], rank[top]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _predictor(profiles: dict[str, list[str]], longest: int, size: int):
    langs = sorted(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Grams(longest)
        for part in slices(batches, most=1 << 19):
            codes, names, offsets = _letters(texts_of(part))
            rows = len(offsets) - 1
            lists = known.of(names)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            flat, begins = (np.concatenate(lists) if lists else np.empty(0, np.int64)), np.concatenate([[0], np.cumsum(sizes)])[:-1]
            used = np.flatnonzero(np.bincount(flat, minlength=len(known.code))) if len(flat) else np.empty(0, np.int64)
            place_of = np.zeros(len(known.code) + 1, np.int64)
            place_of[known.in_order(used)] = np.arange(len(used))
            flat, total = place_of[flat], max(1, len(used))
            doc, gram, rank = _profiles(codes, offsets, flat, sizes, begins, total, size)
            there_is = np.zeros(len(known.code) + 1, bool)
            there_is[used] = True
            own = np.bincount(doc, minlength=rows)
            best, name = np.full(rows, np.inf), np.full(rows, -1)
            for k, lang in enumerate(langs):
                place = np.full(total, -1, np.int64)
                for r, g in enumerate(profiles[lang]):
                    if g in known.code and there_is[known.code[g]]:
                        place[place_of[known.code[g]]] = r
                there = place[gram]
                far = np.bincount(doc, weights=np.where(there < 0, size, np.minimum(size, np.abs(there - rank))), minlength=rows)
                better = far < best
                best, name = np.where(better, far, best), np.where(better, k, name)
            ok = (own > 0) & (name >= 0)
            score = np.where(ok, 1 - np.where(ok, best, 0) / np.maximum(1, own * size), 0.0)
            said = pa.array([langs[k] if good else UNKNOWN for k, good in zip(name.tolist(), ok.tolist())], pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "text"), said, pa.array(np.clip(score, 0, 1), pa.float64())], names=[*(c for c in part.schema.names if c != "text"), "lang_pred", "score"])

    return run


def predict(docs: DataFrame, profiles: dict[str, list[str]], id_col: str = "doc_id", text_col: str = "text", longest: int = 3, size: int = 300) -> DataFrame:
    """One row a document: doc_id, lang_pred, score (1 less the distance's share of the largest possible)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predictor(profiles, longest, size), "doc_id long, lang_pred string, score double")


def fold(id_col: str = "doc_id", folds: int = 3) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the text without characters."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def identified(docs: DataFrame, profiles: dict[str, list[str]], text_col: str = "text", least: float = 0.02, longest: int = 3, size: int = 300) -> DataFrame:
    """The documents whose language is told, with all their columns: ``und`` and scores under ``least`` go.

    A score under ``least`` means that hardly an n-gram of the text is in any profile.
    """
    text = unused(docs, "text") if text_col != "text" or "text" not in docs.columns else "text"
    rows = docs if text == text_col else docs.withColumn(text, F.col(text_col).cast("string"))
    run, names, kinds = _predictor(profiles, longest, size), docs.columns, docs.schema

    def keep(batches):
        for part in slices(batches, column=text):
            said = pa.Table.from_batches(list(run([pa.RecordBatch.from_arrays([part.column(text)], names=["text"])])))
            good = pc.and_(pc.not_equal(said["lang_pred"], UNKNOWN), pc.greater_equal(said["score"], least)).combine_chunks()
            yield part.select(names).filter(good)

    return rows.mapInArrow(keep, kinds)
