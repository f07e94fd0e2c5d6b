"""Quality classifier from weak labels: heuristic labellers, a label model by expectation-maximisation, a hashed linear scorer.

1. Each labeller looks at one signal of a text and votes bad (0), good (1) or not at all (2).
2. All documents' votes are a table of patterns with counts (at most 3^8), which the driver reads. EM fits a two-class model with a table
   of vote probabilities a labeller and class: that is each labeller's accuracy where it votes. It starts from the majority of
   the votes, and gives each pattern a posterior of being good.
3. A logistic scorer over hashed features (shares of word shapes, steps of the signals) is fitted to the posteriors of at most ``sample``
   documents, those with the least hash of (id, text): a documented bound on what is trained on. It then scores every document.

Both passes over the texts are without a shuffle. Cases: null, empty and wordless texts have no votes but that for no plain
words (bad), and are scored like others; null ids pass through; repeated rows each give a row; long texts are used whole; with
no rows there is no model and no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, slices, split_words, texts_of, word_hashes

BAD, GOOD, NONE = 0, 1, 2
LABELLERS = ["plain_words", "symbols", "capitals", "repeats", "variety", "bars", "sentences", "lines"]


def _share(mask: np.ndarray, codes: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.bincount(doc, weights=mask[codes], minlength=len(sizes)) / np.maximum(1, sizes)


def signals(texts: pa.Array) -> tuple[np.ndarray, tuple]:
    """A row a text: shares of plain, symbol, capital, adjacent equal and distinct words, bars, words a sentence, repeated lines."""
    codes, names, offsets = split_words(texts)
    sizes = np.diff(offsets)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    is_ = lambda rx: pc.match_substring_regex(names, rx).to_numpy(zero_copy_only=False)
    plain, symbol = is_(r"^\p{Lu}?\p{Ll}*[.,;:?]?$"), is_(r"[#$%&*|~^]|!!")
    capital, bar, end = is_(r"^\p{Lu}{2,}\pP*$"), is_(r"^[|]+$"), is_(r"[.?!]$")
    same = np.zeros(len(codes))
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    distinct = np.bincount(np.unique(doc * max(1, len(names)) + codes) // max(1, len(names)), minlength=len(sizes)) / np.maximum(1, sizes)
    lines = pc.split_pattern(texts, "\n")
    line = lines.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.asarray(lines.offsets, dtype=np.int64)
    ends = ends - ends[0]
    number = np.diff(ends)
    of = np.repeat(np.arange(len(number)), number)
    kinds = np.bincount(np.unique(of * (line.max(initial=0) + 1) + line) // (line.max(initial=0) + 1), minlength=len(number))
    columns = [_share(plain, codes, doc, sizes), _share(symbol, codes, doc, sizes), _share(capital, codes, doc, sizes), np.bincount(doc, weights=same, minlength=len(sizes)) / np.maximum(1, sizes - 1)]
    columns += [distinct, _share(bar, codes, doc, sizes), sizes / np.maximum(1, np.bincount(doc, weights=end[codes], minlength=len(sizes))), 1 - kinds / np.maximum(1, number)]
    return np.stack(columns, axis=1) if len(sizes) else np.empty((0, 8)), (codes, names, doc, sizes)


def votes(s: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row a text, a column a labeller."""
    plain, symbol, capital, repeat, variety, bar, sentence, line = s.T
    pick = lambda bad, good: np.where(bad, BAD, np.where(good, GOOD, NONE))
    never = np.zeros(len(s), bool)
    out = [
        pick(plain < 0.75, plain > 0.95), pick(symbol > 0.1, symbol < 0.01), pick(capital > 0.3, never), pick(repeat > 0.15, repeat < 0.03),
        pick(variety < 0.2, variety > 0.5), pick(bar > 0.1, never), pick((sentence > 100) | (sentence < 1.5), (sentence >= 3) & (sentence < 40)), pick(line > 0.3, never),
    ]
    made = np.stack(out, axis=1)
    made[sizes == 0, 1:] = NONE
    return made.astype(np.int64)


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns: each pattern's posterior of good, and vote probabilities by (labeller, class, vote)."""
    good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
    post = np.clip((good + 0.5) / (good + 2.0 * bad + 1.0), 0.02, 0.98)  # a bad vote is the rarer and starts with more weight
    onehot = np.stack([patterns == v for v in (BAD, GOOD, NONE)], axis=2).astype(float)
    table = np.empty((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.clip((counts * post).sum() / max(1e-9, counts.sum()), 1e-6, 1 - 1e-6)
        for c, w in enumerate((counts * (1 - post), counts * post)):
            table[:, c] = (np.einsum("p,plv->lv", w, onehot) + 0.5) / (w.sum() + 1.5)
        log = np.einsum("plv,lcv->pc", onehot, np.log(table)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, table


def features(s: np.ndarray, words: tuple, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse hashed features (row, column, value): square roots of shares of word shapes, and steps of the signals."""
    codes, names, doc, sizes = words
    shapes = names
    for rx, mark in ((r"\p{Ll}+", "a"), (r"\p{Lu}+", "A"), (r"\p{N}+", "0"), (r"(\pP\pP|\pS\pS)[\pP\pS]*", "++")):
        shapes = pc.replace_substring_regex(shapes, rx, mark)
    kinds = shapes.dictionary_encode()
    column = (mix64(word_hashes(kinds.dictionary)) % np.uint64(1 << width)).astype(np.int64) if len(names) else np.empty(0, np.int64)
    of = column[kinds.indices.to_numpy(zero_copy_only=False)] if len(names) else column
    key, n = np.unique(doc * (1 << width) + of[codes], return_counts=True)
    row, col = key >> width, key & ((1 << width) - 1)
    steps = [[0.5, 0.75, 0.9], [0.02, 0.1, 0.3], [0.1, 0.3, 0.6], [0.02, 0.1, 0.3], [0.1, 0.3, 0.5], [0.02, 0.1, 0.2], [1.5, 40, 100], [0.1, 0.3, 0.6]]
    more = [(k, (k * 8 + j), s[:, k] > x) for k, xs in enumerate(steps) for j, x in enumerate(xs)]
    names_ = mix64(np.arange(64, dtype=np.uint64) + np.uint64(1 << 40)) % np.uint64(1 << width)
    rows = [row, *(np.flatnonzero(m) for _, _, m in more)]
    cols = [col, *(np.full(int(m.sum()), int(names_[i])) for _, i, m in more)]
    return np.concatenate(rows), np.concatenate(cols), np.concatenate([np.sqrt(n / np.maximum(1, sizes[row])), *(np.ones(int(m.sum())) for _, _, m in more)])


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, width: int, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights and a bias (last) of a logistic scorer on soft targets, by full gradients with a diagonal scale."""
    w, square = np.zeros((1 << width) + 1), np.full((1 << width) + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(rows, weights=values * w[cols], minlength=len(target)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(target)
        grad = np.append(np.bincount(cols, weights=values * err[rows], minlength=1 << width), err.sum()) + ridge * np.append(w[:-1], 0)
        square += grad**2
        w -= rate * grad / np.sqrt(square)
    return w


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        s, words = signals(texts_of(part))
        made = votes(s, words[3])
        yield pa.RecordBatch.from_arrays([pa.array((made * 3 ** np.arange(made.shape[1])).sum(axis=1), pa.int64())], names=["pattern"])


def _taught(width: int, posterior: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s, words = signals(texts_of(part))
            made = (votes(s, words[3]) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
            rows, cols, values = features(s, words, width)
            cut = np.searchsorted(rows[np.argsort(rows, kind="stable")], np.arange(len(s) + 1))
            order = np.argsort(rows, kind="stable")
            lists = [(cols[order[a:b]].tolist(), values[order[a:b]].tolist()) for a, b in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([part.column("hash"), pa.array([x for x, _ in lists], pa.list_(pa.int64())), pa.array([x for _, x in lists], pa.list_(pa.float64())), pa.array([posterior[int(m)] for m in made], pa.float64())], names=["hash", "cols", "vals", "target"])

    return run


def _scorer(width: int, weights: np.ndarray, posterior: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s, words = signals(texts_of(part))
            made = (votes(s, words[3]) * 3 ** np.arange(len(LABELLERS))).sum(axis=1)
            rows, cols, values = features(s, words, width)
            z = np.bincount(rows, weights=values * weights[cols], minlength=len(s)) + weights[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            weak = np.array([posterior[int(m)] for m in made])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(weak, pa.float64()), pa.array(score, pa.float64()), pa.array(score >= 0.5)], names=["doc_id", "weak_label", "score", "keep"])

    return run


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 12, sample: int = 20_000) -> DataFrame:
    """One row a document: doc_id, weak_label (posterior of good by its votes), score (the scorer's), keep (score 0.5 or more)."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    seen = base.select("text").mapInArrow(_look, "pattern long").groupBy("pattern").count().orderBy("pattern").collect()  # at most 3^8 rows
    numbers = np.array([r["pattern"] for r in seen], np.int64)
    patterns = (numbers[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    post, _ = label_model(patterns, np.array([r["count"] for r in seen], float)) if len(seen) else (np.empty(0), None)
    posterior = dict(zip(numbers.tolist(), post.tolist()))
    hashed = base.withColumn("hash", F.xxhash64(F.lit(29), "doc_id", "text"))
    last = hashed.select("hash").orderBy("hash").limit(sample).agg(F.max("hash")).first()[0]  # hashes only: texts stay where they are
    taken = hashed.where(F.col("hash") <= F.lit(last)).select("text", "hash")  # rows equal in id and text count once
    made = taken.mapInArrow(_taught(width, posterior), "hash long, cols array<long>, vals array<double>, target double")
    rows = made.dropDuplicates(["hash"]).toPandas().sort_values("hash", ignore_index=True)  # ``sample`` rows at most
    number = rows["cols"].map(len).to_numpy() if len(rows) else np.empty(0, np.int64)
    flat = lambda c, kind: np.concatenate([np.asarray(x, kind) for x in rows[c]]) if len(rows) else np.empty(0, kind)
    weights = fit(np.repeat(np.arange(len(rows)), number), flat("cols", np.int64), flat("vals", float), rows["target"].to_numpy(), width) if len(rows) else np.zeros((1 << width) + 1)
    return base.mapInArrow(_scorer(width, weights, posterior), "doc_id long, weak_label double, score double, keep boolean")
