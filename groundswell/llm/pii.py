"""Personal data: candidate spans scored by gradient-boosted trees, beside rules that always hold. DataFrame functions only.

Rules (kinds email, ip, card, phone) give the base spans, which stay. Generators of high recall propose further, overlapping spans of these
kinds and of secrets (runs of letters and digits as keys have them). A candidate's label is evidence that isn't its format: an
address ends in a domain of letters, an ip's parts are 255 at most, a card's digits pass Luhn, a phone is a rule's or stands behind a
word for one, a secret stands behind a word for one or has a run of digits in every twelve characters. Format features (digits, signs, parts, size) and context features (the characters
around it, words before it; not those that a secret's label looks for) are small integers, so all candidates of the corpus are a table of
feature combinations with counts: at most 2 x ``CELLS`` rows, which the driver reads. Boosted trees of depth two are fitted to the candidates of
one half of the documents (by a hash of the text), and on the other half each kind gets its own threshold: the least score at or above which
a share of ``precision`` of its candidates has the evidence. Candidates at their kind's threshold or above are added, with or without evidence of
their own, where they overlap no base span and no better candidate.

A match's place comes from the pieces between matches: their lengths are summed in a window over the document's rows, so a text
of very many matches costs in proportion to them. Quantifiers are possessive where nothing that follows can match less,
so no text makes a pattern backtrack or recurse.

Cases: null and empty texts have no spans; repeated rows each give a row; null ids pass through; long texts are used whole; places
count code points; with no candidate there is no tree and nothing is added; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hold_splits

KINDS = ["email", "ip", "card", "phone", "secret"]
#: Same matches as the rules' own patterns: the look-behinds skip starts within a run that can only fail like its first.
RULES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = [
    ("email", r"(?<![^\s@<>(),;:])[^\s@<>(),;:]++@[^\s@<>(),;:]++"),
    ("ip", r"(?<![0-9.])[0-9]++(?:[.,_][0-9]++){3}"),
    ("card", r"(?<![0-9])[0-9]++(?:[\x20./_-][0-9]++)*+"),
    ("phone", r"(?<![0-9])[+(]?[0-9](?:[\x20()./0-9-]*[0-9])?"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}"),
]
WORDS = r"(?i)(?:tel|phone|fax|call|mail|card|visa|konto|host|server|\bip\b)[^\n]*$"
CALLED = r"(?i)(?:tel|phone|fax|call|mobil)[^\n]*$"
KEYED = r"(?i)(?:token|key|secret|passw|pwd|auth|credential)[^\n]{0,12}$"
FEATURES = {"kind": 5, "digits": 10, "signs": 32, "parts": 6, "before": 5, "after": 5, "word": 2}
CELLS = math.prod(FEATURES.values())


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), step) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    small = lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.coalesce(F.substring(F.ltrim(x, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)
    return (
        F.when(kind == "email", True)
        .when(kind == "ip", F.forall(F.split(value, r"\."), small))
        .when(kind == "card", F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(10, 15))
    )


def _class(c: Column) -> Column:
    """0 none, 1 space, 2 letter, 3 digit, 4 other."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^\pL"), 2).when(c.rlike(r"^[0-9]"), 3).otherwise(4)


def matches(texts: DataFrame, key: str) -> DataFrame:
    """(key, kind, rule, start, end, value, features) of all rules' valid matches and all generators' candidates."""
    text = F.col("text")
    found = [
        F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), F.split(text, p, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("values"))
        for kind, rule, p in [*((k, True, p) for k, p in RULES.items()), *((k, False, p) for k, p in GENERATORS)]
    ]
    some = texts.where(text.rlike("[0-9@]"))
    rows = some.select(key, F.explode(F.array(*found)).alias("x")).where(F.size("x.values") > 0)
    rows = rows.select(key, "x.kind", "x.rule", F.posexplode(F.arrays_zip(F.col("x.pieces").alias("piece"), F.col("x.values").alias("value"))).alias("at", "m"))
    piece = F.col("m.piece")  # of the text between matches only its length and ends are shuffled
    rows = rows.select(key, "kind", "rule", "at", F.length(piece).alias("gap"), F.substring(piece, -24, 24).alias("before"), F.substring(piece, 1, 1).alias("first"), F.col("m.value").alias("value"))
    own = Window.partitionBy(key, "kind", "rule").orderBy("at")
    upto = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("end", upto).withColumn("after", F.coalesce(F.lead("first").over(own), F.lit(""))).where("value IS NOT NULL")
    rows = rows.withColumn("start", F.col("end") - F.length("value"))
    n = F.length(F.regexp_replace("value", "[^0-9]", ""))
    kind, value, before = F.col("kind"), F.col("value"), F.col("before")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    keep = F.when(F.col("rule"), _valid(kind, value)).when(kind.isin("card", "phone"), n.between(7, 24)).when(kind == "secret", mixed).otherwise(True)
    evidence = (
        F.when(kind == "email", value.rlike(r"^[^@]*[\pL\pN][^@]*@[^@]*[\pL\pN]\.\pL{2,24}\.?$"))
        .when(kind == "ip", _valid(F.lit("ip"), F.regexp_replace(value, "[,_]", ".")))
        .when(kind == "card", F.when(n.between(13, 19), _luhn(F.regexp_replace(value, "[^0-9]", ""))).otherwise(False))
        .when(kind == "phone", n.between(7, 15) & before.rlike(CALLED))
        .otherwise(before.rlike(KEYED) | ((F.size(F.split(value, "[0-9]+")) - 1) * 12 >= F.length(value)))
    )
    sign = lambda c, bit: F.when(value.contains(c), bit).otherwise(0)
    number = F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    size = F.length(value)
    length = F.when(size < 24, 0).when(size < 32, 1).when(size < 40, 2).when(size < 48, 3).when(size < 96, 4).otherwise(5)
    return rows.where(keep).select(
        key, number.alias("number"), "rule", F.col("start").cast("long"), F.col("end").cast("long"), F.coalesce(evidence, F.lit(False)).alias("evidence"),
        F.struct(
            (number - 1).alias("kind"),
            F.when(n < 7, 0).when(n < 10, 1).when(n <= 11, 2).when(n <= 13, 3).when(n == 14, 4).when(n == 15, 5).when(n == 16, 6).when(n <= 19, 7).when(n <= 21, 8).otherwise(9).alias("digits"),
            (sign("+", 1) + sign("(", 2) + sign(" ", 4) + sign("-", 8) + sign(".", 16)).alias("signs"),
            F.when(kind == "secret", length).otherwise(F.least(F.size(F.split("value", r"[.,_]")), F.lit(FEATURES["parts"])) - 1).alias("parts"),
            _class(F.substring("before", -1, 1)).alias("before"), _class(F.col("after")).alias("after"),
            F.when(F.col("before").rlike(WORDS) & (kind != "secret"), 1).otherwise(0).alias("word"),
        ).cast(", ".join(["struct<" + ", ".join(f"{f}:int" for f in FEATURES) + ">"])).alias("features"),
    )


def boost(cells: list[tuple[tuple[int, ...], int, int]], rounds: int = 30, rate: float = 0.3, ridge: float = 1.0) -> list[tuple]:
    """Trees of depth two for cells (features, candidates, how many of them have the evidence): (split, (split, low, high), (split, low, high)).

    A split (feature, value) sends value or less low. Gradient boosting with the logistic loss, Newton leaves.
    """
    total, good = sum(n for _, n, _ in cells), sum(y for _, _, y in cells)
    if not cells or not 0 < good < total:
        return []
    score = [math.log(good / (total - good))] * len(cells)
    trees: list[tuple] = [(score[0],)]

    def best(rows: list[int]):
        """The split of the largest gain, and its leaves."""
        g_all, h_all = sum(grad[k] for k in rows), sum(hess[k] for k in rows)
        found = (0.0, (0, FEATURES["kind"]), g_all / (h_all + ridge), 0.0)
        for f, size in enumerate(FEATURES.values()):
            g, h = [0.0] * size, [0.0] * size
            for k in rows:
                g[cells[k][0][f]] += grad[k]
                h[cells[k][0][f]] += hess[k]
            left_g = left_h = 0.0
            for value in range(size - 1):
                left_g, left_h = left_g + g[value], left_h + h[value]
                right_g, right_h = g_all - left_g, h_all - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - g_all**2 / (h_all + ridge)
                if gain > found[0] + 1e-9:
                    found = (gain, (f, value), left_g / (left_h + ridge), right_g / (right_h + ridge))
        return found

    for _ in range(rounds):
        p = [1 / (1 + math.exp(-s)) for s in score]
        grad = [y - n * q for (_, n, y), q in zip(cells, p)]
        hess = [n * q * (1 - q) for (_, n, _), q in zip(cells, p)]
        _, split, _, _ = best(list(range(len(cells))))
        sides = [[k for k, c in enumerate(cells) if (c[0][split[0]] <= split[1]) == low] for low in (True, False)]
        leaves = []
        for rows in sides:
            _, own, low, high = best(rows) if rows else (0.0, (0, FEATURES["kind"]), 0.0, 0.0)
            leaves.append((own, rate * low, rate * high))
            for k in rows:
                score[k] += rate * (low if cells[k][0][own[0]] <= own[1] else high)
        trees.append((split, *leaves))
    return trees


def score_of(trees: list[tuple], features: tuple[int, ...]) -> float:
    total = trees[0][0]
    for split, low, high in trees[1:]:
        own, a, b = low if features[split[0]] <= split[1] else high
        total += a if features[own[0]] <= own[1] else b
    return total


def threshold(trees: list[tuple], cells: list[tuple], precision: float) -> float:
    """The least score at or above which ``precision`` of the candidates have the evidence; infinite if there is none."""
    by_score: dict[float, list[int]] = {}
    for features, n, y in cells:
        cell = by_score.setdefault(round(score_of(trees, features), 9), [0, 0])
        cell[0] += n
        cell[1] += y
    best, n_all, y_all = math.inf, 0, 0
    for s in sorted(by_score, reverse=True):
        n_all, y_all = n_all + by_score[s][0], y_all + by_score[s][1]
        if y_all >= precision * n_all:
            best = s
    return best


def _score(trees: list[tuple]) -> Column:
    feature = lambda k: F.col(f"features.{list(FEATURES)[k]}")
    leaf = lambda x: F.when(feature(x[0][0]) <= x[0][1], x[1]).otherwise(x[2])
    total = F.lit(float(trees[0][0]))
    for split, low, high in trees[1:]:
        total = total + F.when(feature(split[0]) <= split[1], leaf(low)).otherwise(leaf(high))
    return F.round(total, 9)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95, rounds: int = 30) -> DataFrame:
    """One row a document: doc_id, base and spans: arrays of (start, number, end) in order, number the kind's place from 1."""
    hold_splits(docs.sparkSession)  # rows are numbered by split, in two scans of the table
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    half = F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")
    found = matches(base.select(F.struct("row", half.alias("half")).alias("of"), "text"), "of").select("of.row", "of.half", "number", "rule", "start", "end", "evidence", "features")
    span = F.struct("start", "number", "end")
    same = found.groupBy("row", "number", "start", "end").agg(
        F.bool_or("rule").alias("base"), F.first("half").alias("half"), F.bool_or("evidence").alias("evidence"), F.max(F.when(~F.col("rule"), F.col("features"))).alias("features")
    )
    good = F.col("evidence") | (F.col("base") & (F.col("number") == KINDS.index("phone") + 1))
    counted = same.where("features IS NOT NULL").groupBy("half", "features").agg(F.count("*").alias("n"), F.count_if(good).alias("good")).collect()  # at most 2 x CELLS rows
    halves = [sorted((tuple(r["features"]), r["n"], r["good"]) for r in counted if r["half"] == h) for h in (0, 1)]
    trees = boost(halves[0], rounds)
    least = [threshold(trees, [c for c in halves[1] if c[0][0] == k], precision) if trees else math.inf for k in range(len(KINDS))]
    score = F.when(F.col("features").isNotNull(), _score(trees)) if trees else F.lit(None).cast("double")
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in least]), F.col("number"))
    kept = same.withColumn("score", score).where(F.col("base") | (F.col("score") >= limit))
    lists = kept.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("base"),
        F.collect_list(F.when(~F.col("base"), F.struct("score", "start", "number", "end"))).alias("more"),
    )
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    free = F.filter("more", lambda c: ~F.exists("base", lambda b: meets(b, c)))
    lists = lists.withColumn("more", free)
    best = F.filter("more", lambda c: ~F.exists("more", lambda d: meets(c, d) & (d > c)))
    lists = lists.withColumn("more", F.transform(best, lambda c: F.struct(c["start"].alias("start"), c["number"].alias("number"), c["end"].alias("end"))))
    lists = lists.select(F.col("row").alias("r"), "base", F.sort_array(F.concat("base", "more")).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint>>")
    met = base.select("doc_id", "row").join(lists, F.col("row") == F.col("r"), "left")
    return met.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def written_out(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_spans (all of them)."""
    found = find(docs, **options)
    counts = [F.size(F.filter(F.transform("base", lambda s: s["number"]), lambda n: n == F.lit(k + 1))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(RULES)]
    return found.select("doc_id", *counts, F.sha2(written_out("base"), 256).alias("base_sha256"), written_out("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
