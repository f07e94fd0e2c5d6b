"""Mixing sources to target weights by a low-discrepancy schedule.

Sizes are words. Sources share the total of all sizes by weight; a target stops at ``most`` times its source's size and
the excess is shared again. The schedule has a slot for every ``block`` words: slot i takes the golden-ratio point
frac(i * phi), which the cumulative targets map to a source, so any run of slots is near the target mix. A source's slots
are ranked, and slot r of its n holds words [r T/n, (r+1) T/n) of the source's stream of T words: its documents
shuffled by a hash and laid end to end, again from the start where T exceeds them. So a source's blocks are equal to within
a word, its total is its target to within a word, and no document is used more than ``most`` times.

Documents meet slots by (source, rank), at most one block's documents a key. Running sums and ranks go in two
levels with buckets that follow the input, so a source with a third of all rows is in no single task. The driver
sees one row a source.

Cases: null text has size 0; a null source is a source of its own, the last; repeated rows are separate documents; documents
of size 0 take nothing; a source without words has target 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from groundswell.session import written

from .common import WORD, running_sum, salt_bits, unused

#: Numerator of the golden-ratio step over 2^62 (odd, so that 2^62 points differ): round(2^62 (sqrt(5) - 1) / 2).
UNIT = 1 << 62
STEP = (math.isqrt(5 << 122) - (1 << 61)) | 1


def targets(sizes: list[int], weights: list[float], most: float = 3.0) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size; the excess goes to the others by weight."""
    out, free, rest = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = rest / sum(weights[k] for k in free)
        full = [k for k in free if unit * weights[k] > most * sizes[k]]
        if not full:
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            rest -= out[k]
        free = [k for k in free if k not in set(full)]
    return out


def _bucket(hashed: str, bits: int) -> Column:
    return F.shiftrightunsigned(F.col(hashed), 64 - bits) if bits else F.lit(0).cast("long")


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(id_col).cast("long")).alias("key"), _print(id_col, text_col, source_col).alias("print"),
    )


def schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(1, 2, 3), most: float = 3.0, block: int = 2048, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces).

    Documents: doc_id, source, size, print, source_id, source_size, target, place (its first word in the source's stream).
    Pieces: slot, source_id, place, epoch, start, length: words [start, start + length) of a document, for a slot.
    """
    spark = docs.sparkSession
    base = _sized(docs, id_col, text_col, source_col, seed)
    base = written(base, "mix-sizes")
    found = {r["source"]: r for r in base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}  # a row a source
    names = sorted(found, key=lambda s: (s is None, (s or "").encode()))
    sizes = [int(found[s]["size"]) for s in names]
    goals = targets(sizes, [weights[k % len(weights)] for k in range(len(names))], most)
    total, takes = sum(goals), [math.floor(g + 1e-6) for g in goals]
    count = max(1, round(total / block))
    if count >= UNIT:
        raise ValueError(f"{count} slots; the schedule has {UNIT} points: take larger blocks")
    bounds, upto = [], 0.0
    for g in goals[:-1]:
        upto += g
        bounds.append(upto / total if total else 1.0)
    whole = lambda x: F.lit(x).cast(T.DecimalType(19, 0))
    point = ((F.col("slot").cast(T.DecimalType(19, 0)) * whole(str(STEP))) % whole(str(UNIT))).cast("double") / F.lit(float(UNIT))
    slots = spark.range(count).select(F.col("id").alias("slot"))
    own = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= point)) if bounds else F.lit(0)
    slots = slots.withColumn("source_id", own.cast("int"))
    numbers = {r[0]: r[1] for r in slots.groupBy("source_id").count().collect()}
    late = [(count + k, k) for k in range(len(names)) if takes[k] and not numbers.get(k)]  # too small for a point: a slot at the end
    if late:
        slots = slots.unionByName(spark.createDataFrame(late, "slot long, source_id int"))
    about = spark.createDataFrame(
        [(names[k], k, sizes[k], float(goals[k]), takes[k], max(1, numbers.get(k, 0))) for k in range(len(names))],
        "source string, source_id int, source_size long, target double, take long, slots long",
    )
    small = F.broadcast if len(names) <= 10_000 else lambda x: x
    rows = base.withColumnRenamed("source", "own_source").join(small(about), F.col("own_source").eqNullSafe(F.col("source"))).drop("own_source")
    placed = running_sum(rows, "source_id", _bucket("key", salt_bits(sum(int(found[s]["rows"]) for s in names))), [F.col("key"), F.col("doc_id"), F.col("size"), F.col("print")], F.col("size"), "place")
    placed = written(placed, "mix-places")
    ranked = running_sum(slots, "source_id", F.shiftright("slot", 12), [F.col("slot")], F.lit(1), "rank")
    wide = lambda c: c.cast(T.DecimalType(19, 0))
    first = lambda x: F.floor((wide(x + 1) * wide(F.col("slots")) - 1) / wide(F.col("take"))).cast("long")
    edge = lambda r: F.floor(wide(r) * wide(F.col("take")) / wide(F.col("slots"))).cast("long")
    uses = placed.where("size > 0 AND take > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(take - 1) div source_size"))))
    uses = uses.withColumn("from", F.col("epoch") * F.col("source_size") + F.col("place"))
    uses = uses.withColumn("to", F.least(F.col("from") + F.col("size"), F.col("take"))).where(F.col("from") < F.col("to"))
    parts = uses.withColumn("rank", F.explode(F.sequence(first(F.col("from")), first(F.col("to") - 1))))
    lo, hi = F.greatest(F.col("from"), edge(F.col("rank"))), F.least(F.col("to"), edge(F.col("rank") + 1))
    parts = parts.select("source_id", "rank", "place", "epoch", (lo - F.col("from")).alias("start"), (hi - lo).alias("length")).where("length > 0")
    pieces = parts.join(ranked, ["source_id", "rank"]).select("slot", "source_id", "place", "epoch", "start", "length")
    return placed, pieces


def taken(docs: DataFrame, **options) -> DataFrame:
    """One row a document: doc_id, size, source_size, target, taken."""
    placed, pieces = schedule(docs, **options)
    sums = pieces.groupBy(F.col("source_id").alias("s"), F.col("place").alias("p")).agg(F.sum("length").alias("taken"))
    met = (F.col("source_id") == F.col("s")) & (F.when(F.col("size") > 0, F.col("place")) == F.col("p"))
    return placed.join(sums, met, "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents, with all columns: a row for each time that a document is used.

    A source's last use may be of a part of a document: its text is then the words taken, joined by spaces (at most
    one row a source). Rows equal in id, source and text stand for each other.
    """
    placed, pieces = schedule(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    used = pieces.groupBy("source_id", "place", "epoch").agg(F.sum("length").alias("n"))
    met = placed.where("size > 0").select("source_id", "place", "size", "print").join(used, ["source_id", "place"])
    name, uses, full = unused(docs, "mix_print"), unused(docs, "mix_uses"), unused(docs, "mix_size")
    counts = met.groupBy(F.col("print").alias(name)).agg(F.sort_array(F.collect_list("n"), asc=False).alias(uses), F.max("size").alias(full))  # as many uses as a document has
    tagged = docs.withColumn(name, _print(id_col, text_col, source_col))
    if placed.groupBy("print").count().where("count > 1").limit(1).count():
        tagged = tagged.dropDuplicates([name])
    rows = tagged.join(counts, name).withColumn(uses, F.explode(uses))
    cut, text = F.col(uses) < F.col(full), F.col(text_col)
    return rows.withColumn(text_col, F.when(cut, _first_words(text, F.col(uses))).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _print(id_col: str, text_col: str, source_col: str) -> Column:
    parts = [F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string")]
    return F.xxhash64(*[x for p in parts for x in (p.isNull(), p)])


def _first_words(text: Column, words: Column) -> Column:
    return F.concat_ws(" ", F.slice(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""), F.lit(1), words.cast("int")))
