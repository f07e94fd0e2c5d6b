"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step sends a vertex's neighbours to the least of them; the links become stars around each component's least vertex
in a number of rounds near the logarithm of the longest path. Every round is a written table: no lineage grows, no links
reach the driver, and minima are combined before the shuffle. A partition first replaces its own links by stars, slice by slice, so
what a task sees together is one step; and as soon as no more than ``FEW`` links are left, one task finishes them. Labels are the
same however links are dealt out.

Cases: a link without one or both ends is dropped; a link of a vertex to itself makes it a component of its own; repeated and turned
links count once; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundswell.session import written

FEW = 1 << 18


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the links and the least vertex of its component."""
    names, of = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(of, 2)
    label = np.arange(len(names))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)  # roots hang on to lower ones, then everyone on to its root
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return names, names[label]
        label = new


def _stars(batches: Iterator[pa.RecordBatch], most: int = FEW) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def made() -> pa.RecordBatch:
        node, label = stars(*(np.concatenate(x) for x in zip(*held)))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(label)], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(x) for x, _ in held) >= most:
            yield made()
            held.clear()
    if held:
        yield made()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (u, v) with u > v."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        made = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return made.where("u <> v").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b", few: int = FEW) -> DataFrame:
    """(node, label): every vertex of a link and the least vertex of its component."""
    ends = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = written(ends.mapInArrow(_stars, "u long, v long").distinct(), "links")  # a least vertex is its own, too
    alone = now.where("u = v").select("u", "v")
    now = now.where("u <> v")
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = mark(now)
    while before[0] > few:
        now = written(_star(_star(now, True), False), "links")
        after = mark(now)
        if after == before:
            break
        before = after
    if 0 < before[0] <= few:  # all of them in one task
        now = now.repartition(1).mapInArrow(lambda batches: _stars(batches, few + 1), "u long, v long")
    return now.unionByName(alone).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
