"""A training-data pipeline: five operators, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
documents. All but the last return the columns of ``documents``.

1. language_id: profiles are learnt from all documents with a language; documents that it can't identify go (no text, no letter, or
   hardly an n-gram in any profile).
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. near_dedup: of documents connected by a similarity of 0.8 or more on shingles of five words the one with the least doc_id stays.
4. mixing: sources are taken to their target weights, a row for each use of a document.
5. packing: documents become pieces of token sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from groundswell.llm import exact_dedup, language_id, mixing, near_dedup, packing
from groundswell.llm.queries import word_vocabulary
from groundswell.session import importable, shared_folder


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return language_id.identified(docs, language_id.learn(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return near_dedup.deduplicate(docs, words=5, least=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return packing.digest(docs, word_vocabulary())


STAGES = [("language_id", identify), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Rank-order profiles, the schedule and a tokenizer aren't SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each result is a table in the shared folder."""
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
