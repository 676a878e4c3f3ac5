"""Pipeline over ``documents``: each stage works on all that its predecessor kept.

Quality and toxicity reject documents, of each group of near duplicates one
document stays, and what is left is packed into training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ronda.llm import packing, quality, toxicity
from ronda.llm.jaccard_join import near_duplicate_groups
from ronda.llm.queries import BYTE_TOKENIZER, table
from ronda.llm.store import stored


def row_key(docs: DataFrame) -> str:
    """A name for the key given to every row that no column of ``docs`` has."""
    taken, name = {c.lower() for c in docs.columns}, "_row"
    while name in taken:
        name += "_"
    return name


# Classifiers and a packing order are beyond SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects, each row by its own text and metadata."""
    return quality.kept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity network marks, each row by its own text."""
    return toxicity.kept(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near duplicates: the one with the smallest doc_id.

    Rows are grouped under a key of their own, so that rows without doc_id and
    rows that share one are decided like all others.  A row without doc_id
    stays only where its whole group has none.
    """
    row = row_key(docs)
    keyed = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicate_groups(keyed, row).select(F.col(row).alias("_key"), "component_id")
    ids = keyed.select(F.col(row).alias("_key"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    first = groups.join(ids, "_key").groupBy("component_id").agg(F.min(F.struct("no_id", "doc_id", "_key")).alias("first"))
    return keyed.join(first.select(F.col("first._key").alias(row)), row, "left_semi").drop(row)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens."""
    return packing.packed(docs, BYTE_TOKENIZER)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", one_of_each_group),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
