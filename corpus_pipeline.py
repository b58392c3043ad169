"""A training-data pipeline over the documents: each stage is one operator, its result written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  ``run``
applies the stages to the table of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpool.llm import decontamination, near_dedup, packing, suffix_dedup, toxicity
from seqpool.llm.common import table, written
from seqpool.llm.queries import id_bucket

ORACLE_SQL = None  # trees, MinHash and packing are not SQL: tests hold the stages against brute force
TOXIC_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labels that are not held out."""
    x = toxicity.score_documents(docs, table(spark, sf_dir, "labels"), id_bucket() != 0)
    return x.where(F.col("score") < TOXIC_SCORE).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id.  Rows without an id stay."""
    kept = near_dedup.near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    kept = written(kept, "pipeline-kept")
    named = docs.where(docs["doc_id"].isNotNull())
    one = named.join(kept, named["doc_id"] == kept["_id"], "left_semi").dropDuplicates(["doc_id", "text"])  # repeated rows
    return one.unionByName(docs.where(docs["doc_id"].isNull()))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the byte strings that stand elsewhere too; ``n_chars`` is counted anew."""
    x = suffix_dedup.dedup(docs)
    own = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return x.select(*[own.get(c, F.col("rest")[c]).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    found = decontamination.matches(docs, table(spark, sf_dir, "benchmark"))
    found = written(found.select(F.col("doc_id").alias("_id"), "th").distinct(), "pipeline-contaminated")
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["th"])
    return docs.join(found, same, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", drop_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
