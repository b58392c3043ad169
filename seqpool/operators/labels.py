"""Multi-label annotation aggregates: code frequencies, inverse-frequency weights, multi-hot vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_frequency(annotations: DataFrame, vocab_index: DataFrame, codes: str = "codes",
                    code: str = "code", idx: str = "idx") -> DataFrame:
    """Occurrences of each vocabulary code over all proteins and splits, duplicates counted;
    codes never seen get frequency 0 (vocabulary-driven right join)."""
    counts = annotations.select(F.explode(codes).alias(code)).groupBy(code).agg(F.count(F.lit(1)).alias("freq"))
    return vocab_index.select(code, idx).join(counts, code, "left").select(
        code, idx, F.coalesce(F.col("freq"), F.lit(0)).cast("bigint").alias("freq"))


def class_weights(annotations: DataFrame, vocab_index: DataFrame, codes: str = "codes",
                  code: str = "code", idx: str = "idx", on: str = "protein") -> DataFrame:
    """A10: weight = #distinct annotated proteins / frequency; zero frequency gives NULL (the reference divides
    by zero, Q20).  The protein count is a scalar subquery, not a cross join."""
    n = annotations.select(F.countDistinct(on)).scalar()
    freq = label_frequency(annotations, vocab_index, codes, code, idx)
    return freq.select(code, idx, "freq",
                       F.try_divide(n.cast("double"), F.nullif(F.col("freq"), F.lit(0)).cast("double")).alias("weight"))


def multi_hot(proteins: DataFrame, indexed: DataFrame, vocab_index: DataFrame, on: str = "protein", idx: str = "idx") -> DataFrame:
    """(protein, ARRAY<FLOAT> of length C) with 1.0 at every annotated index, all zeros without any.

    ``proteins``: every protein once; ``indexed``: (protein, idx) rows; C = rows of ``vocab_index``.  A protein's set
    is bounded by the vocabulary."""
    sets = indexed.where(F.col(idx).isNotNull()).groupBy(on).agg(F.collect_set(idx).alias("_s"))
    n_classes = vocab_index.select(F.count(F.lit(1))).scalar()
    x = proteins.select(on).join(sets, on, "left").select(
        on, F.coalesce(F.col("_s"), F.array().cast("array<bigint>")).alias("_s"), n_classes.cast("bigint").alias("_n"))
    hot = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1), lambda i: F.array_contains(F.col("_s"), i).cast("float"))
    return x.select(on, F.when(F.col("_n") > 0, hot).otherwise(F.array().cast("array<float>")).alias("multi_hot"))
