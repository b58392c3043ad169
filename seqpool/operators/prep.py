"""Relational preparation: projections, null-safe splits, unions, distinct keys, batches, indices.

Global orders (batches, seeded shuffles, first-appearance indices) go through
``seqpool.plans.prefix`` so no step needs a single-partition window over the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from seqpool.functions import arrays as AR
from seqpool.functions.text import upper_ascii
from seqpool.plans.prefix import global_row_number, hash_bucket

SEQ_CAP = 1022      # encoder input cap: max_len 1024 minus the two terminals
RESIDUE_CAP = 550   # residue-record truncation of the multi-label task
IDENTITY_PERCENTS = (30, 40, 50, 70, 95)


def project_pair_columns(df: DataFrame, drug: str, target: str, label: str, extra: Sequence[str] = ()) -> DataFrame:
    """Select the configured entity / label columns under canonical names."""
    return df.select(*extra, F.col(drug).alias("drug"), F.col(target).alias("target"),
                     F.col(label).cast("double").alias("label"))


def nullsafe_split(df: DataFrame, set_col: str = "set", val_col: str = "validation") -> Column:
    """train = set 'train' and validation not TRUE (NULL counts as train, Q1); val = set 'train'
    and validation TRUE; test = set 'test'; anything else NULL."""
    is_val = F.col(val_col).eqNullSafe(F.lit(True))
    return (F.when(F.col(set_col) == "test", F.lit("test"))
            .when((F.col(set_col) == "train") & is_val, F.lit("val"))
            .when(F.col(set_col) == "train", F.lit("train")))


def normalize_sequence(c: Column, cap: int = SEQ_CAP) -> Column:
    """Upper-case and cut to ``cap`` characters (the encoder's input limit)."""
    return F.substring(upper_ascii(c), 1, cap)


def truncate_arrays(cols: Sequence[str], cap: int = RESIDUE_CAP) -> list[Column]:
    """P5: keep the first ``cap`` entries of every parallel array."""
    return [F.slice(F.col(c), 1, cap).alias(c.split(".")[-1]) for c in cols]


def identity_filter(members: DataFrame, percent: int, strict: bool = False) -> DataFrame:
    """Proteins flagged '1' at the chosen identity threshold.  Unknown thresholds raise
    (Q26) unless ``strict=True``, which returns an empty selection like the reference."""
    if percent not in IDENTITY_PERCENTS:
        if strict:
            return members.where(F.lit(False))
        raise ValueError(f"identity threshold must be one of {IDENTITY_PERCENTS}, got {percent}")
    return members.where(F.col(f"p{percent}") == "1")


def trim_first_last(c: Column) -> Column:
    """P8 encoder A: drop the start and end terminal (positions 1 .. len)."""
    return F.slice(c, 2, F.greatest(F.size(c) - 2, F.lit(0)))


def trim_last_two(c: Column) -> Column:
    """P8 encoder B: ``[:-2]`` — keeps the start terminal, drops the end terminal and the last residue (Q3)."""
    return F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0)))


def zero_fallback(vec: Column, valid: Column, n: int) -> Column:
    """Invalid or wrongly sized rows become an all-zero vector instead of an error."""
    ok = valid & (F.size(vec) == n)
    return F.when(ok, vec.cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), n))


def eval_cadence(epochs: DataFrame, every_n: int, epoch: str = "epoch") -> DataFrame:
    """P10: keep epochs with epoch % every_n == 0."""
    return epochs.where(F.col(epoch) % every_n == 0)


def residue_record(residues: Column | pa.ListArray, positions: Column | pa.ListArray) -> Column | pa.StructArray:
    """Struct of parallel arrays (residue ids, 0..n-1 numbers, positions, constant atom code 6), of columns or of Arrow lists."""
    if isinstance(residues, pa.Array):
        return AR.zipped({"residue": residues, "number": AR.indices(residues), "pos": positions, "atom": AR.constant(residues, 6)})
    n = F.size(residues)
    numbers = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.struct(residues.alias("residue"), numbers.alias("number"), positions.alias("pos"),
                    F.array_repeat(F.lit(6), n).alias("atom"))


@arrow_udf(StructType([StructField(x, LongType()) for x in ("n", "residue_wsum", "number_sum", "atom_sum")]))
def _record_sums(residues: pa.Array) -> pa.Array:
    sums = []
    for x in AR.pieces(residues):
        rec = residue_record(x, AR.placed(x))
        sums.append(AR.zipped({"n": AR.lengths(rec.field("residue")), "residue_wsum": AR.indexed_sums(rec.field("residue")),
                               "number_sum": AR.sums(rec.field("number")), "atom_sum": AR.sums(rec.field("atom"))}))
    return pa.concat_arrays(sums)


def record_sums(residues: Column) -> Column:
    """Sums over the records of residue ids at their derived positions (``arrays.placed``).

    A batch's records are built whole in its task, some 2**18 residues at a time, and only the sums return: as rows,
    positions cost some fifty bytes a residue."""
    return _record_sums(residues)


def pos_neg_union(pos: DataFrame, neg: DataFrame, strict: bool = False, id_col: str = "row_id", seed: int = 12345) -> DataFrame:
    """Positives labelled 1 then negatives labelled 0.  ``strict`` reproduces the reference's
    sizing of labels by the positives (Q2): as many negatives as positives, the first in the seeded order of ``id_col``."""
    p = pos.withColumn("label", F.lit(1).cast("bigint"))
    n = neg.withColumn("label", F.lit(0).cast("bigint"))
    if strict:
        n_pos = pos.select(F.count(F.lit(1))).scalar()
        n = seeded_shuffle(n, id_col, seed, out="_pos").where(F.col("_pos") < n_pos).drop("_pos")
    return p.unionByName(n)


def union_splits(parts: dict[str, DataFrame], out: str = "split") -> DataFrame:
    """The tables of several splits under one schema, each row with its split's name.

    A column that only some tables have is null in the rows of the others; repeated rows stay."""
    tagged = [df.withColumn(out, F.lit(name)) for name, df in parts.items()]
    u = tagged[0]
    for t in tagged[1:]:
        u = u.unionByName(t, allowMissingColumns=True)
    return u


def distinct_keys(dfs_cols: Sequence[tuple[DataFrame, str]], out: str = "key") -> DataFrame:
    """Distinct values over several (DataFrame, column) sources."""
    parts = [df.select(F.col(c).alias(out)) for df, c in dfs_cols]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.distinct()


def hash_order_key(seed: int, id_col: Column) -> Column:
    """A 60-bit integer from md5(seed|id): reproducible order independent of partitioning (K4)."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), id_col.cast("string")))
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("bigint")


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = 12345, out: str = "position") -> DataFrame:
    """K4: position (0-based) of each row in the md5(seed|id) order."""
    x = df.withColumn("_h", hash_order_key(seed, F.col(id_col)))
    r = global_row_number(x, "_h", tiebreak=[id_col], out="_rn", bucket=hash_bucket(F.col("_h"), 60, df.count()))
    return r.withColumn(out, F.col("_rn") - 1).drop("_h", "_rn")


def assign_batches(df: DataFrame, id_col: str, batch_size: int, seed: int = 12345, out: str = "batch_id") -> DataFrame:
    """batch = floor(position / B) in the seeded order; the last partial batch is kept."""
    s = seeded_shuffle(df, id_col, seed, out="_pos")
    return s.withColumn(out, F.floor(F.col("_pos") / F.lit(batch_size)).cast("bigint")).drop("_pos")


def first_appearance_index(df: DataFrame, cls: str, order_col: str, out: str = "idx") -> DataFrame:
    """Class -> index by first appearance in ``order_col`` order (not frequency order)."""
    firsts = df.groupBy(cls).agg(F.min(order_col).alias("_first"))
    r = global_row_number(firsts, "_first", tiebreak=[cls], out="_rn")
    return r.select(F.col(cls), (F.col("_rn") - 1).cast("bigint").alias(out))


def split_sizes(df: DataFrame, split: str = "split", key: str = "key") -> DataFrame:
    """Rows and distinct keys per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))


def group_holdout_split(df: DataFrame, id_col: str, group: str, frac: float = 0.2, seed: int = 12345,
                        out: str = "part") -> Column:
    """Seeded hold-out inside each group: a row goes to 'valid' when md5(seed|group|id) falls in
    the lowest ``frac`` of the hash range.  No row order enters, so the split is reproducible."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(group).cast("string"), F.lit("|"), F.col(id_col).cast("string")))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(float(1 << 32))
    return F.when(u < F.lit(frac), F.lit("valid")).otherwise(F.lit("train"))


def center_positions(pos: Column) -> Column:
    """Coordinates minus the per-protein mean; a null list stays null, an empty one empty.

    The list and its mean are bound as variables of outer lambdas, so each is computed once, and not once a use or a position."""
    def centered(p: Column) -> Column:
        first = F.get(p, F.lit(0))
        total = F.transform(first, lambda _, d: F.aggregate(p, F.lit(0.0), lambda a, x: a + F.get(x, d)))
        mean = F.transform(total, lambda x: x / F.size(p))
        return F.get(F.transform(F.array(mean), lambda m: F.transform(p, lambda x: F.zip_with(x, m, lambda u, v: u - v))), F.lit(0))

    return F.get(F.transform(F.array(pos), centered), F.lit(0))
