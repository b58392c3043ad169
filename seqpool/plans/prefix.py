"""Distributed running sums over a global order (no single-partition window over the data).

A plain ``sum() OVER (ORDER BY x)`` without PARTITION BY moves every row into one task.
Here the order column is cut into value ranges (buckets) and then

  1. running sum inside each bucket         -> window PARTITION BY bucket (parallel, spillable)
  2. per bucket totals                      -> from the same exchange, one row per bucket
  3. exclusive offsets over the totals      -> window over one row per bucket and group
  4. running = inner + offset               -> null-safe join on group and bucket

Buckets hold about ``ROWS_PER_BUCKET`` rows, up to ``MAX_RANGES`` of them (beyond that they grow, and the window inside
spills), so the bounds that one ``percentile_approx`` job brings to the driver are bounded.  With groups, only those of more
than a bucket's rows are cut, each by bounds of its own, which stay in a table (``group_ranges``).  For keys that are
hashes the key's leading bits do without any job.  A bucket is a pure function of the value, so ties never straddle
buckets and a recomputed partition lands in the same bucket.

NULL and NaN order values come last, after all others, in either direction; NULL groups are groups like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpool.session import materialise

ROWS_PER_BUCKET = 1 << 17
MAX_RANGES = 1 << 12


def _value(col: str) -> Column:
    x = F.col(col).cast("double")
    return F.when(~F.isnan(x), x)


def _boundaries(df: DataFrame, col: str, rows_per_bucket: int) -> list[float]:
    """Approximate quantiles that cut the non-null values in at most ``MAX_RANGES`` buckets; strictly increasing."""
    n = df.agg(F.count(_value(col))).first()[0]
    k = min(-(-n // rows_per_bucket), MAX_RANGES)
    if k <= 1:
        return []
    probs = [i / k for i in range(1, k)]
    qs = df.agg(F.percentile_approx(_value(col), probs, max(1000, 10 * k))).first()[0] or []
    return sorted({float(q) for q in qs})


def group_ranges(df: DataFrame, keys: Sequence[str], col: str, rows_per_range: int = ROWS_PER_BUCKET) -> DataFrame | None:
    """(keys, bounds): for each group of more than ``rows_per_range`` rows the ascending bounds of its ranges; a written table.

    A group is cut in a power of two of ranges, at most ``MAX_RANGES``.  None if no group is that large."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if (sizes.agg(F.max("_n").alias("n")).first()["n"] or 0) <= rows_per_range:
        return None
    sizes = materialise(sizes.where(F.col("_n") > rows_per_range), "large-groups")
    x = df.join(_renamed(sizes, keys), _same(keys), "left_semi")
    probs = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    cut = x.groupBy(*keys).agg(F.percentile_approx(_value(col), probs, 10 * MAX_RANGES).alias("all"), F.count(F.lit(1)).alias("n"))
    wanted = F.least(F.pow(F.lit(2), F.ceil(F.log2(F.col("n") / rows_per_range))), F.lit(MAX_RANGES))
    step = (F.lit(MAX_RANGES) / wanted).cast("int")
    bounds = F.filter("all", lambda _, i: (i + 1) % step == 0)
    return materialise(cut.select(*keys, F.array_sort(F.array_distinct(bounds)).alias("bounds")), "group-ranges")


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in df.columns if c not in keys])


def _same(keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for i, k in enumerate(keys):
        out = out & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return out


def range_of(value: Column, bounds: Column) -> Column:
    """How many of the ascending ``bounds`` (up to twice ``MAX_RANGES``) lie below ``value``: its range.  Null bounds: 0.

    A binary search: a row costs one look a bit of the number of ranges, not one a bound."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(MAX_RANGES.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) < value, step).otherwise(0))
    return F.when(bounds.isNull() | value.isNull(), 0).otherwise(found).cast("int")


def with_ranges(df: DataFrame, ranges: DataFrame | None, keys: Sequence[str], col: str, out: str = "_bk") -> DataFrame:
    """``df`` with the range of ``col`` within its group; 0 in groups that are not cut.  ``ranges`` is a written table, so
    a group that needs cutting is dealt over tasks by Spark as well (it is broadcast, or the join is split)."""
    if ranges is None:
        return df.withColumn(out, F.lit(0))
    x = df.join(_renamed(ranges, keys), _same(keys), "left")
    return x.select(*df.columns, range_of(_value(col), F.col("bounds")).alias(out))


def hash_bucket(key: Column, key_bits: int, n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> Column:
    """Bucket of a uniformly distributed non-negative key: its leading bits, as many as ``n_rows`` call for."""
    bits = max(0, (max(1, n_rows) // rows_per_bucket).bit_length())
    return F.shiftright(key, key_bits - bits).cast("int")


def running_sums(
    df: DataFrame,
    order_col: str,
    value_cols: Sequence[str],
    descending: bool = True,
    partition_by: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    rows_per_bucket: int = ROWS_PER_BUCKET,
    bucket: Column | None = None,
) -> DataFrame:
    """Add ``cum_<c>`` (inclusive running sum in the order) and ``tot_<c>`` (total) for each value column.

    Rows equal on (partition_by, order_col, tiebreak) get arbitrary relative order, so collapse
    ties first (group by the order value) when ties must count together.  ``bucket``: a column that does not
    decrease with the order column, in place of quantile buckets."""
    if bucket is not None:
        work = df.withColumn("_bk", bucket)
        if descending:
            work = work.withColumn("_bk", -F.col("_bk"))
    elif partition_by:
        df = materialise(df, "ordered")
        ranges = group_ranges(df, partition_by, order_col, rows_per_bucket)
        work = with_ranges(df, ranges, partition_by, order_col)
        at = -F.col("_bk") if descending else F.col("_bk")
        work = work.withColumn("_bk", F.when(_value(order_col).isNull(), F.lit(MAX_RANGES)).otherwise(at))
    else:
        df = materialise(df, "ordered")
        bounds = _boundaries(df, order_col, rows_per_bucket)
        work = df.withColumn("_ord", F.coalesce(_value(order_col), F.lit(0.0)))
        if bounds:
            splits = [float("-inf"), *bounds, float("inf")]
            work = Bucketizer(splits=splits, inputCol="_ord", outputCol="_bk").transform(work)
        else:
            work = work.withColumn("_bk", F.lit(0.0))
        at = F.col("_bk").cast("int")
        at = len(bounds) - at if descending else at  # larger values first
        work = work.withColumn("_bk", F.when(_value(order_col).isNull(), F.lit(len(bounds) + 1)).otherwise(at)).drop("_ord")
    part = list(partition_by)
    own = F.col(order_col)
    if dict(df.dtypes)[order_col] in ("double", "float"):
        own = F.when(~F.isnan(own), own)
    order = own.desc_nulls_last() if descending else own.asc_nulls_last()
    ties = [F.col(t).desc() if descending else F.col(t).asc() for t in tiebreak]
    if part and bucket is None and ranges is None:  # every group is a task's work
        own_group = Window.partitionBy(*part)
        inner = own_group.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
        return df.select(*df.columns, *[F.sum(c).over(inner).alias(f"cum_{c}") for c in value_cols],
                         *[F.sum(c).over(own_group).alias(f"tot_{c}") for c in value_cols])
    inner = Window.partitionBy(*part, "_bk").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    within = work.select("*", *[F.sum(c).over(inner).alias(f"_in_{c}") for c in value_cols])
    totals = within.groupBy(*part, "_bk").agg(*[F.sum(c).alias(f"_bt_{c}") for c in value_cols])
    before = Window.partitionBy(*part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*part)
    offsets = totals.select(
        *[F.col(p).alias(f"_g{i}") for i, p in enumerate(part)], F.col("_bk").alias("_ob"),
        *[F.coalesce(F.sum(f"_bt_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in value_cols],
        *[F.sum(f"_bt_{c}").over(whole).alias(f"tot_{c}") for c in value_cols],
    )
    same = F.col("_bk") == F.col("_ob")
    for i, p in enumerate(part):
        same = same & F.col(p).eqNullSafe(F.col(f"_g{i}"))
    joined = within.join(offsets, same)
    return joined.select(
        *[c for c in df.columns],
        *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"cum_{c}") for c in value_cols],
        *[F.col(f"tot_{c}") for c in value_cols],
    )


def global_row_number(df: DataFrame, order_col: str, tiebreak: Sequence[str], out: str = "row_number",
                      descending: bool = False, partition_by: Sequence[str] = (), bucket: Column | None = None) -> DataFrame:
    """1-based position in a global order, computed with ``running_sums`` over a constant 1."""
    x = df.withColumn("_one", F.lit(1).cast("bigint"))
    r = running_sums(x, order_col, ["_one"], descending=descending, tiebreak=tiebreak, partition_by=partition_by, bucket=bucket)
    return r.withColumnRenamed("cum__one", out).drop("_one", "tot__one")
