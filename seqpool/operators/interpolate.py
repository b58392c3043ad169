"""Piecewise linear interpolation of query points through ragged sets of knots, for sets of any size.

Knots and points meet in one sorted merge: each knot carries the segment that ends in it, and a point takes the segment
of the first knot at or above it, filled forward by a window in descending order.  No set is collected.
A set of more than ``rows_per_range`` rows is cut in ranges of its own (``plans.prefix``); every range gets the two nearest
knots on either side as a halo, so that ranges are independent tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpool.operators.sequence import EPS
from seqpool.plans.prefix import ROWS_PER_BUCKET, group_ranges, with_ranges
from seqpool.session import materialise


def line_through(segment: Column, at: Column, eps: float) -> Column:
    """The line through the segment's ends (x0, y0), (x1, y1) at ``at``; ``eps`` is added to the interval."""
    x0, y0, x1, y1 = (segment[c] for c in ("x0", "y0", "x1", "y1"))
    return y0 + (y1 - y0) / (F.lit(eps) + (x1 - x0)) * (at - x0)


def interpolate(knots: DataFrame, points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", tie: str = "pos",
                at: str = "at", eps: float = EPS, out: str = "value", rows_per_range: int = ROWS_PER_BUCKET) -> DataFrame:
    """``points`` with ``out``, the interpolated value at ``at`` among its set's knots (keys, x, y, tie).

    Knots with equal x follow each other by ``tie``.  A point on a knot belongs to the segment that ends there; beyond the ends the outer segments go on.
    One knot: its value; a set without knots, or a null point: null.  Knots without x are left out."""
    keys = list(keys)
    extra = [c for c in points.columns if c not in keys]
    k = knots.where(F.col(x).isNotNull()).select(
        *keys, F.col(x).cast("double").alias("_x"), F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                                                             F.col(tie).alias("tie")).alias("_knot"), F.lit(None).alias("_row"))
    p = points.select(*keys, F.col(at).cast("double").alias("_x"), F.lit(None).alias("_knot"), F.struct(*extra).alias("_row"))
    both = materialise(k.unionByName(p), "interpolate-rows")
    ranges = group_ranges(both, keys, "_x", rows_per_range)
    both = with_ranges(both, ranges, keys, "_x")
    if ranges is not None:
        both = both.unionByName(_halo(both, ranges, keys))

    part = Window.partitionBy(*keys, "_bk")
    # descending; a knot stands before the points at its place, knots of equal x by descending tie, null points last
    down = part.orderBy(F.col("_x").desc_nulls_last(), F.col("_knot").isNull(), F.col("_knot.tie").desc())
    only = part.orderBy(F.col("_knot").isNull(), F.col("_x").desc_nulls_last(), F.col("_knot.tie").desc())
    below, above = F.lead("_knot").over(only), F.lag("_knot").over(only)

    def segment(a: Column, b: Column) -> Column:
        return F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))

    own = F.col("_knot")
    ends = F.when(below.isNotNull(), segment(below, own)).when(above.isNotNull(), segment(own, above)).otherwise(segment(own, own))
    rows = both.withColumn("_seg", F.when(own.isNotNull(), ends))
    rows = rows.withColumn("_last", F.max(F.when(own.isNotNull(), F.struct(own["x"], own["tie"], "_seg"))).over(part))
    filled = F.last("_seg", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*keys, "_row", "_x", F.coalesce(filled, F.col("_last._seg")).alias("_seg")).where(F.col("_row").isNotNull())
    return rows.select(*keys, *[F.col("_row")[c].alias(c) for c in extra], line_through(F.col("_seg"), F.col("_x"), eps).alias(out))


def _halo(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """For every range of a cut set the two nearest knots below and the two above it, as further knots of the range.

    From the outermost two knots of each range, at most four rows a range, and a mark per range between them."""
    cut = rows.where(F.col("_knot").isNotNull())
    names = [f"_h{i}" for i in range(len(keys))]
    sets = ranges.select(*[F.col(c).alias(n) for n, c in zip(names, keys, strict=True)], F.size("bounds").alias("_top"))
    same = F.lit(True)
    for n, c in zip(names, keys, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    cut = cut.join(sets.drop("_top"), same, "left_semi")
    part = Window.partitionBy(*keys, "_bk")
    low = F.row_number().over(part.orderBy("_knot.x", "_knot.tie"))
    high = F.row_number().over(part.orderBy(F.col("_knot.x").desc(), F.col("_knot.tie").desc()))
    outer = cut.withColumn("_lo", low).withColumn("_hi", high).where("_lo <= 2 OR _hi <= 2").select(*keys, "_bk", "_knot")
    marks = sets.select(*[F.col(n).alias(c) for n, c in zip(names, keys, strict=True)],
                        F.explode(F.sequence(F.lit(0), F.col("_top"))).alias("_bk"))
    marks = marks.withColumn("_knot", F.lit(None).cast(rows.schema["_knot"].dataType))
    x = materialise(outer.unionByName(marks), "interpolate-halo")
    of_set = Window.partitionBy(*keys)

    def nearest(descending: bool) -> DataFrame:
        order = [F.col("_bk"), F.col("_knot.x"), F.col("_knot.tie")]  # a mark, without x, stands before its range's knots
        if descending:
            order = [o.desc_nulls_first() for o in order]
        else:
            order = [o.asc_nulls_first() for o in order]
        known = F.when(F.col("_knot").isNotNull(), F.struct("_knot", F.col("_earlier")))
        y = x.where(F.col("_knot").isNotNull()).withColumn("_earlier", F.lag("_knot").over(of_set.orderBy(*order)))
        y = y.unionByName(x.where(F.col("_knot").isNull()), allowMissingColumns=True)
        y = y.withColumn("_near", F.last(known, ignorenulls=True).over(of_set.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
        y = y.where(F.col("_knot").isNull() & F.col("_near").isNotNull())
        return y.select(*keys, "_bk", F.explode(F.array("_near._knot", "_near._earlier")).alias("_knot")).where(F.col("_knot").isNotNull())

    halo = nearest(False).unionByName(nearest(True))
    return halo.select(*keys, F.col("_knot.x").alias("_x"), "_knot", F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), "_bk")
