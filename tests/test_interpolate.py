"""Interpolation over ragged sets against numpy, with sets cut in many ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpool.operators.interpolate import interpolate
from seqpool.plans import prefix

EPS = 1.1920929e-07


def by_numpy(x, y, at, eps=EPS):
    """The rule for one set of sorted knots: left insertion point less one, clamped to the intervals."""
    if len(x) == 1:
        return np.full(len(at), y[0])
    i = np.clip(np.searchsorted(x, at, side="left") - 1, 0, len(x) - 2)
    return y[i] + (y[i + 1] - y[i]) / (eps + (x[i + 1] - x[i])) * (at - x[i])


@pytest.mark.parametrize("rows_per_range", [1 << 17, 40, 3, 1])
def test_ragged_sets(spark, rows_per_range):
    rng = random.Random(rows_per_range)
    knots, points, want = [], [], {}
    for s in [None, *range(12)]:
        n = 0 if s == 3 else 1 if s == 4 else 2 if s == 5 else rng.randrange(3, 200)
        xs = sorted({round(rng.uniform(-5, 5), 1 if s == 6 else 9) for _ in range(n)})
        ys = [rng.uniform(-9, 9) for _ in xs]
        knots += [(s, x, y, i) for i, (x, y) in enumerate(zip(xs, ys, strict=True))] + [(s, None, 1.0, 999)]
        at = [rng.uniform(-7, 7) for _ in range(30)] + xs[:5] + xs[-2:] + [-100.0, 100.0]
        points += [(s, j, q, "kept") for j, q in enumerate(at)] + [(s, 999, None, "kept")]
        if xs:
            want |= {(s, j): v for j, v in enumerate(by_numpy(np.array(xs), np.array(ys), np.array(at)))}
    k = spark.createDataFrame(knots, "s int, x double, y double, pos int").repartition(4)
    p = spark.createDataFrame(points, "s int, j int, at double, note string").repartition(3)
    got = interpolate(k, p, ["s"], rows_per_range=rows_per_range).collect()
    assert len(got) == len(points) and {r["note"] for r in got} == {"kept"}
    for r in got:
        if (r["s"], r["j"]) in want:
            assert r["value"] == pytest.approx(want[r["s"], r["j"]], rel=1e-9, abs=1e-9)
        else:
            assert r["value"] is None


def test_equal_knots_follow_their_tie(spark):
    k = spark.createDataFrame([(1, 0.0, 0.0, 0), (1, 1.0, 5.0, 1), (1, 1.0, 7.0, 2), (1, 2.0, 8.0, 3)], "s int, x double, y double, pos int")
    p = spark.createDataFrame([(1, 0, 1.0), (1, 1, 1.5)], "s int, j int, at double")
    got = {r["j"]: r["value"] for r in interpolate(k, p, ["s"], eps=0.0).collect()}
    assert got == {0: 5.0, 1: 7.5}


def test_one_set_of_a_million_knots(spark):
    n = 1_000_000
    k = spark.range(n).select(F.lit(7).alias("s"), (F.col("id") / n).alias("x"), (F.col("id") * F.col("id") % 1009).cast("double").alias("y"),
                              F.col("id").alias("pos"))
    at = np.array([-0.5, 0.0, 0.123456789, 0.5, 0.7500001, 0.9999999, 1.7])
    p = spark.createDataFrame([(7, j, float(q)) for j, q in enumerate(at)], "s int, j int, at double")
    got = sorted(map(tuple, interpolate(k, p, ["s"], rows_per_range=1 << 16).select("j", "value").collect()))
    ids = np.arange(n)
    want = by_numpy(ids / n, (ids * ids % 1009).astype(float), at)
    assert np.allclose([v for _, v in got], want, rtol=1e-6, atol=1e-6)


def test_ranges_of_groups(spark):
    x = spark.range(10_000).select((F.col("id") % 3 == 0).cast("int").alias("g"), (F.col("id") * 7919 % 10_000).cast("double").alias("v"))
    x = x.union(spark.createDataFrame([(None, 1.0), (None, None), (2, 5.0), (0, float("nan"))], "g int, v double"))
    ranges = prefix.group_ranges(x, ["g"], "v", 500)
    assert {r["g"] for r in ranges.collect()} == {0, 1}
    sizes = prefix.with_ranges(x, ranges, ["g"], "v").groupBy("g", "_bk").count().collect()
    assert sum(r["count"] for r in sizes) == 10_004 and max(r["count"] for r in sizes) <= 800
    by_v = prefix.running_sums(x.withColumn("one", F.lit(1)), "v", ["one"], partition_by=["g"], rows_per_bucket=500).where("v IS NOT NULL AND NOT isnan(v)")
    for g in (0, 1, 2, None):
        got = [r["cum_one"] for r in by_v.where(F.col("g").eqNullSafe(F.lit(g))).orderBy(F.col("v").desc()).collect()]
        assert got == list(range(1, len(got) + 1))
    assert prefix.range_of(F.lit(1), F.lit(1)) is not None
    bounds = F.array(*[F.lit(float(i)) for i in range(0, 400, 2)])
    got = spark.range(-3, 410).select(F.col("id"), prefix.range_of(F.col("id").cast("double"), bounds).alias("r")).collect()
    assert all(r["r"] == sum(b < r["id"] for b in range(0, 400, 2)) for r in got)


def test_a_row_looks_at_few_bounds(spark):
    bounds = sorted({round(x, 3) for x in np.random.default_rng(8).normal(size=4095).tolist()})
    given = [(v,) for v in [*bounds[::7], bounds[0] - 1, bounds[-1] + 1, 0.0005, float("inf"), None]]
    x = spark.createDataFrame(given, "v double").select("v", prefix.range_of(F.col("v"), F.array(*map(F.lit, bounds))).alias("r"))
    assert {r["v"]: r["r"] for r in x.collect()} == {v: 0 if v is None else int(np.searchsorted(bounds, v)) for v, in given}
    at = spark.createDataFrame([(0.5, bounds)], "v double, b array<double>").select(prefix.range_of(F.col("v"), F.col("b")))
    assert "filter(" not in at._jdf.queryExecution().optimizedPlan().toString()
