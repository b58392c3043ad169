"""Sliced-Wasserstein layouts against numpy: sets as matrices, ranked ranges, padded knots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpool.operators import pooling as P
from seqpool.plans import params as PR

L, M, D = 3, 7, 4
TH, REF, W = PR.slicers(L, D), PR.permuted_reference(M, L), PR.ref_weights(M)


def embedding(x):
    """One set's embedding from the definition: sort, interpolate, subtract at the reference's argsort."""
    p = np.sort(x @ TH.T, axis=0)
    n, out = len(x), []
    for s in range(L):
        if n == 1:
            q = np.repeat(p[:, s], M)
        elif n == M:
            q = p[:, s]
        else:
            at, knots = np.arange(1, M + 1) / (M + 1), np.arange(1, n + 1) / (n + 1)
            i = np.clip(np.searchsorted(knots, at) - 1, 0, n - 2)
            q = p[i, s] + (p[i + 1, s] - p[i, s]) / (1.1920929e-07 + 1 / (n + 1)) * (at - knots[i])
        out.append(float(W @ (REF[:, s] - q[np.argsort(REF[:, s], kind="stable")])))
    return out


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(2)
    out = {k: rng.normal(size=(n, D)) for k, n in zip([None, "a", "b", "c", "d", "e"], (5, 1, 2, M, 40, 300), strict=True)}
    out["f"] = np.repeat(rng.normal(size=(3, D)), 20, axis=0)  # ties
    return out


@pytest.fixture(scope="module")
def tokens(spark, sets):
    rows = [(k, i, v.tolist()) for k, x in sets.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "seq_id string, pos bigint, vec array<double>").repartition(5)


@pytest.mark.parametrize("layout,project,large", [("sorted", "sql", 1 << 18), ("sorted", "arrow", 30), ("ranges", "arrow", 16), ("ranges", "sql", 1)])
def test_layouts(tokens, sets, layout, project, large):
    got = P.pool_swe(tokens, TH, REF, W, layout=layout, project_with=project, large_set=large).collect()
    assert len(got) == L * len(sets)
    for r in got:
        assert r["value"] == pytest.approx(embedding(sets[r["seq_id"]])[r["slice"]], abs=1e-9)
    assert P.pool_swe(tokens.where("false"), TH, REF, W, layout=layout, project_with=project).count() == 0


def test_padded_sets_equal_ragged_ones(spark, sets):
    longest = max(len(x) for x in sets.values())
    rows = [(str(k), i, v.tolist(), True) for k, x in sets.items() for i, v in enumerate(x)]
    rows += [(str(k), i, [99.0] * D, False) for k, x in sets.items() for i in range(len(x), longest)] + [("none", 0, [99.0] * D, False)]
    slots = spark.createDataFrame(rows, "seq_id string, pos bigint, vec array<double>, ok boolean").repartition(4)
    got = P.pool_swe_padded(slots, F.col("ok"), TH, REF, W, project_with="arrow").collect()
    assert len(got) == L * len(sets)
    by_name = {str(k): embedding(x) for k, x in sets.items()}
    for r in got:
        assert r["value"] == pytest.approx(by_name[r["seq_id"]][r["slice"]], abs=2.4e-4)


def test_padded_knots_by_hand(spark):
    th = np.array([[1.0]])
    rows = [("a", 0, [2.0], True), ("a", 1, [1.0], True), ("a", 2, [0.0], False), ("a", 3, [0.0], False)]
    slots = spark.createDataFrame(rows, "seq_id string, pos bigint, vec array<double>, ok boolean")
    got = P.padded_knots(slots, F.col("ok"), th, pad_eps=0.01).orderBy("x").select("x", "y").collect()
    want = [(1 / 3, 1.0), (2 / 3, 2.0), (2 / 3 + 0.01, 2.03), (2 / 3 + 0.02, 2.06)]
    assert np.allclose([tuple(r) for r in got], want)


def test_one_set_of_a_million_tokens(spark):
    n = 1_000_000
    t = spark.range(n).select(F.lit(1).alias("seq_id"), F.col("id").alias("pos"), F.array(*[((F.col("id") * (7 + 4 * i)) % 10007 / 1000.0) for i in range(D)]).alias("vec"))
    got = P.pool_swe(t, TH, REF, W, layout="sorted", project_with="arrow", large_set=1 << 16).collect()
    i = np.arange(n)
    want = embedding(np.stack([(i * (7 + 4 * k)) % 10007 / 1000.0 for k in range(D)], axis=1))
    assert sorted((r["slice"], round(r["value"], 6)) for r in got) == [(s, round(v, 6)) for s, v in enumerate(want)]
