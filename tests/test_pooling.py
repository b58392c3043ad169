import numpy as np
import pytest

from seqpool.operators import pooling as P

TOKENS = [[1.0, 0.0], [0.0, 1.0], [2.0, 2.0]]
THETA = np.array([[3.0, 4.0], [1.0, 0.0]]) / np.array([[5.0], [1.0]])


def _toks(spark, extra=True):
    rows = [(0, i, v) for i, v in enumerate(TOKENS)]
    if extra:
        rows.append((1, 0, [3.0, 0.0]))
    return spark.createDataFrame(rows, "seq_id long, pos long, vec array<double>")


def _vals(df, key=0):
    return [round(r.value, 6) for r in df.where(f"seq_id = {key}").orderBy(df.columns[1]).collect()]


def test_avg_max_topk(spark):
    t = _toks(spark, extra=False)
    assert _vals(P.pool_avg(t)) == [1.0, 1.0]
    assert _vals(P.pool_max(t)) == [2.0, 2.0]
    assert _vals(P.pool_topk(t, k=2)) == [1.5, 1.5]
    assert _vals(P.pool_topk(t, k=5)) == [1.0, 1.0]  # k > n uses all n (Q10)


@pytest.mark.parametrize("layout", ["arrays", "window", "numpy"])
@pytest.mark.parametrize("project_with", ["sql", "arrow"])
@pytest.mark.parametrize("ref,w,expected", [
    (np.linspace(-1, 1, 2), [.5, .25], [-1.116667, -0.833333]),
    (np.linspace(-1, 1, 3), [.5, .25, .25], [-1.45, -1.0]),
    (np.linspace(-1, 1, 5), [.2] * 5, [-1.52, -1.0]),
    (np.array([[.5, -1], [-.5, 1], [1, 0]]), [.5, .25, .25], [-0.875, -1.0]),
])
def test_swe_golden(spark, layout, project_with, ref, w, expected):
    R = ref if ref.ndim == 2 else np.repeat(ref[:, None], 2, axis=1)
    out = P.pool_swe(_toks(spark), THETA, R, np.array(w), layout=layout, project_with=project_with)
    assert np.allclose(_vals(out), expected, atol=1e-5)


@pytest.mark.parametrize("layout", ["arrays", "window", "numpy"])
def test_swe_argsort_trap(spark, layout):
    # a 3-cycle reference: argsort semantics give -1.75 (rank semantics would give -1.25)
    out = P.pool_swe(_toks(spark, extra=False), THETA[:1], np.array([[0.0], [1.0], [-1.0]]), np.array([.5, .25, .25]),
                     layout=layout)
    assert abs(out.collect()[0].value - (-1.75)) < 1e-5


def test_swe_single_token(spark):
    # n = 1: constant quantile (Q14): token [3] on slicer [1], M = 2
    t = spark.createDataFrame([(0, 0, [3.0])], "seq_id long, pos long, vec array<double>")
    out = P.pool_swe(t, np.array([[1.0]]), np.array([[-1.0], [1.0]]), np.array([.5, .5]))
    assert abs(out.collect()[0].value - (-3.0)) < 1e-9


def test_swe_order_invariant(spark):
    rng = np.random.default_rng(0)
    rows = [(0, i, list(map(float, rng.normal(size=4)))) for i in range(7)]
    shuffled = [(0, i, rows[p][2]) for i, p in enumerate(rng.permutation(7))]
    th = rng.normal(size=(3, 4))
    th /= np.linalg.norm(th, axis=1, keepdims=True)
    ref, w = np.repeat(np.linspace(-1, 1, 5)[:, None], 3, axis=1), np.full(5, .2)
    a = P.pool_swe(spark.createDataFrame(rows, "seq_id long, pos long, vec array<double>"), th, ref, w)
    b = P.pool_swe(spark.createDataFrame(shuffled, "seq_id long, pos long, vec array<double>"), th, ref, w)
    assert np.allclose(_vals(a), _vals(b), atol=1e-9)
