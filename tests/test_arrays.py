"""Sums and points of whole arrays, residue ids, and the records built from them."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqpool.functions import arrays as AR
from seqpool.functions import text as TX
from seqpool.operators import prep as PP
from seqpool.plans import catalog as C

LISTS = [[], [5], None, [1, None, 3], list(range(40)), [-2, 2**31 - 1], []]
TEXTS = ["", "g", None, "MKtay-J\u00e9z", "\u4e2dA\U0001f600W\n", "w" * 300, ""]


def points(x):
    return None if x is None else [[None if r is None else float(r), float(i), float(i * i % 17)] for i, r in enumerate(x)]


def ids(text):
    return [max(TX.RESIDUE_LETTERS.find(c.upper()), 0) if c.isascii() else 0 for c in text or ""]


def digest(x):
    return (len(x), sum(v * i for i, v in enumerate(x, 1)), len(x) * (len(x) - 1) // 2, 6 * len(x))


@pytest.mark.parametrize("parts", [1, 3])
def test_sums(spark, parts):
    x = spark.createDataFrame(list(enumerate(LISTS)), "id int, v array<int>").repartition(parts)
    got = x.select("id", AR.int_sum(F.col("v")).alias("s"), AR.indexed_sum(F.col("v")).alias("w")).collect()
    assert len(got) == len(LISTS)
    for r in got:
        v = LISTS[r["id"]]
        known = v is not None and None not in v
        assert r["s"] == (sum(v) if known else None)
        assert r["w"] == (sum(a * i for i, a in enumerate(v, 1)) if known else None)
    assert x.where("false").select(AR.int_sum(F.col("v")), PP.record_sums(F.col("v"))).collect() == []


@pytest.mark.parametrize("most", [1, 2, 4, 41, 1000])
def test_pieces(most):
    x = pa.array([[9]] + LISTS, pa.list_(pa.int32())).slice(1)
    parts = list(AR.pieces(x, most))
    assert [v for p in parts for v in p.to_pylist()] == LISTS
    assert all(len(p) == 1 or sum(len(v or []) for v in p.to_pylist()) <= most for p in parts)
    assert [r for p in parts for r in AR.placed(p).to_pylist()] == [points(v) for v in LISTS]
    assert [r for p in parts for r in AR.indexed_sums(p).to_pylist()] == AR.indexed_sums(x).to_pylist()


def test_record_of_lists_and_of_columns(spark):
    """Both forms of the record hold the same four arrays."""
    lists = [v for v in LISTS if v is not None]
    x = pa.array(lists, pa.list_(pa.int32()))
    df = spark.createDataFrame([(i, v, points(v)) for i, v in enumerate(lists)], "id int, v array<int>, p array<array<double>>")
    rows = df.select(PP.residue_record(F.col("v"), F.col("p")).alias("rec")).orderBy("id").collect()
    assert PP.residue_record(x, AR.placed(x)).to_pylist() == [r["rec"].asDict() for r in rows]


def test_residue_ids_of_any_text(spark):
    x = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").repartition(2)
    got = {r["id"]: r["ids"] for r in x.select("id", TX.residue_ids(TX.upper_ascii_batch(F.col("text"))).alias("ids")).collect()}
    assert got == {i: ids(t) for i, t in enumerate(TEXTS)}
    upper = x.select(TX.upper_ascii(F.col("text")).alias("a"), TX.upper_ascii_batch(F.col("text")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in upper)


def test_record_has_no_step_per_residue(spark, tmp_path):
    """the record's sums are right for texts of several pieces, and no lambda is interpreted for each residue."""
    texts = [*TEXTS, "wyA" * AR.PIECE, "k"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    q = C.residue_record(spark, str(tmp_path))
    assert {r["doc_id"]: tuple(r)[1:] for r in q.collect()} == {i: digest(ids(t)) for i, t in enumerate(texts)}
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "translate" not in plan and plan.count("ArrowEvalPython") == 1
    cut = C.truncate_residues(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in cut} == {i: digest(ids(t)[:550])[:3] for i, t in enumerate(texts)}


def test_whole_record_is_built(monkeypatch):
    """The sums come from records that hold the positions of every residue."""
    built, record = [], PP.residue_record
    monkeypatch.setattr(PP, "residue_record", lambda *x: built.append(record(*x)) or built[-1])
    lists = [[1, 2, 3], [], [4] * (AR.PIECE + 1), [5]]
    got = PP._record_sums.func(pa.array(lists, pa.list_(pa.int32()))).to_pylist()
    assert [tuple(r.values()) for r in got] == [digest(v) for v in lists]
    assert len(built) > 1 and [len(r["pos"]) for b in built for r in b.to_pylist()] == [len(v) for v in lists]
