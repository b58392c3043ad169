"""No row is lost: NULL groups and scores, missing keys, repeated entries, empty lists, store keys, workers elsewhere."""

import os
import random
import subprocess
import sys
import textwrap
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpool.operators import joins as J
from seqpool.operators import labels as LB
from seqpool.operators import metrics as M
from seqpool.operators import prep as PP
from seqpool.operators import score as SC
from seqpool.plans import catalog as C
from seqpool.plans.prefix import global_row_number, running_sums
from seqpool.session import shared_scratch
from seqpool.sources import store as SS
from seqpool.sources import text as ST

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def brute_sums(rows, descending):
    out = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        good = sorted((r for r in own if r[1] is not None and r[1] == r[1]), key=lambda r: r[1], reverse=descending)
        bad = [r for r in own if r[1] is None or r[1] != r[1]]
        total = 0
        for r in good:
            total += r[2]
            out[(g, r[3])] = total
        for r in bad:
            out[(g, r[3])] = None
    return out


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("rows_per_bucket", [7, 1 << 17])
def test_running_sums_with_null_groups_and_scores(spark, descending, rows_per_bucket):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        g = None if i % 5 == 0 else "hot" if i % 3 else f"g{i % 4}"
        s = None if i % 11 == 0 else float("nan") if i % 13 == 0 else rng.random() * (1e-6 if g is None else 1.0)
        rows.append((g, s, i % 7 + 1, i))
    x = spark.createDataFrame(rows, "g string, s double, v bigint, id bigint")
    got = running_sums(x, "s", ["v"], descending=descending, partition_by=["g"], rows_per_bucket=rows_per_bucket).collect()
    assert len(got) == len(rows)
    want = brute_sums(rows, descending)
    totals = {}
    for g, _, v, _ in rows:
        totals[g] = totals.get(g, 0) + v
    for r in got:
        assert r["tot_v"] == totals[r["g"]]
        if want[(r["g"], r["id"])] is not None:
            assert r["cum_v"] == want[(r["g"], r["id"])]
        else:  # after all rows with a score
            assert r["cum_v"] > max([0, *(w for k, w in want.items() if k[0] == r["g"] and w is not None)])


def test_many_distinct_scores(spark):
    n = 100_000
    x = spark.range(n).select((F.col("id") * 7919 % n / F.lit(float(n))).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("label"))
    r = global_row_number(x, "s", tiebreak=[], out="rn")
    assert r.where(F.col("rn") != F.round(F.col("s") * n) + 1).count() == 0
    few = M.auroc(x.limit(2000).withColumnRenamed("s", "score")).first()[0]
    rows = x.limit(2000).collect()
    pos, neg = [a["s"] for a in rows if a["label"]], [a["s"] for a in rows if not a["label"]]
    assert abs(few - sum(p > q for p in pos for q in neg) / (len(pos) * len(neg))) < 1e-9


def test_null_scores_are_not_counted(spark):
    x = spark.createDataFrame([(None, 0), (0.9, 1), (0.1, 0), (float("nan"), 1), (0.5, None)], "score double, label int")
    assert M.average_precision(x).first()[0] == 1.0
    assert M.auroc(x).first()[0] == 1.0


def test_lookups_keep_every_row(spark):
    features = spark.createDataFrame([(1, [1.0]), (2, [2.0])], "key bigint, vec array<double>")
    pairs = spark.createDataFrame([(1, 2), (1, 9), (8, 9), (None, 1)], "drug_key bigint, target_key bigint")
    got = J.pair_features(pairs, features).select("drug_key", "target_key", "drug_vec", "target_vec").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 2, [1.0], [2.0]), (1, 9, [1.0], None), (8, 9, None, None), (None, 1, None, [1.0])], key=str)
    assert {tuple(r) for r in J.unresolved(pairs, features, "target_key").collect()} == {(9, 2)}
    assert J.unresolved(pairs, features, "drug_key").count() == 2


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_pairs_meet_both_features_in_a_grid(spark, kind):
    rng = np.random.default_rng(3)
    rows = [(None if a == 0 else int(a) if a < 60 else 1, None if b == 0 else int(b) if b < 20 else 2, i // 2)
            for i, (a, b) in enumerate(zip(rng.integers(0, 120, 3000), rng.integers(0, 30, 3000), strict=True))]
    pairs = spark.createDataFrame(rows, "a bigint, b bigint, n int").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b", "n")
    given = [(i, [float(i), 1.0]) for i in range(40)] + [(None, [7.0]), (41, None)]
    features = spark.createDataFrame(given, "key bigint, vec array<float>").selectExpr(f"cast(key as {kind}) key", "vec", "size(vec) n_dims")
    sides = J.Side("a", features, {"vec": "a_vec", "n_dims": "a_dims"}), J.Side("b", features, {"vec": "b_vec"})
    one, two = J.lookup_both(pairs, *sides, grid_from=0), J.lookup_both(pairs, *sides)
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Project") and "MapInArrow" in plan and "LeftOuter" not in plan
    assert one.dtypes == two.dtypes
    assert Counter(map(str, one.collect())) == Counter(map(str, two.collect()))
    twice = J.Side("b", features.unionAll(features.where("key < 3")), {"vec": "b_vec"})
    assert J.lookup_both(pairs, sides[0], twice, grid_from=0).count() == 3000 + sum(b in (1, 2) for _, b, _ in rows)


@pytest.mark.parametrize("name", ["score_edges", "score_pairs_cosine", "edge_feature_selfjoin", "cosine_scores", "euclidean_scores"])
def test_pairs_travel_with_no_column_that_is_not_read(spark, monkeypatch, tmp_path, name):
    x = spark.range(8).selectExpr("id l_orderkey", "1 l_linenumber", "id % 3 l_partkey", "id % 2 l_suppkey", "2.0D l_quantity",
                                  "3.0D l_extendedprice", "'R' l_returnflag", "timestamp'2024-01-01' l_shipdate")
    x.write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, whole = [], J.lookup_both
    monkeypatch.setattr(J, "lookup_both", lambda df, *a, **k: seen.append(len(df.columns)) or whole(df, *a, **k))
    assert C.REGISTRY[name](spark, str(tmp_path)).count() == 8
    assert seen == [4 if name == "edge_feature_selfjoin" else 3]


def test_resolve_takes_the_last_entry(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "acc string")
    first = spark.createDataFrame([("a", "OLD", 1), ("a", "NEW", 2)], "acc string, seq string, n int")
    second = spark.createDataFrame([("a", "X", 1), ("b", "Y", 1), ("b", "Z", 2)], "acc string, seq string, n int")
    got = sorted(map(tuple, J.resolve(ids, first, second, order="n").collect()))
    assert got == [("a", "NEW", "primary"), ("a", "NEW", "primary"), ("b", "Z", "fallback"), ("c", None, None)]


def test_labels_of_repeated_and_empty_proteins(spark):
    lines = spark.createDataFrame([("p", ["a"], 1), ("p", ["a", "b"], 2), ("q", [], 3)], "protein string, codes array<string>, line int")
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "code string, idx bigint")
    weights = {r["code"]: r["weight"] for r in LB.class_weights(lines, vocab).collect()}
    assert weights == {"a": 1.0, "b": 2.0, "c": None}
    last = J.last_lines(lines, "line")
    assert {r["protein"]: r["codes"] for r in last.collect()} == {"p": ["a", "b"], "q": []}
    hot = LB.multi_hot(last.select("protein"), J.code_index(last, vocab), vocab)
    assert {r["protein"]: r["multi_hot"] for r in hot.collect()} == {"p": [1.0, 1.0, 0.0], "q": [0.0, 0.0, 0.0]}


def test_strict_union_is_reproducible(spark):
    pos = spark.range(5).withColumnRenamed("id", "row_id")
    neg = spark.range(100, 140).withColumnRenamed("id", "row_id")
    one = {r[0] for r in PP.pos_neg_union(pos, neg, strict=True).where("label = 0").select("row_id").collect()}
    two = {r[0] for r in PP.pos_neg_union(pos, neg.repartition(7), strict=True).where("label = 0").select("row_id").collect()}
    assert one == two and len(one) == 5


def test_store_encodes_the_raw_string(spark):
    path, enc = shared_scratch(spark, "test-store"), SS.HashEncoder(8)
    keys = spark.createDataFrame([("a/b",), ("a|b",), ("plain",), ("a/b",), (None,)], "key string")
    SS.write_missing(spark, keys, path, enc)
    SS.write_missing(spark, keys, path, enc)
    rows = SS.read_store(spark, path, enc.name).collect()
    assert sorted(r["key"] for r in rows) == ["a|b", "a|b", "plain"] and len({tuple(r["vec"]) for r in rows}) == 3
    ask = spark.createDataFrame([(1, "a/b"), (2, "a|b"), (3, "new"), (4, None)], "id int, key string")
    got = {r["id"]: r for r in SS.lookup_with_fallback(spark, ask, "key", path, enc).collect()}
    import pandas as pd

    for i, k, source in ((1, "a/b", "store"), (2, "a|b", "store"), (3, "new", "encoded")):
        assert got[i]["source"] == source and got[i]["vec"] == [float(v) for v in enc.encode(pd.Series([k]))[0]]
    assert got[4]["vec"] is None and got[4]["source"] is None


def test_a_broken_store_is_an_error(spark, tmp_path):
    (tmp_path / "model=hash8").mkdir()
    (tmp_path / "model=hash8" / "part-0.parquet").write_text("not parquet")
    keys = spark.createDataFrame([("a",)], "key string")
    with pytest.raises(Exception):  # noqa: B017
        SS.write_missing(spark, keys, f"file://{tmp_path}", SS.HashEncoder(8))


def test_annotation_file(spark, tmp_path):
    lines = ["### codes", "c2\tc0\tc1", "### proteins\tcodes", "p1\tc0,c1", "p2", "p1\tc2"]
    (tmp_path / "a.tsv").write_text("\n".join(lines) + "\n")
    vocab, body = ST.read_annotation_tsv(spark, f"file://{tmp_path}/a.tsv")
    assert {tuple(r) for r in vocab.collect()} == {("c2", 0), ("c0", 1), ("c1", 2)}
    assert {r["protein"]: r["codes"] for r in J.last_lines(body, "line").collect()} == {"p1": ["c2"], "p2": []}


def test_vocabulary_rank_is_text_order(spark):
    rng = random.Random(3)
    codes = sorted({"".join(rng.choice("abcé1") for _ in range(rng.randrange(1, 12))) for _ in range(200)}, key=lambda c: c.encode())
    x = spark.createDataFrame([(c,) for c in codes + codes[:5]], "code string")
    got = {r["code"]: r["idx"] for r in ST.vocabulary_index(x).collect()}
    assert got == {c: i for i, c in enumerate(codes)}


def test_erf(spark):
    import math

    xs = [i / 50 for i in range(-400, 401)] + [0.0, 12.0, -30.0]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", SC.erf(F.col("x")).alias("e")).collect()
    assert max(abs(r["e"] - math.erf(r["x"])) for r in got) < 1e-11


def test_workers_find_the_package_from_another_folder(tmp_path):
    """The package is only on the driver's path, which is not the workers' working folder."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from seqpool.session import local_session
        from seqpool.functions.text import char_tokenize
        from pyspark.sql import functions as F
        s = local_session(2, 2)
        assert s.createDataFrame([("AC",)], "t string").select(char_tokenize(F.col("t")).alias("x")).first()[0]
        s.stop()
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-1500:]
