import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqpool.operators import metrics as M
from seqpool.operators import score as SC
from seqpool.operators import sequence as SQ
from seqpool.session import shared_scratch
from seqpool.sources import files as FS
from seqpool.sources import store as SS
from seqpool.streaming import jobs as SJ


def test_split_csv_names(spark, tmp_path):
    for name, rows in (("train.csv", ["0,a,1", "1,\"b,\"\"c\"\"\",0"]), ("val.csv", ["0,d,1"]), ("test.csv", [])):
        (tmp_path / name).write_text("\n".join([",x,y", *rows]) + "\n")
    got = {tuple(r) for r in FS.scan_split_csv(spark, f"file://{tmp_path}", "x string, y int").collect()}
    assert got == {("a", 1, "train"), ('b,"c"', 0, "train"), ("d", 1, "val")}


def test_edge_list_names(spark, tmp_path):
    for name, text in (("Intra1_pos_rr.txt", "a b\nc d\n"), ("Intra0_neg_rr.txt", "e f\n"), ("Intra2_pos_rr.txt", "g h\n")):
        (tmp_path / name).write_text(text)
    got = {tuple(r) for r in FS.scan_edge_lists(spark, f"file://{tmp_path}").collect()}
    assert got == {("a", "b", 1, "train"), ("c", "d", 1, "train"), ("e", "f", 0, "val"), ("g", "h", 1, "test")}


def test_flagged_csv_keeps_line_ends_and_quotes(spark):
    path = shared_scratch(spark, "csv")
    rows = [(1, 'two\nlines, "quoted"', "train", None), (2, "plain", "test", True)]
    x = spark.createDataFrame(rows, "id int, text string, `set` string, validation boolean")
    x.write.option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path)
    got = sorted(map(tuple, FS.scan_flagged_csv(spark, path, "id int, text string, `set` string, validation boolean").collect()))
    assert got == rows


def test_stream_encodes_each_string_once(spark):
    folder = shared_scratch(spark, "in")
    rows = [(i, f"key {i % 7}") for i in range(40)] + [(99, None)]
    x = spark.createDataFrame(rows, "id int, text string")
    x.repartition(9).write.parquet(folder)
    enc = SS.HashEncoder(8)
    out = SS.read_store(spark, SJ.stream_featurize(spark, folder, x.schema, "text", enc, files_per_trigger=2), enc.name).collect()
    assert sorted(r["key"] for r in out) == [f"key {i}" for i in range(7)]
    assert all(r["vec"] == [float(v) for v in enc.encode(pd.Series([r["key"]]))[0]] for r in out)


def test_encoders_by_name(spark):
    x = spark.createDataFrame([(1, "a"), (2, None)], "id int, k string")
    got = {r["id"]: r["vec"] for r in SS.encode_concat(x, "k", "hash8, salted4").collect()}
    assert len(got[1]) == 12 and got[2] is None
    with pytest.raises(ValueError):
        SS.get_encoders("hash8,none")


def test_interpolation_beyond_the_ends(spark):
    knots, values = F.lit([0.0, 1.0, 3.0]), F.lit([0.0, 2.0, 6.0])
    at = [-1.0, 0.0, 0.5, 1.0, 2.0, 4.0]
    got = spark.createDataFrame([(x,) for x in at], "x double").select(SQ.interp1d(knots, values, F.col("x"), eps=0.0).alias("y")).collect()
    assert [r["y"] for r in got] == [2 * x for x in at]
    one = spark.range(1).select(SQ.interp1d(F.lit([5.0]), F.lit([7.0]), F.lit(9.0)).alias("y")).first()[0]
    assert one == 7.0


def test_softmax_with_mask(spark):
    x = spark.createDataFrame([("a", 0, 1.0, True), ("a", 1, 1.0, True), ("a", 2, 9.0, False), ("b", 0, 3.0, False)], "g string, i int, v double, ok boolean")
    got = {(r["g"], r["i"]): r["softmax"] for r in SC.masked_softmax(x, ["g"], "v", valid=F.col("ok")).collect()}
    assert got == {("a", 0): 0.5, ("a", 1): 0.5, ("a", 2): 0.0, ("b", 0): 1.0}


def test_light_attention_by_hand(spark):
    import numpy as np

    tokens = spark.createDataFrame([("s", i, [float(i + 1)]) for i in range(3)], "seq_id string, pos bigint, vec array<double>")
    value = np.array([[[0.1, 0.2, 0.4, 0.2, 0.1]]])
    att = np.array([[[0.0, 0.0, 1.0, 0.0, 0.0]]])
    got = {r["pos"]: r["vec"][0] for r in SQ.conv1d_same(tokens, value, [0.0]).collect()}
    assert [round(got[i], 9) for i in range(3)] == [1.1, 1.6, 1.7]
    both = SQ.pool_light_attention(tokens, value, [0.0], att, [0.0], np.eye(2), [0.0, 0.0]).collect()
    assert {r["idx"]: round(r["value"], 6) for r in both} == {0: 1.7, 1: 1.621509}


def test_convolution_has_a_direction(spark):
    import numpy as np

    tokens = spark.createDataFrame([("s", i, [float(i + 1)]) for i in range(3)], "seq_id string, pos bigint, vec array<double>")
    ahead = np.array([[[0.0, 0.0, 0.0, 1.0, 0.0]]])  # weight of the next position
    got = {r["pos"]: r["vec"][0] for r in SQ.conv1d_same(tokens, ahead, [0.5]).collect()}
    assert got == {0: 2.5, 1: 3.5, 2: 0.5}


def test_interpolation_by_hand(spark):
    at = [0.0, 0.1, 0.25, 0.4, 0.6, 1.0]
    y = SQ.interp1d(F.lit([0.1, 0.4, 0.9]), F.lit([1.0, 4.0, 2.0]), F.col("x"))
    got = spark.createDataFrame([(x,) for x in at], "x double").select(y.alias("y")).collect()
    assert [round(r["y"], 5) for r in got] == [0.0, 1.0, 2.5, 4.0, 3.2, 1.6]


def test_gelu_by_hand(spark):
    got = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 1.0, 2.0)], "x double").select(SC.gelu(F.col("x")).alias("y")).collect()
    assert [round(r["y"], 6) for r in got] == [-0.158655, 0.0, 0.841345, 1.9545]


def test_featurisation_goes_on_where_it_ended(spark, tmp_path):
    class CountingEncoder(SS.HashEncoder):
        """Leaves a file per encoded string."""

        def __init__(self, folder):
            super().__init__(4, "counting")
            self.folder = folder

        def encode(self, keys):
            for k in keys:
                open(f"{self.folder}/{uuid.uuid4().hex}-{k}", "w").close()
            return super().encode(keys)

    folder, store, state = (shared_scratch(spark, x) for x in ("in", "store", "state"))
    enc = CountingEncoder(str(tmp_path))
    schema = "id int, text string"
    seen = lambda: sorted(p.name.split("-")[1] for p in tmp_path.iterdir())
    SS.write_missing(spark, spark.createDataFrame([("k0",)], "key string"), store, enc)  # another writer's row
    for lo in (0, 5, 5):
        rows = [(i, f"k{i}") for i in range(lo, lo + 10)] * 2
        spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(folder)
        SJ.stream_featurize(spark, folder, spark.read.parquet(folder).schema, "text", enc, 2, store, state)
        assert seen() == sorted(f"k{i}" for i in range(lo + 10))
    SJ.stream_featurize(spark, folder, spark.read.parquet(folder).schema, "text", enc, 2, store, shared_scratch(spark, "new-state"))
    rows = SS.read_store(spark, store, enc.name).collect()
    assert sorted(r["key"] for r in rows) == sorted(f"k{i}" for i in range(15)) and len(seen()) == 15


def test_rank_metrics_of_a_stream(spark):
    folder, table, state = (shared_scratch(spark, x) for x in ("in", "counts", "state"))
    schema = "g string, score double, label int"
    rows = [(["a", "b", None][i % 3], [None, float("nan"), (i * 37 % 23) / 23][min(i, 2)], [0, 1, None][i % 7 % 3]) for i in range(300)]
    for half in (rows[:200], rows[200:]):
        spark.createDataFrame(half, schema).repartition(4).write.mode("append").parquet(folder)
        counts = SJ.stream_score_counts(spark, folder, spark.read.parquet(folder).schema, group=["g"], files_per_trigger=2, table=table, checkpoint=state)
    curve = M.curve_of_counts(counts, ["g"])
    whole = spark.createDataFrame(rows, schema)
    got = {r["g"]: r for r in M.average_precision_of(curve, ["g"]).collect()}, {r["g"]: r for r in M.auroc_of(curve, ["g"]).collect()}
    for r in M.average_precision(whole, group=["g"]).collect():
        assert got[0][r["g"]]["average_precision"] == pytest.approx(r["average_precision"])
    for r in M.auroc(whole, group=["g"]).collect():
        assert got[1][r["g"]]["auroc"] == pytest.approx(r["auroc"])
    assert set(got[0]) == {"a", "b", None}
