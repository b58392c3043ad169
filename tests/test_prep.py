import numpy as np
from pyspark.sql import functions as F

from seqpool.functions import text as TX
from seqpool.operators import infer as IN
from seqpool.operators import labels as LB
from seqpool.operators import prep as PP
from seqpool.operators import score as SC
from seqpool.sources import text as ST


def test_nullsafe_split(spark):
    df = spark.createDataFrame([("train", True), ("train", False), ("train", None), ("test", True)],
                               "set string, validation boolean")
    assert [r[0] for r in df.select(PP.nullsafe_split(df)).collect()] == ["val", "train", "train", "test"]


def test_first_appearance_index(spark):
    df = spark.createDataFrame([(0, "b"), (1, "a"), (2, "b"), (3, "c")], "row_id long, cls string")
    idx = {r.cls: r.idx for r in PP.first_appearance_index(df, "cls", "row_id").collect()}
    assert idx == {"b": 0, "a": 1, "c": 2}


def test_tokenizer_and_key(spark):
    df = spark.createDataFrame([("MJK", "a/b")], "s string, k string")
    r = df.select(TX.char_tokenize(F.col("s")).alias("ids"), TX.sanitize_key(F.col("k")).alias("key")).first()
    assert list(r.ids) == [3, 16, 14, 4] and r.key == "a|b"


def test_class_weights(spark):
    ann = spark.createDataFrame([("p1", ["x", "x", "y"]), ("p2", ["x"]), ("p3", [])], "protein string, codes array<string>")
    vocab = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "code string, idx long")
    w = {r.code: (r.freq, r.weight) for r in LB.class_weights(ann, vocab).collect()}
    assert w == {"x": (3, 1.0), "y": (1, 3.0), "z": (0, None)}




def test_scalars(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (1.0,), (2.0,)], "x double")
    g = [round(r[0], 6) for r in df.select(SC.gelu(F.col("x"))).collect()]
    assert g == [-0.158655, 0.0, 0.841345, 1.9545]
    assert round(df.select(SC.elu(F.col("x"))).first()[0], 6) == -0.632121


def test_schedules(spark):
    hist = spark.createDataFrame([("r", e, v) for e, v in enumerate([.5, .6, .7, .7, .7, .8])], "run_id string, epoch long, v double")
    lo = [round(r.lr, 10) for r in SC.plateau_schedule(hist, 1e-3, .6, 1, "min").orderBy("epoch").collect()]
    hi = [round(r.lr, 10) for r in SC.plateau_schedule(hist, 1e-3, .6, 1, "max").orderBy("epoch").collect()]
    assert lo == [1e-3, 1e-3, 6e-4, 6e-4, 3.6e-4, 3.6e-4]
    assert hi == [1e-3, 1e-3, 1e-3, 1e-3, 6e-4, 6e-4]
    ep = spark.createDataFrame([(e,) for e in (0, 1, 5, 9, 10)], "epoch long")
    lr = [r[0] for r in ep.select(SC.cosine_restart_lr(F.col("epoch"), 1e-4, 10)).collect()]
    assert np.allclose(lr, [1e-4, 9.7553e-05, 5e-05, 2.447e-06, 1e-4], rtol=1e-4, atol=0)


def test_checkpoint_selection(spark):
    h = spark.createDataFrame([("r", e, v) for e, v in enumerate([-0.1, 0.7, 0.7, 0.8])], "run_id string, epoch long, v double")
    assert [r.epoch for r in SC.checkpoint_events(h).orderBy("epoch").collect()] == [1, 3]
    h2 = spark.createDataFrame([("r", e, v) for e, v in enumerate([.5, .7, .7])], "run_id string, epoch long, v double")
    assert SC.best_epoch(h2).first().best_epoch == 1


def test_fasta_file_scan(spark, tmp_path):
    p = tmp_path / "a.fasta"
    p.write_text(">id1 first\nMKT\nAYI\n>id2 x\nGG\n>id1 again\nLLL\n")
    recs = ST.fasta_records(ST.read_fasta_records(spark, str(p)))
    got = {r.acc: r.seq for r in recs.collect()}
    assert got == {"id1": "LLL", "id2": "GG"}  # later duplicate wins
    lines = ST.fasta_lines(spark.read.option("lineSep", "\n>").text(str(p)))
    assert [(r.name, r.line_no, r.seq) for r in lines.collect()][:2] == [("id1 first", 0, "MKT"), ("id1 first", 1, "AYI")]


def test_fasta_records_are_taken_apart_once(spark):
    x = spark.createDataFrame([(">a b \nMK\n\n T \n",), (">c",), (None,), ("d\nGG",)], "value string")
    lines = ST.fasta_lines(x)
    assert sorted(map(tuple, lines.collect())) == [("a b", 0, "MK"), ("a b", 1, "T"), ("d", 0, "GG")]
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate", 1)
    assert "regexp_replace" not in above and "Filter" not in below


def test_annotation_tsv(spark, tmp_path):
    p = tmp_path / "annot.tsv"
    p.write_text("### header\nx\ty\tz\n### proteins\np1\tx,x,y\np2\tx\np3\n")
    vocab, ann = ST.read_annotation_tsv(spark, str(p))
    assert {r.code: r.idx for r in vocab.collect()} == {"x": 0, "y": 1, "z": 2}
    assert {r.protein: list(r.codes) for r in ann.collect()} == {"p1": ["x", "x", "y"], "p2": ["x"], "p3": []}


def test_center_positions(spark):
    rows = [(0, [[1.0, 2.0, 3.0], [3.0, 2.0, -1.0]]), (1, []), (2, None), (3, [[5.0, 5.0, 5.0]])]
    x = spark.createDataFrame(rows, "id int, pos array<array<double>>")
    got = {r["id"]: r["c"] for r in x.select("id", PP.center_positions(F.col("pos")).alias("c")).collect()}
    assert got == {0: [[-1.0, 0.0, 2.0], [1.0, 0.0, -2.0]], 1: [], 2: None, 3: [[0.0, 0.0, 0.0]]}
    plan = x.select(PP.center_positions(F.col("pos")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_centring_evaluates_its_positions_once(spark):
    x = spark.createDataFrame([([1.0, 4.0],)], "v array<double>")
    c = x.select(PP.center_positions(F.transform("v", lambda v: F.array(F.sqrt(v), v))).alias("c"))
    assert c.first()["c"] == [[-0.5, -1.5], [0.5, 1.5]]
    assert c._jdf.queryExecution().optimizedPlan().toString().count("SQRT") == 1


def test_union_of_splits(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x")], "id int, s string")
    b = spark.createDataFrame([(2, "y", 0.5)], "id int, s string, extra double")
    got = sorted(map(tuple, PP.union_splits({"train": a, "val": b, "test": a.limit(0)}).select("id", "s", "extra", "split").collect()))
    assert got == [(1, "x", None, "train"), (1, "x", None, "train"), (2, "y", 0.5, "val")]


def test_batch_scores(spark):
    """The model on batches of a few rows gives what the column expression gives; null vectors give null."""
    rng = np.random.default_rng(4)
    w1, w2 = rng.normal(size=(5, 6)), rng.normal(size=(3, 5))
    stats = {"mean1": rng.normal(size=6), "var1": rng.uniform(1, 2, 6), "mean2": rng.normal(size=5), "var2": rng.uniform(1, 2, 5)}
    rows = [(i, [float(v) for v in rng.normal(size=6)] if i % 7 else None) for i in range(50)]
    x = spark.createDataFrame(rows, "id int, vec array<double>").repartition(3)
    score = IN.batch_scorer(IN.multilabel_model(w1, w2, **stats), 6, batch_bytes=200)
    got = x.select("id", score(F.col("vec")).alias("a"), SC.multilabel_mlp(F.col("vec"), w1, w2, **stats).alias("b")).collect()
    assert len(got) == 50
    for r in got:
        assert (r["a"] is None) == (r["id"] % 7 == 0)
        assert r["a"] is None or np.allclose(r["a"], r["b"])
    assert x.where("false").select(score(F.col("vec")).alias("a")).collect() == []
