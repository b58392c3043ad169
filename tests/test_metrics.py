import numpy as np
from pyspark.sql import functions as F

from seqpool.operators import metrics as M
from seqpool.plans.prefix import running_sums

SCORES = [.9, .8, .8, .3, .2]
LABELS = [1, 0, 1, 0, 1]


def _preds(spark):
    return spark.createDataFrame([(i, s, l) for i, (s, l) in enumerate(zip(SCORES, LABELS))],
                                 "row_id long, score double, label long")


def test_binary_golden(spark):
    p = _preds(spark)
    assert abs(M.average_precision(p).first()[0] - 0.755556) < 1e-6
    assert abs(M.auroc(p).first()[0] - 0.583333) < 1e-6
    c = M.binary_confusion(p).first()
    assert (c.tp, c.fp, c.fn, c.tn) == (2, 1, 1, 1)
    assert abs(c.accuracy - .6) < 1e-9 and abs(c.f1 - 2 / 3) < 1e-9 and abs(c.specificity - .5) < 1e-9
    assert abs(c.mcc - 0.166667) < 1e-6
    assert abs(M.loss_bce(p).first()[0] - 0.780811) < 1e-6
    r = M.regression(p.select(F.col("score").alias("p"), F.col("label").cast("double").alias("y"))).first()
    assert abs(r.mse - 0.284) < 1e-9 and abs(r.pearson - 0.140859) < 1e-6


def test_multilabel_golden(spark):
    sc = [[.9, .4, .1], [.2, .7, .6]]
    tg = [[1, 0, 1], [0, 1, 1]]
    rows = [(p, l, sc[p][l], tg[p][l]) for p in range(2) for l in range(3)]
    df = spark.createDataFrame(rows, "protein long, label long, score double, target long")
    assert abs(M.f1_max(df).first()[0] - 0.857143) < 1e-6
    assert abs(M.average_precision(df, "score", "target").first()[0] - 0.916667) < 1e-6
    assert abs(M.auroc(df, "score", "target").first()[0] - 0.75) < 1e-9


def test_cross_entropy_and_accuracy(spark):
    df = spark.createDataFrame([([2.0, 1.0, 0.0], 0), ([0.0, 1.0, 3.0], 2), ([1.0, 1.0, 0.0], 1)],
                               "logits array<double>, label long")
    assert abs(M.loss_cross_entropy(df).first()[0] - 0.479815) < 1e-6
    assert abs(M.multiclass_accuracy(df).first()[0] - 2 / 3) < 1e-6  # first max wins the tie


def test_weighted_bce(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 1), (0, 1, 2.0, 0), (1, 0, -1.0, 0), (1, 1, 1.0, 1)],
                               "protein long, label long, score double, target long")
    w = spark.createDataFrame([(0, 2.0), (1, .5)], "label long, weight double")
    assert abs(M.loss_weighted_bce(df, w).first()[0] - 0.808228) < 1e-6


def test_running_sums_bucket_invariant(spark):
    rng = np.random.default_rng(1)
    rows = [(float(x), 1.0) for x in rng.integers(0, 50, size=400)]
    df = spark.createDataFrame(rows, "s double, v double").groupBy("s").agg(F.sum("v").alias("v"))
    a = {r.s: r.cum_v for r in running_sums(df, "s", ["v"], rows_per_bucket=1 << 20).collect()}
    b = {r.s: r.cum_v for r in running_sums(df, "s", ["v"], rows_per_bucket=5).collect()}
    assert a == b
    top = max(a)
    assert a[top] == sum(1 for x, _ in rows if x == top)
