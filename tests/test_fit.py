import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqpool.operators import fit as FT
from seqpool.operators import joins as J
from seqpool.session import shared_scratch


def batch(rng, n=7, d=5, labels=3):
    return pd.DataFrame({
        "drug_vec": list(rng.normal(size=(n, d))), "target_vec": list(rng.normal(size=(n, d))), "label": rng.integers(0, 2, n),
        "vec": list(rng.normal(size=(n, d))), "targets": list(rng.integers(0, 2, (n, labels)))})


@pytest.mark.parametrize("kind", ["bce", "mse", "labels"])
def test_gradients_against_differences(kind):
    rng = np.random.default_rng(4)
    b = batch(rng)
    if kind == "labels":
        partial, params = FT.multilabel_bce(np.array([1.0, 2.0, 0.5])), {"w1": rng.normal(size=(4, 5)), "w2": rng.normal(size=(3, 4))}
    else:
        partial = {"bce": FT.pair_cosine_bce, "mse": FT.pair_inner_mse}[kind]
        params = {"drug": rng.normal(size=(4, 5)), "target": rng.normal(size=(4, 5))}
    _, n, grads = partial(b, params)
    assert n == len(b)
    for k in params:
        for i in np.ndindex(params[k].shape):
            up, down = {x: v.copy() for x, v in params.items()}, {x: v.copy() for x, v in params.items()}
            up[k][i] += 1e-6
            down[k][i] -= 1e-6
            slope = (partial(b, up)[0] - partial(b, down)[0]) / 2e-6
            assert abs(slope - grads[k][i]) < 1e-4 * max(1.0, abs(slope))


def test_fit_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(rng.normal(size=5).tolist(), rng.normal(size=5).tolist(), int(i % 2)) for i in range(60)]
    x = spark.createDataFrame(rows, "drug_vec array<double>, target_vec array<double>, label int")
    start = np.abs(rng.normal(size=(4, 5)))
    one, a = FT.fit_pair_head(x.coalesce(1), start, start, "mse", steps=5, lr=0.05)
    two, b = FT.fit_pair_head(x.repartition(6), start, start, "mse", steps=5, lr=0.05)
    assert np.allclose(a, b) and np.allclose(one["drug"], two["drug"]) and a[-1] < a[0]
    _, none = FT.fit_pair_head(x.where("false"), start, start, "mse", steps=2)
    assert none == []


@pytest.mark.parametrize("grid_from", [0, 1 << 20])
def test_blocks_have_the_sums_of_their_pairs(spark, grid_from):
    rng = np.random.default_rng(9)
    rows = [(None if a == 0 else int(a) if a < 40 else 1, None if b == 0 else int(b), int(i % 2))
            for i, (a, b) in enumerate(zip(rng.integers(0, 60, 2000), rng.integers(0, 30, 2000), strict=True))]
    pairs = spark.createDataFrame(rows, "drug_key bigint, target_key bigint, label int")
    features = spark.createDataFrame([(i, rng.normal(size=5).tolist()) for i in range(36)] + [(36, None)], "key bigint, vec array<double>")
    params = {"drug": np.abs(rng.normal(size=(4, 5))), "target": np.abs(rng.normal(size=(4, 5)))}
    whole = J.pair_features(pairs, features).where("drug_vec IS NOT NULL AND target_vec IS NOT NULL")
    blocks = J.pair_blocks(pairs, features, grid_from=grid_from)
    if grid_from == 0:
        assert blocks.agg(F.sum("n_drugs")).first()[0] < whole.count() / 2
    for partial in (FT.pair_cosine_bce, FT.pair_inner_mse):
        loss, n, grads = FT.gradient_sums(blocks, params, partial)
        loss_, n_, grads_ = FT.gradient_sums(whole.select("drug_vec", "target_vec", "label"), params, partial)
        assert n == n_ == whole.count() and np.isclose(loss, loss_)
        assert all(np.allclose(grads[k], grads_[k]) for k in params)
    unlabelled = J.pair_blocks(pairs.withColumn("label", F.expr("nullif(label, 1)")), features, grid_from=grid_from)
    with pytest.raises(Exception, match="without a label"):
        unlabelled.collect()


def test_class_head_is_the_same_after_loading(spark):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=4) + 3 * np.eye(4)[i % 3]).tolist(), i % 3) for i in range(150)] + [(999, [0.0] * 4, None)]
    x = spark.createDataFrame(rows, "id bigint, vec array<double>, label int")
    model = FT.fit_class_head(x)
    path = shared_scratch(spark, "head")
    FT.save_parameters(model, path)
    one = FT.predict_class(model, x, "id")
    two = FT.predict_class(FT.load_parameters(path), x, "id").withColumnRenamed("pred", "p2")
    assert one.join(two, "id").where("pred <> p2").count() == 0 and one.count() == 151
    assert one.join(x, "id").where(F.col("pred") == F.col("label")).count() > 135
