"""Convolution and light attention along positions, with the sequence cut at every place."""

import numpy as np
import pytest

from seqpool.operators import sequence as SQ

D, OUT = 3, 2


def rows(rng):
    sets = {None: range(7), "a": range(1), "b": range(40), "c": [0, 1, 5, 6, 7, 30, 31], "d": range(-3, 9)}
    return {k: {int(p): rng.normal(size=D) for p in places} for k, places in sets.items()}


def frame(spark, sets):
    x = [(k, p, v.tolist()) for k, own in sets.items() for p, v in own.items()]
    return spark.createDataFrame(x, "seq_id string, pos int, vec array<double>").repartition(5)


def convolved(own, weight, bias):
    reach = weight.shape[2] // 2
    return {p: bias + sum((weight[:, :, k] @ own[p + k - reach] for k in range(weight.shape[2]) if p + k - reach in own), np.zeros(len(bias)))
            for p in own}


@pytest.mark.parametrize("block", [1, 2, 3, 7, 512])
@pytest.mark.parametrize("width", [1, 3, 5])
def test_convolution_in_blocks(spark, block, width):
    rng = np.random.default_rng(block * width)
    sets, weight, bias = rows(rng), rng.normal(size=(OUT, D, width)), rng.normal(size=OUT)
    got = {(r["seq_id"], r["pos"]): r["vec"] for r in SQ.conv1d_same(frame(spark, sets), weight, bias, block=block).collect()}
    want = {(k, p): v for k, own in sets.items() for p, v in convolved(own, weight, bias).items()}
    assert set(got) == set(want) and all(np.allclose(got[x], want[x]) for x in want)


@pytest.mark.parametrize("block", [1, 4, 512])
def test_light_attention_in_blocks(spark, block):
    rng = np.random.default_rng(block)
    sets = rows(rng)
    wv, wa = rng.normal(size=(2, D, D, 5))
    bv, ba = rng.normal(size=(2, D)) * [[1], [300]]  # large attention values: sums stay relative to the maximum
    layer, offset = rng.normal(size=(D, 2 * D)), rng.normal(size=D)
    got = SQ.pool_light_attention(frame(spark, sets), wv, bv, wa, ba, layer, offset, block=block).collect()
    want = {}
    for k, own in sets.items():
        v, a = (np.stack(list(convolved(own, w, b).values())) for w, b in ((wv, bv), (wa, ba)))
        e = np.exp(a - a.max(axis=0))
        want[k] = layer @ np.concatenate([v.max(axis=0), (e * v).sum(axis=0) / e.sum(axis=0)]) + offset
    assert len(got) == D * len(sets)
    assert all(r["value"] == pytest.approx(want[r["seq_id"]][r["idx"]], rel=1e-9) for r in got)
