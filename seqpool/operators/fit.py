"""Fits of small heads on stored vectors, and their parameters on disk."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_class_head(vectors: DataFrame, vec: str = "vec", label: str = "label", max_iter: int = 30, reg: float = 1e-3) -> PipelineModel:
    """Multinomial logistic regression (the convex optimum of the linear head) over all labelled vectors."""
    x = vectors.where(F.col(label).isNotNull()).select(
        array_to_vector(F.col(vec).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    head = LogisticRegression(family="multinomial", maxIter=max_iter, regParam=reg)
    return Pipeline(stages=[head]).fit(x)


def save_parameters(model: PipelineModel, path: str) -> None:
    """The fitted parameters under ``path`` in the shared folder."""
    model.write().overwrite().save(path)


def load_parameters(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def predict_class(model: PipelineModel, vectors: DataFrame, key: str, vec: str = "vec") -> DataFrame:
    x = vectors.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("features"))
    return model.transform(x).select(key, F.col("prediction").cast("bigint").alias("pred"))


# --------------------------------------------------------------------------------------- gradient fits


class AdamW:
    """One update rule for a dict of small arrays (they are the model's parameters, not data)."""

    def __init__(self, lr: float, decay: float = 0.01, betas=(0.9, 0.999), eps: float = 1e-8):
        self.lr, self.decay, self.betas, self.eps = lr, decay, betas, eps
        self.t, self.m, self.v = 0, {}, {}

    def update(self, params: dict, grads: dict) -> dict:
        self.t += 1
        out = {}
        for k, p in params.items():
            self.m[k] = self.betas[0] * self.m.get(k, 0.0) + (1 - self.betas[0]) * grads[k]
            self.v[k] = self.betas[1] * self.v.get(k, 0.0) + (1 - self.betas[1]) * grads[k] ** 2
            m = self.m[k] / (1 - self.betas[0] ** self.t)
            v = self.v[k] / (1 - self.betas[1] ** self.t)
            out[k] = p * (1 - self.lr * self.decay) - self.lr * m / (np.sqrt(v) + self.eps)
        return out


def fit_by_gradient(rows: DataFrame, params: dict[str, np.ndarray], partial: Callable, steps: int, lr: float) -> tuple[dict, list[float]]:
    """Full-batch steps: every task adds up its rows' gradients in numpy, Spark sums them per parameter, the driver updates.

    ``partial(batch, params)`` gives (loss sum, rows, gradient sums).  Only sums, one per parameter entry, reach the driver.
    ``rows`` is read once per step and should be a written table."""
    rule, losses = AdamW(lr), []
    for _ in range(steps):
        loss, n, grads = gradient_sums(rows, params, partial)
        if n == 0:
            break
        losses.append(loss / n)
        params = rule.update(params, {k: g / n for k, g in grads.items()})
    return params, losses


def gradient_sums(rows: DataFrame, params: dict[str, np.ndarray], partial: Callable) -> tuple[float, int, dict]:
    """(loss sum, rows, gradient sums) of ``rows``: a partial sum per task, then one sum per parameter entry."""
    names = list(params)

    def run(batches):
        loss, n, total = 0.0, 0, {k: np.zeros_like(v) for k, v in params.items()}
        for b in batches:
            one, m, grads = partial(b, params)
            loss, n = loss + one, n + m
            for k in names:
                total[k] += grads[k]
        flat = np.concatenate([[loss, float(n)], *[total[k].ravel() for k in names]])
        yield pd.DataFrame({"i": np.arange(len(flat)), "g": flat})

    sums = rows.mapInPandas(run, "i bigint, g double").groupBy("i").agg(F.sum("g").alias("g")).orderBy("i").collect()
    flat = np.array([r["g"] for r in sums])
    if not len(flat):
        return 0.0, 0, {k: np.zeros_like(v) for k, v in params.items()}
    at, grads = 2, {}
    for k in names:
        grads[k] = flat[at: at + params[k].size].reshape(params[k].shape)
        at += params[k].size
    return float(flat[0]), int(flat[1]), grads


PAIRS_AT_ONCE = 1 << 15  # pairs whose narrow vectors are held at a time


def _pair_sets(batch: pd.DataFrame):
    """(drug vectors, target vectors, row of each pair in both, labels): of a batch of pairs, or of each block in a batch."""
    if "drug_at" not in batch:
        own = np.arange(len(batch))
        yield np.stack(batch["drug_vec"].to_numpy()), np.stack(batch["target_vec"].to_numpy()), own, own, batch["label"].to_numpy(dtype=np.float64)
        return
    for r in batch.itertuples():
        a, b = (np.frombuffer(v, r.kind).reshape(n, -1) for v, n in ((r.drug_vecs, r.n_drugs), (r.target_vecs, r.n_targets)))
        at, bt = (np.frombuffer(v, np.int32) for v in (r.drug_at, r.target_at))
        yield a.astype(np.float64), b.astype(np.float64), at, bt, np.frombuffer(r.label, np.float64)


def _added(total: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Add each of ``values`` to its row of ``total``."""
    for k in range(values.shape[1]):
        total[:, k] += np.bincount(rows, values[:, k], len(total))


def set_sums(a: np.ndarray, b: np.ndarray, at: np.ndarray, bt: np.ndarray, y: np.ndarray, params: dict, of_pairs: Callable, unit: bool) -> tuple:
    """(loss sum, its gradients by Wd a and by Wt b) over the pairs (at, bt) of vectors ``a`` and ``b``.

    The loss of a pair is a function of s = u . v, where u = relu(Wd a) and v = relu(Wt b), of length one if ``unit``.  Vectors are
    projected once each; a pair costs a dot product, and adds ds v and ds u to the sums of its two vectors.
    ``of_pairs(s, y)`` gives (loss sum, ds)."""
    h, g = a @ params["drug"].T, b @ params["target"].T
    u, v = np.maximum(h, 0), np.maximum(g, 0)
    if unit:
        nh, ng = (np.maximum(np.linalg.norm(x, axis=1), 1e-8)[:, None] for x in (u, v))
        u, v = u / nh, v / ng
    loss, du, dv = 0.0, np.zeros((len(u), u.shape[1] + unit)), np.zeros((len(v), v.shape[1] + unit))
    for i in range(0, len(y), PAIRS_AT_ONCE):
        p, q = at[i:i + PAIRS_AT_ONCE], bt[i:i + PAIRS_AT_ONCE]
        up, vq = u[p], v[q]
        s = np.einsum("ij,ij->i", up, vq)
        one, ds = of_pairs(s, y[i:i + PAIRS_AT_ONCE])
        loss += float(one)
        along = [(ds * s)[:, None]] if unit else []
        _added(du, p, np.hstack([ds[:, None] * vq, *along]))
        _added(dv, q, np.hstack([ds[:, None] * up, *along]))
    if unit:  # what points along a vector does not change its direction
        du, dv = (du[:, :-1] - du[:, -1:] * u) / nh, (dv[:, :-1] - dv[:, -1:] * v) / ng
    return loss, du * (h > 0), dv * (g > 0)


def _pair_sums(batch: pd.DataFrame, params: dict, of_pairs: Callable, unit: bool) -> tuple[float, int, dict]:
    """``set_sums`` of the pairs of a batch, as gradients of the projectors."""
    loss, n, grads = 0.0, 0, {k: np.zeros_like(params[k], dtype=np.float64) for k in ("drug", "target")}
    for a, b, at, bt, y in _pair_sets(batch):
        one, dh, dg = set_sums(a, b, at, bt, y, params, of_pairs, unit)
        loss, n = loss + one, n + len(y)
        grads["drug"] += dh.T @ a
        grads["target"] += dg.T @ b
    return loss, n, grads


def cosine_bce(c: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """BCE of cosines clipped inside (0, 1), and its derivative by each."""
    p = np.clip(c, 1e-6, 1 - 1e-6)
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    return loss, np.where((c > 1e-6) & (c < 1 - 1e-6), (p - y) / (p * (1 - p)), 0.0)


def pair_cosine_bce(batch: pd.DataFrame, params: dict) -> tuple[float, int, dict]:
    """T1 with BCE: cosine of relu(Wd a) and relu(Wt b), clipped inside (0, 1)."""
    return _pair_sums(batch, params, cosine_bce, unit=True)


def pair_inner_mse(batch: pd.DataFrame, params: dict) -> tuple[float, int, dict]:
    """T2 with MSE: inner product of relu(Wd a) and relu(Wt b)."""
    return _pair_sums(batch, params, lambda s, y: (((s - y)**2).sum(), 2 * (s - y)), unit=False)


def fit_pair_head(pairs: DataFrame, drug: np.ndarray, target: np.ndarray, loss: str = "bce", steps: int = 8, lr: float = 1e-2):
    """(parameters, loss before each step); pooling is frozen.  ``pairs``: drug_vec, target_vec, label, or the blocks
    of ``joins.pair_blocks``."""
    partial = {"bce": pair_cosine_bce, "mse": pair_inner_mse}[loss]
    return fit_by_gradient(pairs, {"drug": drug, "target": target}, partial, steps, lr)


def multilabel_bce(weights: np.ndarray, slope: float = 0.2):
    """T8's loss: label-weighted BCE of the logits W2 leaky(W1 leaky(x)), averaged over labels."""
    def partial(batch: pd.DataFrame, params: dict) -> tuple[float, int, dict]:
        x, y = np.stack(batch["vec"].to_numpy()), np.stack(batch["targets"].to_numpy()).astype(np.float64)
        x = np.where(x >= 0, x, slope * x)
        u = x @ params["w1"].T
        h = np.where(u >= 0, u, slope * u)
        z = h @ params["w2"].T
        loss = (weights * (np.logaddexp(0, z) - y * z)).mean(axis=1).sum()
        dz = weights * (1 / (1 + np.exp(-z)) - y) / y.shape[1]
        du = (dz @ params["w2"]) * np.where(u >= 0, 1.0, slope)
        return float(loss), len(y), {"w1": du.T @ x, "w2": dz.T @ h}

    return partial


def fit_multilabel_head(rows: DataFrame, w1: np.ndarray, w2: np.ndarray, weights: np.ndarray, steps: int = 8, lr: float = 1e-2):
    """(parameters, loss before each step).  ``rows``: vec, targets (0/1 per label); the backbone is frozen."""
    return fit_by_gradient(rows, {"w1": w1, "w2": w2}, multilabel_bce(weights), steps, lr)
