"""Scoring heads and epoch-history operators (schedules, checkpoint selection).

Heads are column expressions over feature vectors with small broadcast parameter arrays;
epoch histories are per-run windows (a run's history is bounded by its epoch count).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpool.functions.vec import cosine, dot, lit_vector, matvec


# ------------------------------------------------------------------------------ activations (H7, H8)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def leaky_relu(x: Column, slope: float = 0.2) -> Column:
    return F.when(x >= 0, x).otherwise(x * F.lit(slope))


def elu(x: Column, alpha: float = 1.0) -> Column:
    return F.when(x > 0, x).otherwise(F.lit(alpha) * (F.exp(x) - F.lit(1.0)))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


ERF_SWITCH, ERF_TERMS, ERF_LEVELS = 2.5, 40, 40


def erf(x: Column) -> Column:
    """The error function as a column expression (Spark has none): Taylor series near zero, continued fraction beyond."""
    a = F.abs(x)
    t = -a * a
    series = F.lit(1.0 / (math.factorial(ERF_TERMS) * (2 * ERF_TERMS + 1)))
    for n in range(ERF_TERMS - 1, -1, -1):  # sum of t**n / (n! (2n + 1)), by Horner's rule
        series = F.lit(1.0 / (math.factorial(n) * (2 * n + 1))) + t * series
    near = F.lit(2.0 / math.sqrt(math.pi)) * a * series
    far_x = F.greatest(a, F.lit(ERF_SWITCH))
    tail = far_x
    for n in range(ERF_LEVELS, 0, -1):
        tail = far_x + F.lit(n / 2.0) / tail
    far = F.lit(1.0) - F.exp(-far_x * far_x) / (F.lit(math.sqrt(math.pi)) * tail)
    return F.signum(x) * F.when(a < ERF_SWITCH, near).otherwise(far)


def gelu(x: Column) -> Column:
    """GELU(x) = x * Phi(x) with the exact erf."""
    return F.lit(0.5) * x * (F.lit(1.0) + erf(x / F.lit(math.sqrt(2.0))))


def logistic(x: Column, x0: float = 0.0, k: float = 1.0) -> Column:
    """H8: 1 / (1 + exp(-k (x - x0))) clamped to [0, 1]."""
    y = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-k) * (x - F.lit(x0))))
    return F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0))


ACTIVATIONS = {"relu": relu, "elu": elu, "sigmoid": sigmoid, "leaky_relu": leaky_relu, "gelu": gelu}


def act_vec(v: Column, name: str) -> Column:
    f = ACTIVATIONS[name]
    return F.transform(v, lambda x: f(x))


# ------------------------------------------------------------------------------ heads


def project(v: Column, w: np.ndarray, b: np.ndarray | None = None, act: str | None = None) -> Column:
    """H6 (+H7): act(W v + b) with a literal parameter matrix."""
    z = matvec(w, v, b)
    return act_vec(z, act) if act else z


def score_cosine(drug_vec: Column, target_vec: Column, w_drug: np.ndarray, w_target: np.ndarray,
                 act: str = "relu") -> Column:
    """Cosine of the two projected embeddings (clamped to [-1, 1])."""
    return cosine(project(drug_vec, w_drug, act=act), project(target_vec, w_target, act=act))


def score_inner(drug_vec: Column, target_vec: Column, w_drug: np.ndarray, w_target: np.ndarray,
                act: str = "relu") -> Column:
    """Inner product of the two projected embeddings (regression head)."""
    return dot(project(drug_vec, w_drug, act=act), project(target_vec, w_target, act=act))


def class_logits(v: Column, w: np.ndarray, b: np.ndarray | None = None) -> Column:
    """T4: linear class logits."""
    return matvec(w, v, b)


def argmax_first(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def multilabel_mlp(v: Column, w1: np.ndarray, w2: np.ndarray, mean1=None, var1=None, mean2=None, var2=None,
                   eps: float = 1e-5) -> Column:
    """T5 (evaluation form): norm -> LeakyReLU -> linear -> norm -> LeakyReLU -> linear, with stored
    batch-norm statistics (default mean 0, variance 1)."""
    def norm(x, mean, var, d):
        mu = lit_vector(mean if mean is not None else np.zeros(d))
        sd = lit_vector(np.sqrt((var if var is not None else np.ones(d)) + eps))
        return F.zip_with(F.zip_with(x, mu, lambda a, b: a - b), sd, lambda a, b: a / b)

    d0 = np.asarray(w1).shape[1]
    d1 = np.asarray(w1).shape[0]
    h = F.transform(norm(v, mean1, var1, d0), lambda x: leaky_relu(x))
    h = matvec(w1, h)
    h = F.transform(norm(h, mean2, var2, d1), lambda x: leaky_relu(x))
    return matvec(w2, h)


def batch_norm(long_df: DataFrame, key: str, dim: str, value: str, eps: float = 1e-5) -> DataFrame:
    """H17 training form: per-dimension mean / population variance over all rows.

    Statistics come from a partial aggregate per dimension (d rows) joined back;
    no window over a whole dimension (that would put every row of a dimension in one task)."""
    stats = long_df.groupBy(dim).agg(F.avg(value).alias("_mu"), F.var_pop(value).alias("_var"))
    j = long_df.join(stats, dim)
    return j.select(key, dim, ((F.col(value) - F.col("_mu")) / F.sqrt(F.col("_var") + F.lit(eps))).alias("value"))


def masked_softmax(long_df: DataFrame, group: list[str], value: str, valid: Column | None = None,
                   fill: float = -1e10, out: str = "softmax") -> DataFrame:
    """``out``, the softmax over the rows of each group; masked rows take ``fill`` before the softmax.

    The maximum and the sum of a group are partial aggregates joined back; a group's rows meet in one task of the join,
    unless the aggregate is small enough to broadcast."""
    x = F.col(value) if valid is None else F.when(valid, F.col(value)).otherwise(F.lit(fill))
    rows = long_df.withColumn("_x", x)
    top = rows.groupBy(*group).agg(F.max("_x").alias("_top"))
    rows = rows.join(top, group).withColumn("_e", F.exp(F.col("_x") - F.col("_top")))
    total = rows.groupBy(*group).agg(F.sum("_e").alias("_total"))
    return rows.join(total, group).withColumn(out, F.col("_e") / F.col("_total")).drop("_x", "_top", "_e", "_total")


# ------------------------------------------------------------------------------ epoch histories


def checkpoint_events(hist: DataFrame, run: str = "run_id", epoch: str = "epoch", value: str = "v",
                      initial: float = 0.0) -> DataFrame:
    """Epochs whose watched value is strictly above every earlier value and the initial best (Q18)."""
    w = Window.partitionBy(run).orderBy(epoch).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.coalesce(F.greatest(F.max(value).over(w), F.lit(initial)), F.lit(initial))
    return hist.withColumn("_prev", prev).where(F.col(value) > F.col("_prev")).drop("_prev")


def best_epoch(hist: DataFrame, run: str = "run_id", epoch: str = "epoch", value: str = "v") -> DataFrame:
    """Best epoch per run, earliest on ties."""
    return hist.groupBy(run).agg(
        F.max_by(F.col(epoch), F.struct(F.col(value), -F.col(epoch))).alias("best_epoch"),
        F.max(value).alias("best_v"))


def cosine_restart_lr(epoch: Column, lr: float, t0: int) -> Column:
    """Lr / 2 * (1 + cos(pi * (epoch mod T0) / T0))."""
    return F.lit(lr / 2.0) * (F.lit(1.0) + F.cos(F.lit(math.pi) * (epoch % t0) / F.lit(float(t0))))


def plateau_schedule(hist: DataFrame, lr: float, factor: float = 0.6, patience: int = 5, mode: str = "min",
                     threshold: float = 1e-4, min_lr: float = 0.0, run: str = "run_id", epoch: str = "epoch",
                     value: str = "v") -> DataFrame:
    """Learning rate after each epoch's scheduler step (relative threshold, no cooldown).

    A sequential fold per run over its ordered history (the history is one small array per run)."""
    better = ((lambda a, best: a < best * F.lit(1.0 - threshold)) if mode == "min"
              else (lambda a, best: a > best * F.lit(1.0 + threshold)))
    init_best = float("inf") if mode == "min" else float("-inf")
    hist_arr = F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(value).cast("double").alias("v"))))
    init = F.struct(F.lit(init_best).alias("best"), F.lit(0).alias("bad"), F.lit(lr).alias("lr"),
                    F.array().cast("array<struct<e:bigint,lr:double>>").alias("out"))

    def step(st, x):
        imp = better(x["v"], st["best"])
        best = F.when(imp, x["v"]).otherwise(st["best"])
        bad = F.when(imp, F.lit(0)).otherwise(st["bad"] + 1)
        cut = bad > patience
        new_lr = F.when(cut, F.greatest(st["lr"] * F.lit(factor), F.lit(min_lr))).otherwise(st["lr"])
        bad = F.when(cut, F.lit(0)).otherwise(bad)
        out = F.concat(st["out"], F.array(F.struct(x["e"].cast("bigint").alias("e"), new_lr.alias("lr"))))
        return F.struct(best.alias("best"), bad.alias("bad"), new_lr.alias("lr"), out.alias("out"))

    folded = hist.groupBy(run).agg(F.aggregate(hist_arr, init, step).alias("_st"))
    return folded.select(run, F.explode("_st.out").alias("o")).select(run, F.col("o.e").alias(epoch), F.col("o.lr").alias("lr"))
