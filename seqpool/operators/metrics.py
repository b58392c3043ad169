"""Exact evaluation metrics and losses as Spark aggregates.

Rank metrics (average precision, AUROC, Fmax) first collapse rows with equal score (ties
count together, deterministic for any row order) and then take running sums with
``seqpool.plans.prefix.running_sums`` — no single-task global window.  Confusion counts,
MSE, Pearson and the losses are plain partial aggregates.  Undefined ratios give 0 for the
confusion measures (like the reference's metric library) and NULL elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpool.plans.prefix import running_sums

LOG_CLAMP = -100.0  # BCE clamps each log term at -100


def _safe_div(a: Column, b: Column, default=None) -> Column:
    q = F.try_divide(a, b)
    return q if default is None else F.coalesce(q, F.lit(default))


# ------------------------------------------------------------------------------ curve


def scored(preds: DataFrame, score: str, label: str) -> DataFrame:
    """Rows that can be ranked: those without a score (NULL or NaN) or a label are left out before anything is counted."""
    return preds.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())


def score_curve(preds: DataFrame, score: str = "score", label: str = "label",
                group: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score) in descending order with cumulative TP/FP.

    Columns: score, tp, fp (counts at this score), cum_tp, cum_fp, tot_tp, tot_fp."""
    g = list(group)
    pos = F.col(label).cast("double")
    collapsed = scored(preds, score, label).groupBy(*g, F.col(score).alias("score")).agg(
        F.sum(pos).alias("tp"), F.sum(F.lit(1.0) - pos).alias("fp")
    )
    return curve_of_counts(collapsed, g)


def curve_of_counts(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """The curve from one row per (group, score) with its counts tp and fp."""
    return running_sums(counts, "score", ["tp", "fp"], descending=True, partition_by=list(group))


def pr_roc_curve(preds: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    c = score_curve(preds, score, label)
    return c.select(
        "score", F.col("cum_tp").alias("tp"), F.col("cum_fp").alias("fp"),
        _safe_div(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
        _safe_div(F.col("cum_tp"), F.col("tot_tp")).alias("recall"),
        _safe_div(F.col("cum_fp"), F.col("tot_fp")).alias("fpr"),
    )


def average_precision(preds: DataFrame, score: str = "score", label: str = "label",
                      group: Sequence[str] = ()) -> DataFrame:
    """M1: sum over distinct thresholds of (R_k - R_{k-1}) * P_k (step-wise, not interpolated)."""
    return average_precision_of(score_curve(preds, score, label, group), group)


def average_precision_of(curve: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    prec = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    return curve.groupBy(*group).agg(
        _safe_div(F.sum(F.col("tp") * prec), F.max("tot_tp")).alias("average_precision")
    )


def auroc(preds: DataFrame, score: str = "score", label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """M2: trapezoid area under the ROC curve (ties = one step, i.e. half credit)."""
    return auroc_of(score_curve(preds, score, label, group), group)


def auroc_of(curve: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    area = F.sum(F.col("fp") * (F.lit(2.0) * F.col("cum_tp") - F.col("tp"))) / F.lit(2.0)
    return curve.groupBy(*group).agg(_safe_div(area, F.max("tot_tp") * F.max("tot_fp")).alias("auroc"))


# ------------------------------------------------------------------------------ threshold metrics


def binary_confusion(preds: DataFrame, score: str = "score", label: str = "label",
                     threshold: float = 0.5) -> DataFrame:
    """M3-M8: accuracy, F1, MCC, precision, recall, specificity at ``score > threshold``."""
    p = F.col(score) > F.lit(threshold)
    y = F.col(label) == 1
    c = preds.agg(
        F.count_if(p & y).cast("double").alias("tp"),
        F.count_if(p & ~y).cast("double").alias("fp"),
        F.count_if(~p & y).cast("double").alias("fn"),
        F.count_if(~p & ~y).cast("double").alias("tn"),
    )
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    mcc_den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return c.select(
        tp.cast("bigint").alias("tp"), fp.cast("bigint").alias("fp"),
        fn.cast("bigint").alias("fn"), tn.cast("bigint").alias("tn"),
        _safe_div(tp + tn, tp + fp + fn + tn, 0.0).alias("accuracy"),
        _safe_div(tp, tp + fp, 0.0).alias("precision"),
        _safe_div(tp, tp + fn, 0.0).alias("recall"),
        _safe_div(tn, tn + fp, 0.0).alias("specificity"),
        _safe_div(2 * tp, 2 * tp + fp + fn, 0.0).alias("f1"),
        _safe_div(tp * tn - fp * fn, mcc_den, 0.0).alias("mcc"),
    )


def multiclass_accuracy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """M9: share of rows whose first maximal logit is the label."""
    pred = F.array_position(F.col(logits), F.array_max(F.col(logits))) - 1
    return df.agg(F.avg((pred == F.col(label)).cast("double")).alias("accuracy"))


def regression(df: DataFrame, pred: str = "p", target: str = "y") -> DataFrame:
    """M10/M11 (+L3): mean squared error and Pearson correlation."""
    return df.agg(
        F.avg(F.pow(F.col(pred) - F.col(target), 2)).alias("mse"),
        F.corr(F.col(pred), F.col(target)).alias("pearson"),
    )


# ------------------------------------------------------------------------------ multi-label


def f1_max(df: DataFrame, protein: str = "protein", score: str = "score", target: str = "target",
           group: Sequence[str] = ()) -> DataFrame:
    """Protein-centric Fmax.

    For a threshold t, precision is averaged over proteins with at least one prediction >= t,
    recall over all proteins; F = 2PR / (P + R + 1e-10); Fmax = max over distinct scores.
    Per protein: running TP / count by descending distinct score (window per protein, bounded by
    the label count); the per-protein step changes are summed per score and accumulated with
    running_sums."""
    g = list(group)
    per = scored(df, score, target).groupBy(*g, protein, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).cast("double").alias("k"), F.sum(F.col(target).cast("double")).alias("h")
    )
    w = Window.partitionBy(*g, protein).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    wp = Window.partitionBy(*g, protein)
    steps = per.select(
        *g, protein, "score",
        F.sum("k").over(w).alias("ck"), F.sum("h").over(w).alias("ch"),
        F.sum("h").over(wp).alias("npos"),
        F.row_number().over(Window.partitionBy(*g, protein).orderBy(F.col("score").desc())).alias("rk"),
    )
    lagw = Window.partitionBy(*g, protein).orderBy(F.col("score").desc())
    prec = F.col("ch") / F.col("ck")
    rec = F.col("ch") / (F.col("npos") + F.lit(1e-10))
    steps = steps.select(
        *g, "score",
        (prec - F.coalesce(F.lag(prec).over(lagw), F.lit(0.0))).alias("dp"),
        (rec - F.coalesce(F.lag(rec).over(lagw), F.lit(0.0))).alias("dr"),
        (F.col("rk") == 1).cast("double").alias("ds"),
    )
    by_score = steps.groupBy(*g, "score").agg(F.sum("dp").alias("dp"), F.sum("dr").alias("dr"), F.sum("ds").alias("ds"))
    cum = running_sums(by_score, "score", ["dp", "dr", "ds"], descending=True, partition_by=g)
    p = F.col("cum_dp") / F.col("cum_ds")
    r = F.col("cum_dr") / F.col("tot_ds")
    f = F.lit(2.0) * p * r / (p + r + F.lit(1e-10))
    return cum.groupBy(*g).agg(F.max(f).alias("f1_max"))


# ------------------------------------------------------------------------------ losses


def bce_term(p: Column, y: Column) -> Column:
    lp = F.when(p <= 0, F.lit(LOG_CLAMP)).otherwise(F.greatest(F.ln(p), F.lit(LOG_CLAMP)))
    lq = F.when(p >= 1, F.lit(LOG_CLAMP)).otherwise(F.greatest(F.ln(F.lit(1.0) - p), F.lit(LOG_CLAMP)))
    return -(y * lp + (F.lit(1.0) - y) * lq)


def loss_bce(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """L1: binary cross-entropy of probabilities (log terms clamped at -100)."""
    return df.agg(F.avg(bce_term(F.col(score), F.col(label).cast("double"))).alias("bce"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def loss_weighted_bce(df: DataFrame, weights: DataFrame, logit: str = "score", target: str = "target",
                      label: str = "label", weight: str = "weight") -> DataFrame:
    """L2: mean over (row, label) of w_label * BCE(sigmoid(logit), target).  ``weights`` is one
    row per label (class dimension)."""
    j = df.join(weights.select(label, weight), label, "left")
    term = F.col(weight) * bce_term(sigmoid(F.col(logit)), F.col(target).cast("double"))
    return j.agg(F.avg(term).alias("weighted_bce"))


def loss_cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    """L4: softmax cross-entropy, log-sum-exp shifted by the row maximum."""
    mx = F.array_max(F.col(logits))
    lse = mx + F.ln(F.aggregate(F.col(logits), F.lit(0.0), lambda acc, x: acc + F.exp(x - mx)))
    return df.agg(F.avg(lse - F.get(F.col(logits), F.col(label).cast("int"))).alias("cross_entropy"))
