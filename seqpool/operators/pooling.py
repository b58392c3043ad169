"""Ragged set pooling: average, max, top-k mean, sliced-Wasserstein (SWE), light attention.

Input layout is *exploded*: one row per token ``(key, pos, vec ARRAY<FLOAT>)``.  Every
operator shuffles at most once, by the set key, and aggregates map-side first where the
aggregate allows it (avg/max are partial aggregates; SWE projects tokens onto the slices
before the shuffle so only L doubles per token travel instead of d floats).

Outputs are long ``(key, dim|slice, value)`` tables; ``pack`` turns them into one
``ARRAY<DOUBLE>`` per key when a vector column is wanted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import DoubleType

from seqpool.functions.vec import dot, lit_matrix, lit_vector
from seqpool.operators.interpolate import interpolate
from seqpool.operators.sequence import PAD_EPS, invalid_shift
from seqpool.plans.params import INTERP_EPS, swe_effective_weights
from seqpool.plans.prefix import running_sums
from seqpool.session import materialise

LARGE_SET = 1 << 18  # tokens of a set that one task sorts as a matrix; larger sets are ranked over ranges

# ---------------------------------------------------------------------------------------
# helpers


def explode_dims(tokens: DataFrame, key: str = "seq_id", vec: str = "vec", pos: str | None = None) -> DataFrame:
    cols = [F.col(key)] + ([F.col(pos)] if pos else [])
    return tokens.select(*cols, F.posexplode(vec).alias("dim", "x")).select(
        *cols, F.col("dim").cast("bigint").alias("dim"), F.col("x").cast("double").alias("x"))


def pack(long_df: DataFrame, key: str, index: str, value: str, out: str = "vec") -> DataFrame:
    """(key, index, value) -> (key, ARRAY<DOUBLE> ordered by index).  Group size = vector width."""
    return long_df.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(index), F.col(value)))), lambda s: s[value]).alias(out)
    )


# ---------------------------------------------------------------------------------------
# A1-A3


def pool_avg(tokens: DataFrame, key: str = "seq_id", vec: str = "vec") -> DataFrame:
    """A1: per key and dimension, mean over tokens (partial aggregation before the shuffle)."""
    return explode_dims(tokens, key, vec).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def pool_max(tokens: DataFrame, key: str = "seq_id", vec: str = "vec") -> DataFrame:
    """A2: per key and dimension, max over tokens."""
    return explode_dims(tokens, key, vec).groupBy(key, "dim").agg(F.max(F.col("x").cast("double")).alias("value"))


def pool_topk(tokens: DataFrame, k: int = 5, key: str = "seq_id", vec: str = "vec") -> DataFrame:
    """A3: mean of the k largest values per key and dimension; sets with n < k use all n (Q10).

    ``rank <= k`` over a window lets Spark insert a per-partition group limit before the
    shuffle (WindowGroupLimit), so at most k rows per (key, dim) and map task travel."""
    w = Window.partitionBy(key, "dim").orderBy(F.col("x").desc())
    top = explode_dims(tokens, key, vec).withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= k)
    return top.groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


# ---------------------------------------------------------------------------------------
# Sliced-Wasserstein embedding


def project_sql(vec: str | Column, theta: np.ndarray) -> Column:
    """X . theta_l for every slice l, as JVM higher-order functions (small d * L)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    return F.transform(lit_matrix(theta), lambda row: dot(row, v))


def project_arrow(vec: str | Column, theta: np.ndarray) -> Column:
    """X . theta_l for every slice, as one numpy matmul per Arrow batch (large d * L)."""
    th = np.ascontiguousarray(np.asarray(theta, dtype=np.float64).T)  # d x L

    @arrow_udf("array<double>")
    def _proj(v: pa.Array) -> pa.Array:
        values = np.asarray(v.flatten(), dtype=np.float64)
        ends = np.arange(len(v) + 1, dtype=np.int32) * th.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array((values.reshape(-1, th.shape[0]) @ th).ravel()))

    return _proj(F.col(vec) if isinstance(vec, str) else vec)


def slice_projections(tokens: DataFrame, theta: np.ndarray, key: str = "seq_id", pos: str = "pos",
                      vec: str = "vec", project_with: str = "sql") -> DataFrame:
    """(key, pos, slice, p): every token projected on every unit slicer (map side, no shuffle)."""
    proj = project_arrow(vec, theta) if project_with == "arrow" else project_sql(vec, theta)
    return tokens.select(F.col(key), F.col(pos), F.posexplode(proj).alias("slice", "p")).withColumn(
        "slice", F.col("slice").cast("bigint")
    )


def _knot_index(j: Column, n: Column, m: int) -> Column:
    """0-based left neighbour of query point t_j = j/(M+1) among knots i/(n+1), i = 1..n.

    #knots < t_j = ceil(j (n+1) / (M+1)) - 1 (exact integer form), minus one, clamped to [0, n-2]."""
    below = F.floor((j * (n + 1) + m) / F.lit(m + 1)).cast("int") - 1
    return F.least(F.greatest(below - 1, F.lit(0)), n - 2)


def _interp_fraction(j: Column, i0: Column, n: Column, m: int, eps: float) -> Column:
    """s_j with q_j = v[i0] + (v[i0+1] - v[i0]) * s_j (extrapolates outside the knots)."""
    step = F.lit(1.0) / (n + 1)
    return (j / F.lit(float(m + 1)) - (i0 + 1) / (n + 1).cast("double")) / (F.lit(eps) + step)


def swe_quantile(v: Column, j: Column, m: int, eps: float = INTERP_EPS) -> Column:
    """q_j of a sorted ARRAY<DOUBLE> v: M == n uses v directly, n == 1 is constant (Q14)."""
    n = F.size(v)
    i0 = _knot_index(j, n, m)
    y0 = F.get(v, i0)
    y1 = F.get(v, i0 + 1)
    interp = y0 + (y1 - y0) * _interp_fraction(j, i0, n, m, eps)
    return F.when(n == 1, F.get(v, F.lit(0))).when(n == m, F.get(v, j - 1)).otherwise(interp)


def sorted_slices(proj: DataFrame, key: str = "seq_id") -> DataFrame:
    """K1: (key, slice, v = ascending ARRAY<DOUBLE>).  One shuffle by (key, slice); the group
    is one set's projections on one slice, bounded by the encoder's maximum length."""
    return proj.groupBy(key, "slice").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("p"), F.col("pos")))), lambda s: s["p"]).alias("v")
    )


def pool_swe(tokens: DataFrame, theta: np.ndarray, reference: np.ndarray, weights: np.ndarray,
             key: str = "seq_id", pos: str = "pos", vec: str = "vec", layout: str = "arrays",
             project_with: str = "sql", eps: float = INTERP_EPS, large_set: int = LARGE_SET) -> DataFrame:
    """A5: sliced-Wasserstein embedding, one value per (key, slice).

    out_l = sum_m w_m (R[m,l] - q_l[argsort(R[:,l])[m]]),  q_l = interpolated sorted projections.

    layout="arrays": sort each (key, slice) group into an array, evaluate M quantiles.
    layout="window": rank tokens with a window (spillable sort, no collect) and let every token
                     add its own coefficient; the interpolation is linear in the sorted values.
    layout="sorted": one row per token with its L projections, one shuffle by the set; a task walks through its sets and sorts
                     each as a matrix.  Sets of more than ``large_set`` tokens are ranked over many tasks instead.
    layout="ranges": every set is ranked over ranges of its projections, as the large ones of "sorted" are.
    """
    m = int(np.asarray(reference).shape[0])
    const, w_eff = swe_effective_weights(reference, weights)
    if layout == "sorted":
        return _swe_by_size(tokens, theta, const, w_eff, key, pos, vec, project_with, eps, large_set)
    if layout == "ranges":
        return _swe_ranges(tokens, theta, const, w_eff, key, pos, vec, project_with, eps, large_set)
    proj = slice_projections(tokens, theta, key, pos, vec, project_with)
    if layout == "numpy":
        s = sorted_slices(proj, key)
        return s.select(F.col(key), F.col("slice"), _swe_numpy(const, w_eff, eps)(F.col("v"), F.col("slice")).alias("value"))
    c_l = F.get(lit_vector(const), F.col("slice").cast("int"))
    weff = F.get(lit_matrix(w_eff), F.col("slice").cast("int"))
    if layout == "window":
        return _swe_window(proj, key, m, c_l, weff, eps, np.asarray(w_eff) if project_with == "arrow" else None)
    s = sorted_slices(proj, key)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(m)), F.lit(0.0),
        lambda acc, j: acc + F.get(weff, j - 1) * swe_quantile(F.col("v"), j, m, eps),
    )
    return s.select(F.col(key), F.col("slice"), (c_l - total).alias("value"))


def swe_quantiles_np(v: np.ndarray, m: int, eps: float = INTERP_EPS) -> np.ndarray:
    """Same quantile rule as ``swe_quantile`` for one sorted array (numpy)."""
    n = len(v)
    if n == 1:
        return np.full(m, v[0])
    if n == m:
        return np.asarray(v, dtype=np.float64)
    j = np.arange(1, m + 1)
    below = (j * (n + 1) + m) // (m + 1) - 1
    i0 = np.clip(below - 1, 0, n - 2)
    s = (j / (m + 1) - (i0 + 1) / (n + 1)) / (eps + 1.0 / (n + 1))
    return v[i0] + (v[i0 + 1] - v[i0]) * s


def _swe_numpy(const: np.ndarray, w_eff: np.ndarray, eps: float):
    m = w_eff.shape[1]

    @pandas_udf(DoubleType())
    def _value(v: pd.Series, sl: pd.Series) -> pd.Series:
        out = np.empty(len(v))
        for r, (arr, l) in enumerate(zip(v.to_numpy(), sl.to_numpy())):
            q = swe_quantiles_np(np.asarray(arr, dtype=np.float64), m, eps)
            out[r] = const[l] - float(w_eff[l] @ q)
        return pd.Series(out)

    return _value


def swe_coefficients(n: int, w_eff: np.ndarray, eps: float = INTERP_EPS) -> tuple[np.ndarray, np.ndarray]:
    """(ranks, coefficients L x ranks): what the sorted value of each rank adds to the embedding of a set of n tokens.

    The interpolated quantiles are linear in the sorted values, and at most 2 M ranks have a part."""
    m = w_eff.shape[1]
    if n == 1:
        return np.zeros(1, dtype=np.int64), w_eff.sum(axis=1, keepdims=True)
    if n == m:
        return np.arange(n), w_eff
    j = np.arange(1, m + 1)
    i0 = np.clip((j * (n + 1) + m) // (m + 1) - 2, 0, n - 2)
    s = (j / (m + 1.0) - (i0 + 1) / (n + 1.0)) / (eps + 1.0 / (n + 1))
    ranks = np.unique(np.concatenate([i0, i0 + 1]))
    out = np.zeros((len(ranks), w_eff.shape[0]))
    np.add.at(out, np.searchsorted(ranks, i0), (w_eff * (1.0 - s)).T)
    np.add.at(out, np.searchsorted(ranks, i0 + 1), (w_eff * s).T)
    return ranks, out.T


def _coefficient_udf(w_eff: np.ndarray, eps: float):
    """Coefficient of (rank, n, slice), per Arrow batch; the table of a set size (2 M x L values) is kept for further batches."""
    @pandas_udf("double")
    def _coef(r: pd.Series, n: pd.Series, sl: pd.Series) -> pd.Series:
        rank, size, at = r.to_numpy(), n.to_numpy(), sl.to_numpy()
        out = np.zeros(len(rank))
        for k in np.unique(size):
            rows = np.flatnonzero(size == k)
            ranks, table = _coefficient_table(int(k))
            place = np.minimum(np.searchsorted(ranks, rank[rows]), len(ranks) - 1)
            out[rows] = np.where(ranks[place] == rank[rows], table[at[rows], place], 0.0)
        return pd.Series(out)

    kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _coefficient_table(k: int):
        if k not in kept:
            if len(kept) >= 1024:
                kept.clear()
            kept[k] = swe_coefficients(k, w_eff, eps)
        return kept[k]

    return _coef


def _swe_window(proj: DataFrame, key: str, m: int, c_l: Column, weff: Column, eps: float, w_eff: np.ndarray | None = None) -> DataFrame:
    """Ranks by a window, a coefficient per rank (as columns, or by Arrow batch where ``w_eff`` is given), one sum per group."""
    w = Window.partitionBy(key, "slice").orderBy("p", "pos")
    wn = Window.partitionBy(key, "slice")
    ranked = proj.withColumn("r", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(wn).cast("int"))
    r, n = F.col("r").cast("int"), F.col("n")
    if w_eff is not None:
        coef = _coefficient_udf(w_eff, eps)(r, n, F.col("slice").cast("int"))
    else:
        lo = F.when(r >= 2, F.greatest(F.floor(r * F.lit(m + 1) / (n + 1)).cast("int") - 1, F.lit(1))).otherwise(1)
        hi = F.when(r <= n - 3, F.least(F.ceil((r + 2) * F.lit(m + 1) / (n + 1)).cast("int") + 1, F.lit(m))).otherwise(m)

        def contrib(acc, j):
            i0 = _knot_index(j, n, m)
            s = _interp_fraction(j, i0, n, m, eps)
            part = F.when(i0 == r, F.lit(1.0) - s).when(i0 == r - 1, s).otherwise(F.lit(0.0))
            return acc + F.get(weff, j - 1) * part

        general = F.aggregate(F.sequence(lo, F.greatest(hi, lo)), F.lit(0.0), contrib)
        all_w = F.aggregate(weff, F.lit(0.0), lambda acc, x: acc + x)
        coef = F.when(n == 1, all_w).when(n == m, F.get(weff, r)).otherwise(general)
    sums = ranked.select(F.col(key), F.col("slice"), (F.col("p") * coef).alias("t")).groupBy(key, "slice").agg(F.sum("t").alias("t"))
    return sums.select(F.col(key), F.col("slice"), (c_l - F.col("t")).alias("value"))


def sorted_set_values(p: np.ndarray, const: np.ndarray, w_eff: np.ndarray, eps: float = INTERP_EPS) -> np.ndarray:
    """The embedding (L values) of one set from its projections (n x L)."""
    n, m = len(p), w_eff.shape[1]
    v = np.sort(p, axis=0)
    if n == 1:
        q = np.repeat(v, m, axis=0)
    elif n == m:
        q = v
    else:
        j = np.arange(1, m + 1)
        i0 = np.clip((j * (n + 1) + m) // (m + 1) - 2, 0, n - 2)
        s = (j / (m + 1.0) - (i0 + 1) / (n + 1.0)) / (eps + 1.0 / (n + 1))
        q = v[i0] + (v[i0 + 1] - v[i0]) * s[:, None]
    return const - (w_eff.T * q).sum(axis=0)


def _swe_matrices(proj: DataFrame, key: str, const: np.ndarray, w_eff: np.ndarray, eps: float) -> DataFrame:
    """(key, slice, value) from (key, p array of L): the rows of a set meet in one task, in the order of the keys."""
    n_slices = len(const)
    slices = pa.array(np.arange(n_slices), pa.int64())

    def run(batches):
        held: list[np.ndarray] = []  # of the set that the last rows belong to
        now = None

        def value():
            out = sorted_set_values(np.concatenate(held), const, w_eff, eps)
            held.clear()
            return out

        for batch in batches:
            keys, ready, values = batch.column(key), [], []
            if keys.type == pa.null() or batch.num_rows == 0:
                continue
            runs = pc.run_end_encode(keys)
            ends = np.asarray(runs.run_ends)
            p = np.asarray(batch.column("p").flatten()).reshape(-1, n_slices)
            for at, end, k in zip(np.append(0, ends[:-1]), ends, runs.values, strict=True):
                if held and not k.equals(now):
                    ready.append(now)
                    values.append(value())
                now = k
                held.append(p[at:end])
            if ready:
                yield _long(ready, values, keys.type)
        if held:
            yield _long([now], [value()], now.type)

    def _long(ready, values, kind):
        keys = pa.array([k.as_py() for k in ready], kind)
        return pa.RecordBatch.from_arrays(
            [keys.take(pa.array(np.repeat(np.arange(len(ready)), n_slices))), pa.array(np.tile(np.asarray(slices), len(ready))),
             pa.array(np.concatenate(values))], names=[key, "slice", "value"])

    dealt = proj.repartition(key).sortWithinPartitions(key)
    return dealt.mapInArrow(run, f"`{key}` {proj.schema[key].dataType.simpleString()}, slice bigint, value double")


def _swe_by_size(tokens: DataFrame, theta, const, w_eff, key: str, pos: str, vec: str, project_with: str, eps: float, large_set: int) -> DataFrame:
    sizes = tokens.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > large_set)
    large = materialise(sizes.select(F.col(key).alias("_large")), "large-sets")
    proj = project_arrow(vec, theta) if project_with == "arrow" else project_sql(vec, theta)
    if large.isEmpty():
        return _swe_matrices(tokens.select(key, proj.alias("p")), key, const, w_eff, eps)
    own = F.col(key).eqNullSafe(F.col("_large"))
    small = tokens.join(large, own, "left_anti").select(key, proj.alias("p"))
    rest = tokens.join(large, own, "left_semi")
    return _swe_matrices(small, key, const, w_eff, eps).unionByName(
        _swe_ranges(rest, theta, const, w_eff, key, pos, vec, project_with, eps, large_set))


def _swe_ranges(tokens: DataFrame, theta, const, w_eff, key: str, pos: str, vec: str, project_with: str, eps: float, rows_per_range: int) -> DataFrame:
    """Ranks of a (set, slice) over ranges of its projections, the coefficient of each rank, one sum."""
    ranked = ranked_projections(tokens, theta, key, pos, vec, project_with, rows_per_range)
    coef = _coefficient_udf(w_eff, eps)(F.col("rank").cast("int"), F.col("n").cast("int"), F.col("slice").cast("int"))
    sums = ranked.select(key, "slice", (F.col("p") * coef).alias("t")).groupBy(key, "slice").agg(F.sum("t").alias("t"))
    c_l = F.get(lit_vector(const), F.col("slice").cast("int"))
    return sums.select(key, "slice", (c_l - F.col("t")).alias("value"))


def ranked_projections(tokens: DataFrame, theta: np.ndarray, key: str = "seq_id", pos: str = "pos", vec: str = "vec",
                       project_with: str = "sql", rows_per_range: int = LARGE_SET) -> DataFrame:
    """(key, pos, slice, p, rank, n): 0-based ranks within (key, slice), ties by position; a set of any size is dealt over tasks."""
    proj = slice_projections(tokens, theta, key, pos, vec, project_with).withColumn("_one", F.lit(1).cast("bigint"))
    x = running_sums(proj, "p", ["_one"], descending=False, partition_by=[key, "slice"], tiebreak=[pos], rows_per_bucket=rows_per_range)
    return x.select(key, pos, "slice", "p", (F.col("cum__one") - 1).alias("rank"), F.col("tot__one").alias("n"))


def padded_knots(slots: DataFrame, valid: Column, theta: np.ndarray, key: str = "seq_id", pos: str = "pos", vec: str = "vec",
                 project_with: str = "sql", pad_eps: float = PAD_EPS) -> DataFrame:
    """(key, slice, pos, x, y): the knots of a padded set's quantile function on every slice, padding on the right.

    The n real projections, ascending, stand at i / (n + 1).  The k-th padded position stands ``pad_eps * k`` beyond the last of
    them, on the line through the two largest values, so that it changes neither the order nor the function.  A single
    real token is a constant function."""
    shifted = invalid_shift(slots, valid, key, pos, pad_eps).withColumn("_ok", valid)
    proj = project_arrow(vec, theta) if project_with == "arrow" else project_sql(vec, theta)
    x = shifted.select(key, pos, "shift", "_ok", F.posexplode(proj).alias("slice", "p")).withColumn("slice", F.col("slice").cast("bigint"))
    group = Window.partitionBy(key, "slice")
    x = x.withColumn("_i", F.row_number().over(group.orderBy(~F.col("_ok"), "p", pos)))
    x = x.withColumn("_n", F.count(F.when(F.col("_ok"), 1)).over(group))
    i, n, ok = F.col("_i"), F.col("_n"), F.col("_ok")
    x = x.withColumn("_top", F.max(F.when(ok & (i == n), F.col("p"))).over(group))
    x = x.withColumn("_next", F.max(F.when(ok & (i == n - 1), F.col("p"))).over(group))
    slope = F.when(n > 1, (F.col("_top") - F.col("_next")) * (n + 1)).otherwise(0.0)
    return x.where("_n > 0").select(
        key, "slice", pos, F.when(ok, i / (n + 1)).otherwise(n / (n + 1) + F.col("shift")).alias("x"),
        F.when(ok, F.col("p")).otherwise(F.col("_top") + slope * F.col("shift")).alias("y"))


def pool_swe_padded(slots: DataFrame, valid: Column, theta: np.ndarray, reference: np.ndarray, weights: np.ndarray, key: str = "seq_id",
                    pos: str = "pos", vec: str = "vec", project_with: str = "sql", eps: float = INTERP_EPS,
                    pad_eps: float = PAD_EPS) -> DataFrame:
    """The embedding of padded sets: interpolation through ``padded_knots`` at the M reference points of each slice.

    Sets without a real token have no row."""
    m = int(np.asarray(reference).shape[0])
    const, w_eff = swe_effective_weights(reference, weights)
    knots = materialise(padded_knots(slots, valid, theta, key, pos, vec, project_with, pad_eps), "padded-knots")
    j = F.explode(F.sequence(F.lit(1), F.lit(m)))
    points = knots.select(key, "slice").distinct().select(key, "slice", j.alias("j")).withColumn("at", F.col("j") / F.lit(m + 1.0))
    q = interpolate(knots, points, [key, "slice"], tie=pos, eps=eps, out="q")
    w = F.get(F.get(lit_matrix(w_eff), F.col("slice").cast("int")), F.col("j") - 1)
    sums = q.groupBy(key, "slice").agg(F.sum(w * F.col("q")).alias("t"))
    return sums.select(key, "slice", (F.get(lit_vector(const), F.col("slice").cast("int")) - F.col("t")).alias("value"))


def swe_displacement(tokens: DataFrame, theta: np.ndarray, reference: np.ndarray,
                     key: str = "seq_id", pos: str = "pos", vec: str = "vec",
                     project_with: str = "sql", eps: float = INTERP_EPS) -> DataFrame:
    """(key, slice, m, value = R[m,l] - q_l[argsort(R[:,l])[m]]) — SWE before the weighting."""
    ref = np.asarray(reference, dtype=np.float64)
    m = ref.shape[0]
    order = np.argsort(ref, axis=0, kind="stable").T  # L x M: argsort per slice
    proj = slice_projections(tokens, theta, key, pos, vec, project_with)
    s = sorted_slices(proj, key)
    ref_l = F.get(lit_matrix(ref.T), F.col("slice").cast("int"))
    idx_l = F.get(lit_matrix(order.astype(np.float64)), F.col("slice").cast("int"))
    # the m values of a (set, slice) as one array, so that the sorted values are not copied m times
    pairs = F.zip_with(ref_l, idx_l, lambda r, i: r - swe_quantile(F.col("v"), i.cast("int") + 1, m, eps))
    return s.select(F.col(key), F.col("slice"), F.posexplode(pairs).alias("m", "value")).select(
        F.col(key), F.col("slice"), F.col("m").cast("bigint").alias("m"), "value")


def slice_rank(tokens: DataFrame, theta: np.ndarray, key: str = "seq_id", pos: str = "pos",
               vec: str = "vec", project_with: str = "sql") -> DataFrame:
    """Rank (0-based) of every projected token within its (key, slice), ties by position."""
    return ranked_projections(tokens, theta, key, pos, vec, project_with).select(key, pos, "slice", "p", "rank")


def slice_end_slope(tokens: DataFrame, theta: np.ndarray, key: str = "seq_id", pos: str = "pos",
                    vec: str = "vec", project_with: str = "sql") -> DataFrame:
    """Per (key, slice) top-2 gap and end slope = gap * (n + 1); n = 1 -> NULL (Q14).

    Two max-style aggregates instead of a sort: max and the max of the rest."""
    proj = slice_projections(tokens, theta, key, pos, vec, project_with)
    w = Window.partitionBy(key, "slice").orderBy(F.col("p").desc(), F.col(pos))
    top = proj.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= 2)
    agg = proj.groupBy(key, "slice").agg(F.count(F.lit(1)).alias("n"))
    t2 = top.groupBy(key, "slice").agg(
        F.max(F.when(F.col("rk") == 1, F.col("p"))).alias("max1"),
        F.max(F.when(F.col("rk") == 2, F.col("p"))).alias("max2"),
    )
    return t2.join(agg, [key, "slice"]).select(
        key, "slice", "max1", "max2",
        (F.col("max1") - F.col("max2")).alias("gap"),
        ((F.col("max1") - F.col("max2")) * (F.col("n") + 1)).alias("slope"),
    )
