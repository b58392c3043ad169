"""Operators along the positions of a sequence: convolution, light attention, interpolation, masks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1.1920929e-07  # float32 machine epsilon, added to the interval in a slope
PAD_EPS = 1e-3  # shift of each further padded position


BLOCK = 512  # positions that a task's matrix product covers at once


def _blocks(tokens: DataFrame, reach: int, seq: str, pos: str, vec: str, block: int) -> DataFrame:
    """(seq, _block, pos, vec): every token in the block of its position and, near an end of it, in the neighbour's halo."""
    at = F.floor(F.col(pos) / F.lit(block)).cast("bigint")
    first, last = F.floor((F.col(pos) - reach) / F.lit(block)), F.floor((F.col(pos) + reach) / F.lit(block))
    x = tokens.select(seq, F.col(pos).cast("bigint").alias(pos), F.col(vec).cast("array<double>").alias(vec),
                      F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("_block"), at.alias("_own"))
    return x.repartition(seq, "_block").sortWithinPartitions(seq, "_block", pos)


def _convolved(x: np.ndarray, places: np.ndarray, weight: np.ndarray, bias: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are the block's own, their outputs): rows at ``places`` from the halo's start; missing positions are zero."""
    width = weight.shape[2]
    reach = width // 2
    dense = np.zeros((block + 2 * reach, weight.shape[1]))
    dense[places] = x
    own = np.flatnonzero((places >= reach) & (places < reach + block))
    at = places[own]
    out = np.tile(bias, (len(at), 1))
    for k in range(width):
        out += dense[at + k - reach] @ weight[:, :, k].T
    return own, out


def _per_block(tokens: DataFrame, weight: np.ndarray, bias, seq: str, pos: str, vec: str, block: int, emit, schema: str) -> DataFrame:
    """``emit(seq value, positions, outputs)`` -> record batch, for each block's own tokens."""
    reach, bias = weight.shape[2] // 2, np.asarray(bias, dtype=np.float64)
    weight = np.asarray(weight, dtype=np.float64)

    def run(batches):
        held: list[tuple] = []
        now = None

        def flush():
            places = np.concatenate([h[0] for h in held]) - (now[1] * block - reach)
            own, out = _convolved(np.concatenate([h[1] for h in held]), places, weight, bias, block)
            held.clear()
            return emit(now[0], places[own] + (now[1] * block - reach), out) if len(own) else None

        for batch in batches:
            if not batch.num_rows:
                continue
            seqs, blocks = batch.column(seq), np.asarray(batch.column("_block"))
            codes = np.asarray(seqs.dictionary_encode().indices.fill_null(-1))
            starts = np.flatnonzero(np.append(True, (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])))
            places = np.asarray(batch.column(pos))
            x = np.asarray(batch.column(vec).flatten()).reshape(len(places), -1)
            for at, end in zip(starts, np.append(starts[1:], len(places)), strict=True):
                key = (seqs[int(at)], int(blocks[at]))
                if held and not (key[1] == now[1] and key[0].equals(now[0])):
                    if (ready := flush()) is not None:
                        yield ready
                now = key
                held.append((places[at:end], x[at:end]))
        if held and (ready := flush()) is not None:
            yield ready

    return _blocks(tokens, reach, seq, pos, vec, block).select(seq, "_block", pos, vec).mapInArrow(run, schema)


def _repeated(value: pa.Scalar, n: int) -> pa.Array:
    return pa.array([value.as_py()], value.type).take(pa.array(np.zeros(n, dtype=np.int64)))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def conv1d_same(tokens: DataFrame, weight: np.ndarray, bias: Sequence[float], seq: str = "seq_id", pos: str = "pos",
                vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """(seq, pos, vec) of a zero-padded convolution along the positions; ``weight`` is (out, in, width), width odd.

    A sequence is dealt in blocks of positions with a halo on both sides, so one of any length spreads over tasks; a block is
    one matrix product per tap.  Positions without a token count as zeros."""
    def emit(value, places, out):
        return pa.RecordBatch.from_arrays([_repeated(value, len(places)), pa.array(places, pa.int64()), _lists(out)], names=[seq, pos, vec])

    kind = tokens.schema[seq].dataType.simpleString()
    return _per_block(tokens, weight, bias, seq, pos, vec, block, emit, f"`{seq}` {kind}, `{pos}` bigint, `{vec}` array<double>")


def pool_light_attention(tokens: DataFrame, w_value: np.ndarray, b_value, w_att: np.ndarray, b_att, linear: np.ndarray, b_linear,
                         seq: str = "seq_id", pos: str = "pos", vec: str = "vec", block: int = BLOCK) -> DataFrame:
    """A4: (seq, idx, value): [max over positions of the values, attention-weighted sum of the values], then a linear layer.

    Both convolutions are one pass; a block sends its maxima and its softmax sums relative to its own maximum, and a
    sequence's sums follow from its blocks'."""
    n = len(w_value)

    def emit(value, places, out):
        v, a = out[:, :n], out[:, n:]
        top = a.max(axis=0)
        e = np.exp(a - top)
        parts = [np.arange(n), v.max(axis=0), top, e.sum(axis=0), (e * v).sum(axis=0)]
        return pa.RecordBatch.from_arrays([_repeated(value, n), *map(pa.array, parts)], names=[seq, "dim", "most", "top", "e", "ev"])

    kind = tokens.schema[seq].dataType.simpleString()
    blocks = _per_block(tokens, np.concatenate([w_value, w_att]), np.concatenate([b_value, b_att]), seq, pos, vec, block, emit,
                        f"`{seq}` {kind}, dim bigint, most double, top double, e double, ev double")
    scale = F.exp(F.col("top") - F.max("top").over(Window.partitionBy(seq, "dim")))
    sums = blocks.withColumn("_s", scale).groupBy(seq, "dim").agg(
        F.max("most").alias("most"), (F.sum(F.col("_s") * F.col("ev")) / F.sum(F.col("_s") * F.col("e"))).alias("att"))
    both = F.array_sort(F.collect_list(F.struct("dim", "most", "att")))  # a row per dimension
    feats = sums.groupBy(seq).agg(both.alias("f")).select(seq, F.concat("f.most", "f.att").alias("f"))
    layer, offset = np.asarray(linear, dtype=np.float64).T, np.asarray(b_linear, dtype=np.float64)

    @F.arrow_udf("array<double>")
    def linear_layer(f: pa.Array) -> pa.Array:
        return _lists(np.asarray(f.flatten()).reshape(-1, 2 * n) @ layer + offset)

    return feats.select(seq, F.posexplode(linear_layer("f")).alias("idx", "value"))


def interp1d(knots: Column, values: Column, at: Column, eps: float = EPS) -> Column:
    """Piecewise linear interpolation at ``at`` through (knots, values), knots ascending, not evenly spaced.

    The interval is found by counting the knots below; beyond the ends the outer intervals go on.  One knot: its value."""
    below = F.size(F.filter(knots, lambda k: k < at))
    i = F.least(F.greatest(below - 1, F.lit(0)), F.size(knots) - 2)
    x0, x1, y0, y1 = F.get(knots, i), F.get(knots, i + 1), F.get(values, i), F.get(values, i + 1)
    line = y0 + (y1 - y0) / (F.lit(eps) + (x1 - x0)) * (at - x0)
    return F.when(F.size(knots) == 1, F.get(values, F.lit(0))).otherwise(line)


def sentinel_valid(vec: Column, sentinel: float, first_only: bool = False) -> Column:
    """Whether a position is real: its first dimension, or any dimension, differs from the sentinel."""
    if first_only:
        return F.get(vec, F.lit(0)) != F.lit(sentinel)
    return F.exists(vec, lambda x: x != F.lit(sentinel))


def invalid_shift(padded: DataFrame, valid: Column, seq: str = "seq_id", pos: str = "pos", eps: float = PAD_EPS) -> DataFrame:
    """Running count of invalid positions of a padded sequence times eps (the shift of its padding)."""
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return padded.withColumn("shift", F.lit(eps) * F.sum((~valid).cast("bigint")).over(w))
