"""Key lookups between entity / pair tables and feature tables.

No join is forced to broadcast: Spark broadcasts a side by its size, otherwise the join shuffles on
the key and AQE's skew-join splitting handles a hot key.  Lookups keep every row; rows whose key has no
feature have a NULL vector, and ``unresolved`` lists such keys with their number of rows.

Two joins in a row would send every pair to its second key together with the vector of the first.  ``lookup_both`` deals many
pairs over a grid of cells (block of the first key, block of the second): a pair travels once and without a vector, a
feature once for each cell that its block meets, and both lookups happen inside the cell.  ``pair_blocks`` leaves the
pairs of a cell in one row, with each vector once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

GRID_ROWS = 1 << 20  # fewer pairs are joined twice
CELL_PAIRS = 1 << 20  # about as many pairs in a block
LOOKUP_ROWS, BATCH_ROWS = 1 << 14, 1 << 11  # rows looked up at once, rows of an Arrow batch handed back
GRID_KEYS = ("bigint", "int", "string")  # equal keys of these types have equal hashes


class Side(NamedTuple):
    """A column of the pairs, the features looked up by it, and the new names of their columns."""

    on: str
    features: DataFrame
    cols: dict[str, str]
    key: str = "key"


def lookup(df: DataFrame, features: DataFrame, on: str, key: str = "key", cols: dict[str, str] | None = None,
           out: str | None = None, how: str = "left") -> DataFrame:
    """Attach columns of ``features`` (one row per key) to ``df[on]``; ``cols`` maps them to their new names."""
    names = cols or {"vec": out or f"{on}_vec"}
    f = features.select(F.col(key).alias(on), *[F.col(a).alias(b) for a, b in names.items()])
    return df.join(f, on, how)


def _grid(cells: int, first: int, second: int) -> tuple[int, int]:
    """Blocks of the first and of the second key that copy the fewest features, for ``cells`` cells in all."""
    b = min(max(1, round(math.sqrt(cells * second / max(first, 1)))), cells)
    return max(1, cells // b), b


def _repeated(features: DataFrame, key: str) -> bool:
    return not features.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _block(key: Column, spread: Column, hot: Sequence, n: int, salt: int) -> Column:
    """Block of a pair by its key; pairs without a key, or with a hot one, are spread over all blocks."""
    loose = key.isNull() | key.isin(list(hot)) if hot else key.isNull()
    return F.pmod(F.when(loose, F.xxhash64(spread, F.lit(salt))).otherwise(F.xxhash64(key)), F.lit(n))


def _blocks(key: Column, hot: Sequence, n: int) -> Column:
    """All blocks that the pairs of a key can be in."""
    every, own = F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), F.array(F.pmod(F.xxhash64(key), F.lit(n)))
    return F.when(key.isin(list(hot)), every).otherwise(own) if hot else own


def _plan(df: DataFrame, first: Side, second: Side, cells: int, grid_from: int) -> tuple[int, int] | None:
    """The blocks of the grid's two sides; None where the pairs are to be joined twice."""
    n, n_first, n_second = df.agg(F.count(F.lit(1)), F.approx_count_distinct(first.on), F.approx_count_distinct(second.on)).first()
    cells = max(cells, n // CELL_PAIRS)
    blocks = _grid(cells, n_first, n_second)
    if n < grid_from or n_first * blocks[1] + n_second * blocks[0] > n or any(_repeated(s.features, s.key) for s in (first, second)):
        return None
    return blocks


def _dealt(df: DataFrame, first: Side, second: Side, grid_from: int) -> DataFrame | None:
    """Pairs and features (``_f0``, ``_f1``) with their cell; ``_side`` is 0 or 1 for features and null for pairs.

    None where the pairs are to be joined twice."""
    kinds = dict(df.dtypes)
    sides = (first, second)
    new = [*first.cols.values(), *second.cols.values()]
    if (first.on == second.on or len({*new, *df.columns}) < len(new) + len(df.columns)
            or any(kinds[s.on] not in GRID_KEYS or dict(s.features.dtypes)[s.key] != kinds[s.on] for s in sides)):
        return None
    cells = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _plan(df, first, second, cells, grid_from)
    if blocks is None:
        return None

    often = df.select(first.on, second.on).freqItems([first.on, second.on], max(1.0 / cells, 1e-4)).first()  # at most as many as cells
    hot = [[k for k in keys if k is not None] for keys in often]
    row = F.struct(*df.columns)
    at = [_block(F.col(s.on), row, hot[i], blocks[i], i) for i, s in enumerate(sides)]
    parts = [df.select("*", (at[0] * blocks[1] + at[1]).alias("_cell"))]
    for i, s in enumerate(sides):
        other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks[1 - i] - 1).cast("bigint"))).alias("_other")
        f = s.features.select(F.col(s.key).alias(s.on), F.struct(*[F.col(a).alias(b) for a, b in s.cols.items()]).alias(f"_f{i}"))
        f = f.join(df.select(s.on).distinct(), s.on, "left_semi")
        f = f.select("*", F.explode(_blocks(F.col(s.on), hot[i], blocks[i])).alias("_own")).select("*", other)
        cell = F.col("_own") * blocks[1] + F.col("_other") if i == 0 else F.col("_other") * blocks[1] + F.col("_own")
        parts.append(f.select(s.on, f"_f{i}", cell.alias("_cell"), F.lit(i).alias("_side")))
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


def lookup_both(df: DataFrame, first: Side, second: Side, how: str = "left", grid_from: int = GRID_ROWS) -> DataFrame:
    """``lookup`` by ``first``, then by ``second``; large tables of pairs meet both features in the cells of a grid.

    The grid has as many cells as Spark has shuffle partitions (or one for ``CELL_PAIRS`` pairs, if that is more), and blocks
    such that the fewest features are copied; where that would still move more vectors than there are pairs, or keys repeat
    in the features, the pairs are joined twice.  Keys that may hold more than a cell's share of the pairs have their pairs
    spread and their feature in every cell."""
    sides = (first, second)
    x = _dealt(df, first, second, grid_from) if how == "left" else None
    if x is None:
        x = lookup(df, first.features, first.on, first.key, first.cols, how=how)
        return lookup(x, second.features, second.on, second.key, second.cols, how=how)
    fields = [f for i in range(2) for f in x.schema[f"_f{i}"].dataType.fields]
    schema = StructType([*df.schema.fields, *[StructField(f.name, f.dataType) for f in fields]])
    x = x.repartition("_cell").drop("_cell").sortWithinPartitions(F.col("_side").asc_nulls_last())  # features before pairs
    x = x.mapInArrow(_attach([s.on for s in sides], [list(s.cols.values()) for s in sides], df.columns), schema)
    rest = [c for c in df.columns if c not in (first.on, second.on)]
    return x.select(second.on, first.on, *rest, *first.cols.values(), *second.cols.values())


def _attach(on: list[str], out: list[list[str]], columns: list[str]):
    """Arrow batches of features (``_side`` 0 or 1, first) and pairs (null): the pairs with the columns of both features."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list] = [[], []]
        keys = values = None
        for t in _tables(batches):
            for i in range(2):
                seen[i].append(t.filter(pc.equal(t["_side"], i)).select([on[i], f"_f{i}"]))
            pairs = t.filter(pc.is_null(t["_side"]))
            if not pairs.num_rows:
                continue
            if keys is None:
                both = [pa.concat_tables(f).combine_chunks() for f in seen]
                keys, values = [f.column(0).combine_chunks() for f in both], [f.column(1).combine_chunks() for f in both]
            found = pairs.select(columns)
            for i in range(2):
                got = values[i].take(pc.index_in(pairs[on[i]].combine_chunks(), value_set=keys[i]))
                for name, column in zip(out[i], got.flatten(), strict=True):
                    found = found.append_column(name, column)
            yield from found.to_batches(max_chunksize=BATCH_ROWS)

    return run


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The batches, as many in a table as make up ``LOOKUP_ROWS`` rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= LOOKUP_ROWS:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def pair_features(pairs: DataFrame, features: DataFrame, drug: str = "drug_key", target: str = "target_key",
                  key: str = "key", vec: str = "vec", how: str = "left") -> DataFrame:
    """Pair -> drug vector and target vector (two lookups; every pair stays)."""
    return lookup_both(pairs, Side(drug, features, {vec: "drug_vec"}, key), Side(target, features, {vec: "target_vec"}, key), how=how)


BLOCK = ("drug_vecs binary, target_vecs binary, drug_at binary, target_at binary, label binary, n_drugs bigint, n_targets bigint, "
         "kind string")


def pair_blocks(pairs: DataFrame, features: DataFrame, drug: str = "drug_key", target: str = "target_key", label: str = "label",
                key: str = "key", vec: str = "vec", grid_from: int = GRID_ROWS) -> DataFrame:
    """J1 for fits: the labelled pairs with both features, in blocks (``BLOCK``).

    A block has the matrices of its distinct vectors, and per pair its row in each (int32) and its label (float64).  With a
    grid a block is a cell; few pairs are joined as in ``pair_features``, each with vectors of its own."""
    sides = Side(drug, features, {vec: "drug_vec"}, key), Side(target, features, {vec: "target_vec"}, key)
    x = pairs.select(drug, target, F.col(label).cast("double").alias("_y"))
    dealt = _dealt(x, *sides, grid_from)
    if dealt is None:
        both = pair_features(x, features, drug, target, key, vec)
        return both.where("drug_vec IS NOT NULL AND target_vec IS NOT NULL").select("drug_vec", "target_vec", "_y").mapInArrow(_row_blocks, BLOCK)
    dealt = dealt.repartition("_cell").sortWithinPartitions("_cell", F.col("_side").asc_nulls_last())
    return dealt.mapInArrow(_cell_blocks([drug, target]), BLOCK)


def _block_row(vecs: list[pa.Array], at: list[np.ndarray], y: pa.Array | pa.ChunkedArray) -> pa.RecordBatch:
    if y.null_count:
        raise ValueError("pairs without a label cannot be fitted")
    flat = [v.flatten().to_numpy(zero_copy_only=False) for v in vecs]
    row = {"drug_vecs": flat[0].tobytes(), "target_vecs": flat[1].tobytes(), "drug_at": at[0].astype(np.int32).tobytes(),
           "target_at": at[1].astype(np.int32).tobytes(), "label": y.to_numpy().tobytes(), "n_drugs": len(vecs[0]),
           "n_targets": len(vecs[1]), "kind": flat[0].dtype.str}
    return pa.RecordBatch.from_pylist([row])


def _row_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            own = np.arange(b.num_rows)
            yield _block_row([b["drug_vec"], b["target_vec"]], [own, own], b["_y"])


def _cell_blocks(on: list[str]):
    """Features and pairs ordered by cell, the features first: a block for each cell."""
    def block(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(tables).combine_chunks()
        pairs = t.filter(pc.is_null(t["_side"]))
        vecs, at = [], []
        for i in range(2):
            f = t.filter(pc.equal(t["_side"], i))
            if not (f.num_rows and pairs.num_rows):
                return
            v = f[f"_f{i}"].combine_chunks().flatten()[0]
            keys, v = f[on[i]].combine_chunks().filter(v.is_valid()), v.filter(v.is_valid())
            vecs.append(v)
            at.append(pc.fill_null(pc.index_in(pairs[on[i]].combine_chunks(), value_set=keys, skip_nulls=True), -1).to_numpy())
        both = (at[0] >= 0) & (at[1] >= 0)
        if both.any():
            used = [np.unique(a[both], return_inverse=True) for a in at]
            y = pairs["_y"].filter(pa.array(both))
            yield _block_row([v.take(pa.array(u[0])) for v, u in zip(vecs, used, strict=True)], [u[1] for u in used], y)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for t in _tables(batches):
            cells = t["_cell"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and cells[a] != cell:
                    yield from block(held)
                    held = []
                cell = cells[a]
                held.append(t.slice(a, b - a))
        if held:
            yield from block(held)

    return run


def edge_features(edges: DataFrame, features: DataFrame, a: str = "p0", b: str = "p1",
                  key: str = "key", vec: str = "vec", how: str = "left") -> DataFrame:
    """Both ends of an edge looked up in the same feature table (every edge stays)."""
    return lookup_both(edges, Side(a, features, {vec: f"{a}_vec"}, key), Side(b, features, {vec: f"{b}_vec"}, key), how=how)


def unresolved(df: DataFrame, features: DataFrame, on: str, key: str = "key") -> DataFrame:
    """Quarantine: keys of ``df[on]`` without a feature row, and how many rows they hold."""
    missing = df.join(features.select(F.col(key).alias(on)), on, "left_anti")
    return missing.groupBy(F.col(on).alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))


def _last(dictionary: DataFrame, acc: str, seq: str, order: str | None, out: str) -> DataFrame:
    """One row per accession: the last by ``order`` (the largest text without one)."""
    last = F.max_by(F.col(seq), F.col(order)) if order else F.max(F.col(seq))
    return dictionary.groupBy(acc).agg(last.alias(out))


def resolve(ids: DataFrame, primary: DataFrame, fallback: DataFrame, acc: str = "acc", seq: str = "seq",
            order: str | None = None) -> DataFrame:
    """Accession -> sequence from the primary dictionary, else the fall-back table.

    Output keeps every id row with ``source`` in {'primary', 'fallback', NULL}; unresolved rows have
    a NULL sequence (quarantine).  Of repeated dictionary entries the last by ``order`` counts."""
    x = ids.join(_last(primary, acc, seq, order, "_p"), acc, "left").join(_last(fallback, acc, seq, order, "_f"), acc, "left")
    return x.select(
        *[c for c in ids.columns],
        F.coalesce("_p", "_f").alias(seq),
        F.when(F.col("_p").isNotNull(), "primary").when(F.col("_f").isNotNull(), "fallback").alias("source"),
    )


def label_map(df: DataFrame, index: DataFrame, cls: str, idx: str = "idx") -> DataFrame:
    """Class name -> index; classes unseen in train give NULL (Q21)."""
    return df.join(index.select(cls, idx), cls, "left")


def semi(df: DataFrame, keep: DataFrame, on: str) -> DataFrame:
    """Rows whose key is present in ``keep``."""
    return df.join(keep.select(on), on, "left_semi")


def anti(df: DataFrame, drop: DataFrame, on: str) -> DataFrame:
    """Rows whose key is absent from ``drop`` (e.g. keys not yet featurised)."""
    return df.join(drop.select(on), on, "left_anti")


def last_lines(annotations: DataFrame, order: str, on: str = "protein", codes: str = "codes") -> DataFrame:
    """One annotation per protein: later lines replace earlier ones."""
    return annotations.groupBy(on).agg(F.max_by(F.col(codes), F.col(order)).alias(codes))


def annotation_join(proteins: DataFrame, annotations: DataFrame, on: str = "protein",
                    codes: str = "codes") -> tuple[DataFrame, DataFrame]:
    """Proteins with their code lists.  Annotated proteins without codes get an empty list;
    proteins without an annotation row go to the quarantine output (the reference raises, Q27)."""
    a = annotations.select(on, F.col(codes).alias("_c"), F.lit(True).alias("_hit"))
    x = proteins.join(a, on, "left")
    good = x.where(F.col("_hit")).select(*proteins.columns, F.coalesce("_c", F.array().cast("array<string>")).alias(codes))
    bad = x.where(F.col("_hit").isNull()).select(*proteins.columns)
    return good, bad


def code_index(annotations: DataFrame, vocab_index: DataFrame, on: str = "protein", codes: str = "codes",
               code: str = "code", idx: str = "idx") -> DataFrame:
    """Explode code lists and look each code up in the vocabulary."""
    ex = annotations.select(on, F.posexplode(codes).alias("pos", code))
    return ex.join(vocab_index.select(code, idx), code, "left")


def align(preds: DataFrame, labels: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Predictions and labels aligned on an explicit row id (never on position)."""
    return preds.join(labels, row_id)
