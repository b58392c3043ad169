"""Functions over whole arrays: numpy on the flat values of an Arrow batch of lists, no step per element.

Spark's higher-order functions interpret their lambda for each element, which tells on arrays of a text's length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

PIECE = 1 << 18  # elements worked on at once where each takes much more room than its own


def _flat(x: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """The lists' values and where in them each list begins (and the last one ends)."""
    if not len(x):
        return x.values.slice(0, 0), np.zeros(1, np.int64)
    at = x.offsets.to_numpy().astype(np.int64)
    return x.values.slice(at[0], at[-1] - at[0]), at - at[0]


def _plain(v: pa.Array) -> np.ndarray:
    """The values, 0 for null."""
    return (v.fill_null(0) if v.null_count else v).to_numpy()


def _nulls(x: pa.Array) -> np.ndarray:
    return x.is_null().to_numpy(zero_copy_only=False)


def _index(at: np.ndarray) -> np.ndarray:
    """The place of each value in its list."""
    return np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))


def _like(x: pa.ListArray, at: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of other values, as long as those of ``x`` and null where they are."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values, mask=pa.array(_nulls(x)) if x.null_count else None)


def _totals(x: pa.ListArray, v: pa.Array, values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A sum per list; null for a null list and for one that holds a null."""
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    none = _nulls(x)
    if v.null_count:
        holes = np.concatenate([np.zeros(1, np.int64), np.cumsum(_nulls(v))])
        none = none | (holes[at[1:]] > holes[at[:-1]])
    return pa.array(run[at[1:]] - run[at[:-1]], pa.int64(), mask=none)


def sums(x: pa.ListArray) -> pa.Array:
    v, at = _flat(x)
    return _totals(x, v, _plain(v), at)


def indexed_sums(x: pa.ListArray) -> pa.Array:
    v, at = _flat(x)
    return _totals(x, v, _plain(v) * (_index(at) + 1), at)


def lengths(x: pa.ListArray) -> pa.Array:
    return pa.array(np.diff(_flat(x)[1]), pa.int64(), mask=_nulls(x))


def indices(x: pa.ListArray) -> pa.ListArray:
    """0 .. n-1 for a list of n entries."""
    _, at = _flat(x)
    return _like(x, at, pa.array(_index(at), pa.int32()))


def constant(x: pa.ListArray, value: int) -> pa.ListArray:
    """As many times ``value`` as the list has entries."""
    _, at = _flat(x)
    return _like(x, at, pa.array(np.full(at[-1], value, dtype=np.int32)))


def placed(x: pa.ListArray) -> pa.ListArray:
    """A point per entry of a list of integers: (entry, index, index^2 mod 17)."""
    v, at = _flat(x)
    i = _index(at)
    rows, holes = np.empty((len(i), 3)), None
    rows[:, 0], rows[:, 1], rows[:, 2] = _plain(v), i, i * i % 17
    if v.null_count:
        holes = np.zeros(rows.shape, dtype=bool)
        holes[:, 0] = _nulls(v)
        holes = holes.ravel()
    points = pa.ListArray.from_arrays(pa.array(np.arange(len(i) + 1) * 3, pa.int32()), pa.array(rows.ravel(), mask=holes))
    return _like(x, at, points)


def zipped(fields: dict[str, pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays([*fields.values()], names=[*fields])


def pieces(x: pa.ListArray, most: int = PIECE) -> Iterator[pa.ListArray]:
    """Runs of lists with at most ``most`` entries together; a longer list stands alone."""
    if not len(x):
        yield x
        return
    at, i = x.offsets.to_numpy(), 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(at, int(at[i]) + most, side="right")) - 1)
        yield x.slice(i, j - i)
        i = j


@arrow_udf(LongType())
def _int_sum(x: pa.Array) -> pa.Array:
    return sums(x)


@arrow_udf(LongType())
def _indexed_sum(x: pa.Array) -> pa.Array:
    return indexed_sums(x)


def int_sum(arr: Column) -> Column:
    """Sum of an array of integers, 0 for an empty one."""
    return _int_sum(arr)


def indexed_sum(arr: Column) -> Column:
    """Sum of the integers of an array, each times its place counted from 1; 0 for an empty one."""
    return _indexed_sum(arr)
