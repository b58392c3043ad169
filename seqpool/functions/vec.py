"""Column expressions over fixed-length vectors (ARRAY<FLOAT|DOUBLE>), evaluated in the JVM.

All functions return ``Column`` objects; nothing here collects data.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lit_vector(values: Sequence[float]) -> Column:
    """A literal ARRAY<DOUBLE> (parameters only; size fixed by the model, not the data).

    Built as one JSON literal parsed once by constant folding, so a large parameter array
    costs one expression node instead of one per element."""
    arr = np.asarray(values, dtype=np.float64).reshape(-1)
    return F.from_json(F.lit(json.dumps([float(x) for x in arr])), "array<double>")


def lit_matrix(rows) -> Column:
    """A literal ARRAY<ARRAY<DOUBLE>> (row-major)."""
    m = np.asarray(rows, dtype=np.float64)
    return F.from_json(F.lit(json.dumps([[float(x) for x in r] for r in m])), "array<array<double>>")


def to_double(v) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def vsum(v) -> Column:
    return F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def sq_euclidean(a, b) -> Column:
    d = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x * x)


def euclidean(a, b) -> Column:
    return F.sqrt(sq_euclidean(a, b))


def cosine(a, b, eps: float = 1e-8) -> Column:
    """Cosine similarity with each norm clamped at ``eps`` (zero vector -> 0); clamped to [-1, 1] (Q24)."""
    den = F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps))
    return F.least(F.greatest(dot(a, b) / den, F.lit(-1.0)), F.lit(1.0))


def matvec(matrix, v, bias=None) -> Column:
    """W @ v with W a literal matrix (list of rows) or an ARRAY<ARRAY<DOUBLE>> column."""
    m = lit_matrix(matrix) if not isinstance(matrix, Column) else matrix
    out = F.transform(m, lambda row: dot(row, _c(v)))
    if bias is not None:
        b = lit_vector(bias) if not isinstance(bias, Column) else bias
        out = F.zip_with(out, b, lambda x, y: x + y)
    return out


def normalize_rows(matrix) -> Column:
    """Unit-L2 rows of an ARRAY<ARRAY<DOUBLE>> column (weight-norm with g = 1)."""
    return F.transform(_c(matrix), lambda row: F.transform(row, lambda x: x / norm(row)))


def vadd(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def vscale(a, s) -> Column:
    s = F.lit(s) if not isinstance(s, Column) else s
    return F.transform(_c(a), lambda x: x * s)
