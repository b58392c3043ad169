"""Batch inference: a model made once per Python worker and fed with batches of bounded size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

BATCH_BYTES = 1 << 20  # of input vectors in one call of a model


def batch_scorer(make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], width: int, batch_bytes: int = BATCH_BYTES) -> Callable[[Column], Column]:
    """A function of a vector column that gives the model's output vector.

    ``make_model`` is called once per worker; the model takes a matrix (rows, width) and returns one row of outputs per
    row.  A null vector gives null; a vector of another width is an error."""
    score = predict_batch_udf(make_model, return_type=ArrayType(DoubleType()), batch_size=max(1, batch_bytes // (8 * width)),
                              input_tensor_shapes=[[width]])
    nothing = F.array_repeat(F.lit(0.0), width)
    return lambda vec: F.when(vec.isNotNull(), score(F.coalesce(vec.cast("array<double>"), nothing)))


def multilabel_model(w1: np.ndarray, w2: np.ndarray, mean1=None, var1=None, mean2=None, var2=None, slope: float = 0.2,
                     eps: float = 1e-5) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    """T5 in evaluation form over a matrix; the same function as ``score.multilabel_mlp`` of a column."""
    w1, w2 = np.asarray(w1, dtype=np.float64), np.asarray(w2, dtype=np.float64)

    def normed(x: np.ndarray, mean, var) -> np.ndarray:
        y = (x - (0.0 if mean is None else np.asarray(mean))) / np.sqrt((1.0 if var is None else np.asarray(var)) + eps)
        return np.where(y > 0, y, slope * y)

    def make() -> Callable[[np.ndarray], np.ndarray]:
        return lambda x: normed(normed(x, mean1, var1) @ w1.T, mean2, var2) @ w2.T

    return make
