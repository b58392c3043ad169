"""Deterministic parameter sets (slicers, references, weights, projectors).

Parameters are small driver-side arrays whose size is fixed by the model shape (L, M, d),
never by the data.  The integer formulas let the DuckDB oracle build identical values.
"""

from __future__ import annotations

import math

import numpy as np

# Machine epsilon of float32: the reference adds it to the interpolation slope denominator.
INTERP_EPS = 1.1920929e-07


def slicers(n_slices: int, dim: int) -> np.ndarray:
    """theta[l, d] = ((l*31 + d*17) % 23 - 11) / 11, each row scaled to unit L2 norm."""
    l = np.arange(n_slices)[:, None]
    d = np.arange(dim)[None, :]
    raw = ((l * 31 + d * 17) % 23 - 11) / 11.0
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def linspace_reference(n_ref: int, n_slices: int) -> np.ndarray:
    """The reference's initial value: linspace(-1, 1, M) repeated on every slice (M x L)."""
    col = np.array([-1.0]) if n_ref == 1 else np.array([-1.0 + 2.0 * m / (n_ref - 1) for m in range(n_ref)])
    return np.repeat(col[:, None], n_slices, axis=1)


def permuted_reference(n_ref: int, n_slices: int) -> np.ndarray:
    """A trained-looking reference: per slice a permutation of linspace(-1, 1, M).

    R[m, l] = -1 + 2 * ((m*7 + l*3) % M) / (M - 1).  Unsorted on purpose: the output then
    depends on argsort-vs-rank alignment (trap Q12)."""
    m = np.arange(n_ref)[:, None]
    l = np.arange(n_slices)[None, :]
    if n_ref == 1:
        return -np.ones((1, n_slices))
    return -1.0 + 2.0 * ((m * 7 + l * 3) % n_ref) / (n_ref - 1)


def ref_weights(n_ref: int) -> np.ndarray:
    """w[m] = ((m % 7) + 1) / (4 M)."""
    m = np.arange(n_ref)
    return ((m % 7) + 1) / (4.0 * n_ref)


def projector(n_out: int, n_in: int, offset: int = 0) -> np.ndarray:
    """W[o, i] = ((o*13 + i*7 + offset) % 19 - 9) / 90."""
    o = np.arange(n_out)[:, None]
    i = np.arange(n_in)[None, :]
    return ((o * 13 + i * 7 + offset) % 19 - 9) / 90.0


def swe_effective_weights(reference: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fold reference and weights into (C[l], W_eff[l, j]) so that

        out_l = sum_m w_m (R[m,l] - q[argsort(R[:,l])[m]]) = C[l] - sum_j W_eff[l,j] * q_j

    (the quantile sampled at reference index argsort_m gets weight w_m)."""
    ref = np.asarray(reference, dtype=np.float64)
    w = np.asarray(weights, dtype=np.float64).reshape(-1)
    n_ref, n_slices = ref.shape
    const = (w[:, None] * ref).sum(axis=0)
    w_eff = np.zeros((n_slices, n_ref))
    for l in range(n_slices):
        order = np.argsort(ref[:, l], kind="stable")
        w_eff[l, order] = w
    return const, w_eff


def xavier_scale(n_out: int, n_in: int) -> float:
    return math.sqrt(2.0 / (n_in + n_out))
