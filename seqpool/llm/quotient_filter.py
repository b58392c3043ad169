"""Counting quotient filters over packed n-grams: sorted, lossless, mergeable.

An n-gram of ``n`` word ids of ``bits`` bits is one integer of ``n * bits`` bits, held as one unsigned 64-bit array, or as
several limbs where it is wider.  ``Keys.permute`` maps it one to one onto an integer of the same width whose leading
bits are even; ``Keys.restore`` undoes it.  The leading ``shard_bits`` of a permuted key name its shard, the next bits
are its quotient, all other bits its remainder, so nothing is lost.  A filter stores, in key order, a unary bit string of
the entries per quotient, the remainders in whole bytes, and counters of a byte (255: eight bytes, at the end).

Order by (quotient, remainder) is order by permuted key, so filters of one shard are merged as sorted runs.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from seqpool.llm.textarrays import mix

_U = np.uint64
_HEAD = struct.Struct("<QBQ")  # entries, quotient bits, counters of eight bytes
ROUNDS = 3


def _mask(width: int) -> np.uint64:
    return _U((1 << width) - 1)


def _moved(x: np.ndarray, left: int) -> np.ndarray:
    """x shifted left by ``left`` bits (right, if negative); bits beyond the 64 fall away."""
    if left <= -64 or left >= 64:
        return np.zeros_like(x)
    return x << _U(left) if left >= 0 else x >> _U(-left)


@dataclass(frozen=True)
class Keys:
    """Packing and permutation of n-grams of ``n`` ids of ``bits`` bits."""

    n: int
    bits: int

    @property
    def width(self) -> int:
        return self.n * self.bits

    @property
    def limbs(self) -> list[int]:
        """Widths of the parts that the permutation mixes, leading part first: at least two."""
        k = max(2, -(-self.width // 64))
        return [self.width // k + (i < self.width % k) for i in range(k)]

    @property
    def widths(self) -> list[int]:
        """Widths of the arrays of a permuted key: one array where it fits 64 bits."""
        return [self.width] if self.width <= 64 else self.limbs

    def pack(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        out, low = [], self.width
        for w in self.limbs:
            low -= w
            limb = np.zeros(len(ids[0]), dtype=_U)
            for j, x in enumerate(ids):
                limb |= _moved(x.astype(_U), (self.n - 1 - j) * self.bits - low)
            out.append(limb & _mask(w))
        return out

    def unpack(self, limbs: list[np.ndarray]) -> list[np.ndarray]:
        ids = [np.zeros(len(limbs[0]), dtype=_U) for _ in range(self.n)]
        low = self.width
        for limb, w in zip(limbs, self.limbs, strict=True):
            low -= w
            for j in range(self.n):
                ids[j] |= _moved(limb, low - (self.n - 1 - j) * self.bits)
        return [x & _mask(self.bits) for x in ids]

    def _steps(self) -> list[tuple[int, int]]:
        return [(r, i) for r in range(ROUNDS) for i in range(len(self.limbs))]

    def _step(self, limbs: list[np.ndarray], r: int, i: int) -> None:
        limbs[i] = limbs[i] ^ (mix(limbs[i - 1] + _U(0x9E3779B97F4A7C15 * (16 * r + i + 1) % (1 << 64))) & _mask(self.limbs[i]))

    def permute(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """Permuted keys of n-grams (an array of ids per place)."""
        limbs = self.pack(ids)
        for r, i in self._steps():
            self._step(limbs, r, i)
        return limbs if self.width > 64 else [limbs[0] << _U(self.limbs[1]) | limbs[1]]

    def restore(self, keys: list[np.ndarray]) -> list[np.ndarray]:
        """The n-grams of permuted keys."""
        limbs = list(keys)
        if self.width <= 64:
            limbs = [keys[0] >> _U(self.limbs[1]), keys[0] & _mask(self.limbs[1])]
        for r, i in reversed(self._steps()):
            self._step(limbs, r, i)
        return self.unpack(limbs)

    def shard(self, keys: list[np.ndarray], shard_bits: int) -> np.ndarray:
        return _moved(keys[0], -(self.widths[0] - self.shard_bits(shard_bits))).astype(np.int64)

    def shard_bits(self, wanted: int) -> int:
        return min(wanted, self.widths[0])


def _order(keys: list[np.ndarray]) -> np.ndarray:
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def _fresh(keys: list[np.ndarray]) -> np.ndarray:
    """Whether a sorted key differs from the one before."""
    out = np.zeros(len(keys[0]), dtype=bool)
    out[:1] = True
    for x in keys:
        out[1:] |= x[1:] != x[:-1]
    return out


def count_keys(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct keys and how often each occurs."""
    keys = [np.sort(keys[0])] if len(keys) == 1 else [x[o] for o in [_order(keys)] for x in keys]
    at = np.flatnonzero(_fresh(keys))
    return [x[at] for x in keys], np.diff(np.append(at, len(keys[0])))


def merge(parts: list[tuple[list[np.ndarray], np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Merged sorted runs: distinct keys, summed counters, and the place of every entry of the parts among them."""
    keys = [np.concatenate(x) for x in zip(*(p[0] for p in parts), strict=True)]
    counts = np.concatenate([p[1] for p in parts])
    order = _order(keys)
    keys = [x[order] for x in keys]
    fresh = _fresh(keys)
    at = np.flatnonzero(fresh)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.cumsum(fresh) - 1
    return [x[at] for x in keys], np.add.reduceat(counts[order], at) if len(at) else counts, place


def member(keys: list[np.ndarray], among: list[np.ndarray]) -> np.ndarray:
    """Whether each key is one of the sorted distinct keys ``among``."""
    if not len(among[0]):
        return np.zeros(len(keys[0]), dtype=bool)
    if len(keys) == 1:
        at = np.minimum(np.searchsorted(among[0], keys[0]), len(among[0]) - 1)
        return among[0][at] == keys[0]
    n = len(among[0])
    distinct, _, place = merge([(among, np.ones(n, np.int64)), (keys, np.ones(len(keys[0]), np.int64))])
    known = np.zeros(len(distinct[0]), dtype=bool)
    known[place[:n]] = True
    return known[place[n:]]


def _low_bytes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, : -(-width // 8)].tobytes()


def encode(kind: Keys, keys: list[np.ndarray], counts: np.ndarray, shard_bits: int) -> bytes:
    """A filter of sorted distinct keys of one shard."""
    n, first = len(counts), kind.widths[0] - kind.shard_bits(shard_bits)
    q = min(first, max(0, n.bit_length() - 1))
    rest = first - q
    inner = keys[0] & _mask(first)
    per_quotient = np.bincount(_moved(inner, -rest).astype(np.int64), minlength=1 << q)
    unary = np.ones(n + (1 << q), dtype=np.uint8)
    unary[np.cumsum(per_quotient) + np.arange(1 << q)] = 0
    large = counts >= 255
    parts = [_HEAD.pack(n, q, int(large.sum())), np.packbits(unary).tobytes(), _low_bytes(inner & _mask(rest), rest)]
    parts += [_low_bytes(x, w) for x, w in zip(keys[1:], kind.widths[1:], strict=True)]
    parts += [np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype("<u8").tobytes()]
    return b"".join(parts)


def decode(kind: Keys, raw: bytes, shard: int, shard_bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct keys and counters of a filter."""
    n, q, n_large = _HEAD.unpack_from(raw)
    at, first = _HEAD.size, kind.widths[0] - kind.shard_bits(shard_bits)
    rest, size = first - q, n + (1 << q)
    unary = np.unpackbits(np.frombuffer(raw, np.uint8, -(-size // 8), at))[:size]
    at += -(-size // 8)
    quotient = (np.flatnonzero(unary) - np.arange(n)).astype(_U)

    def low(width: int) -> np.ndarray:
        nonlocal at
        wide = np.zeros((n, 8), dtype=np.uint8)
        taken = -(-width // 8)
        wide[:, :taken] = np.frombuffer(raw, np.uint8, n * taken, at).reshape(n, taken)
        at += n * taken
        return wide.view("<u8").ravel()

    keys = [_moved(np.full(n, shard, dtype=_U), first) | _moved(quotient, rest) | low(rest)]
    keys += [low(w) for w in kind.widths[1:]]
    counts = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<u8", n_large, at + n).astype(np.int64)
    return keys, counts
