"""Vectorised work on the texts of an Arrow batch: word hashes, k-gram hashes, anchors of windows.

Texts are joined into one byte array per chunk of about ``CHUNK_BYTES`` (a text is never cut), and
every step is a numpy operation over the chunk, so no loop runs per word or byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 17  # the arrays of a chunk then stay in a core's cache
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = _U(pow(int(BASE), -1, 1 << 64))
SPACES = b" \t\n\x0b\x0c\r"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


@lru_cache(maxsize=None)
def byte_values(seed: int = 1) -> np.ndarray:
    """A pseudo-random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95) + _U(seed))


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of pieces of the batch; null texts are empty."""
    at, n = 0, batch.num_rows
    while at < n:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column).slice(at)), 0), dtype=np.int64)
        take = max(1, int(np.searchsorted(np.cumsum(sizes), CHUNK_BYTES, side="right")))
        part = batch.slice(at, take)
        text = pc.fill_null(part.column(column).cast(pa.large_binary()), b"")
        data = b"".join(text.to_pylist())
        offsets = np.concatenate([[0], np.cumsum(sizes[:take])]).astype(np.int64)
        yield part, np.frombuffer(data, dtype=np.uint8), offsets
        at += take


def lower_ascii(data: np.ndarray) -> np.ndarray:
    upper = (data >= 65) & (data <= 90)
    return data + (upper.astype(np.uint8) << 5)


@lru_cache(maxsize=8)
def _power_table(size: int, base: int) -> np.ndarray:
    out = np.full(size, base, dtype=_U)
    out[0] = 1
    return np.cumprod(out, out=out)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base ** 0 .. base ** (n - 1); tables of a chunk's size are kept."""
    size = 1 << max(n, 2 * CHUNK_BYTES).bit_length()
    return _power_table(size, int(base))[:n] if size <= 8 * CHUNK_BYTES else _power_table.__wrapped__(n, int(base))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of the words: runs without white space inside one text."""
    space = np.zeros(256, dtype=bool)
    space[list(SPACES)] = True
    inside = ~space[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] |= inside[edges]  # a word of the next text right behind one of this text
    ends[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span values[start:end] of 64-bit values."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(values * _powers(n, BASE), out=sums[1:])
    inverse = _powers(n + 1, BASE_INVERSE)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + mix((ends - starts).astype(_U)))


LONG_BYTES = 1 << 22  # a single text above this is worked on piece by piece, so that no array of eight bytes a byte is made


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the index of the first word of each text (one entry more than texts)."""
    if len(offsets) == 2 and len(data) > LONG_BYTES:
        space = np.zeros(256, dtype=bool)
        space[list(SPACES)] = True
        found, at = [], 0
        while at < len(data):
            stop = min(at + LONG_BYTES // 4, len(data))
            while stop < len(data) and not space[data[stop]]:
                stop += 1  # a piece ends before white space
            found.append(word_hashes(data[at:stop], np.array([0, stop - at]))[0] if stop - at <= LONG_BYTES else
                         _one_long(data[at:stop]))
            at = stop
        hashes = np.concatenate(found)
        return hashes, np.array([0, len(hashes)])
    starts, ends = words(data, offsets)
    return span_hashes(byte_values()[data], starts, ends), np.searchsorted(starts, offsets)


def _one_long(data: np.ndarray) -> np.ndarray:
    """Hashes of a piece whose last word is longer than ``LONG_BYTES``: no cheaper way for one huge word."""
    starts, ends = words(data, np.array([0, len(data)]))
    return span_hashes(byte_values()[data], starts, ends)


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k consecutive values from each position (len - k + 1 entries, at least none)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    power = values.astype(_U)
    width, done, bits = 1, 0, k  # joins spans of 1, 2, 4, ... values
    scale = BASE
    while bits:
        if bits & 1:
            out = out * scale + power[done: done + n]  # the spans of 1, 2, 4, ... values from the left
            done += width
        bits >>= 1
        if bits:
            m = len(power) - width
            power = power[:m] * scale + power[width: width + m]
            width, scale = width * 2, _U(int(scale) ** 2 % (1 << 64))
    return mix(out)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: of two runs of minima over blocks of w values."""
    n = len(x) - w + 1
    if n <= 0:
        return np.empty(0, dtype=x.dtype)
    pad = -len(x) % w
    top = np.iinfo(x.dtype).max
    blocks = np.concatenate([x, np.full(pad, top, dtype=x.dtype)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1: w - 1 + n])


POSITION_BITS = _U(24)


def anchor_runs(values: np.ndarray, text_starts: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows of one text that share their anchor.

    A window's anchor is its leftmost k-gram of smallest hash, so equal windows have equal anchors at
    the same place, and a run has at most window - k + 1 windows.  Returns text index, start of the
    first and of the last window and of the anchor (relative to the text), and the anchor's hash."""
    n_texts = len(text_starts) - 1
    empty = np.empty(0, dtype=np.int64)
    if n_texts <= 0 or len(values) < window:
        return empty, empty, empty, empty, np.empty(0, dtype=_U)
    grams = gram_hashes(values, k)
    low = (_U(1) << POSITION_BITS) - _U(1)
    at = np.arange(len(grams), dtype=_U)
    least = sliding_min((grams & ~low) | (at & low), window - k + 1)
    n = len(least)
    text = np.repeat(np.arange(n_texts), np.diff(text_starts))[:n]
    whole = np.arange(n) + window <= text_starts[1:][text]
    change = np.ones(n, dtype=bool)
    change[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    last = np.concatenate([first[1:], [n]]) - 1
    keep = whole[first]
    first, last = first[keep], last[keep]
    place = first + (((least[first] & low) - (first.astype(_U) & low)) & low).astype(np.int64)
    base = text_starts[text[first]]
    return text[first], first - base, last - base, place - base, grams[place]
