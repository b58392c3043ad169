"""String-side column functions: store keys, tokenizers, residue ids, hashed fingerprints."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf, pandas_udf
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType

# ---- fixed values (must equal the reference / its libraries) -----------------------------
# Character tokenizer of the second protein encoder: the characters below get ids 3, 4, 5, ...
# in this order ('1' and '2' are the start / end terminals; there is no 'J').  Ids 0-2 are the
# pad / bos / eos specials, which never come from characters.
TOKENIZER_CHARS = "12ABCDEFGHIKLMNOPQRSTUVWXYZ"
TOKENIZER_FIRST_ID = 3
# Residue letter -> id of the structure task's residue table (unknown letters -> 0):
# G A S P V T C I L N D Q K E M H F R Y W get ids 0 .. 19 in this order.
RESIDUE_LETTERS = "GASPVTCILNDQKEMHFRYW"
# ------------------------------------------------------------------------------------------


def _lut(chars_: str, first: int, default: int) -> np.ndarray:
    lut = np.full(128, default, dtype=np.int64)
    for i, ch in enumerate(chars_):
        lut[ord(ch)] = first + i
    return lut


def _codepoints(s) -> np.ndarray:
    if s is None:
        return np.zeros(0, dtype=np.int64)
    return np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32).astype(np.int64)


def _lookup(cp: np.ndarray, lut: np.ndarray, default: int) -> np.ndarray:
    out = np.full(cp.shape, default, dtype=np.int64)
    small = cp < 128
    out[small] = lut[cp[small]]
    return out


def sanitize_key(c: Column) -> Column:
    """Store key with '/' replaced by '|' (distinct strings can collide, Q5)."""
    return F.translate(c, "/", "|")


_TOK_LUT = _lut(TOKENIZER_CHARS, TOKENIZER_FIRST_ID, -1)
_RES_LUT = _lut(RESIDUE_LETTERS, 0, 0)


@pandas_udf(ArrayType(IntegerType()))
def _char_tokenize(s: pd.Series) -> pd.Series:
    out = []
    for x in s.to_numpy():
        ids = _lookup(_codepoints(None if x is None else "1" + x + "2"), _TOK_LUT, -1)
        out.append(ids[ids >= 0].astype(np.int32))
    return pd.Series(out)


# by the first UTF-8 byte of a character: those of several bytes are unknown letters
_RES_BYTES = np.concatenate([_RES_LUT, np.zeros(128, dtype=np.int64)]).astype(np.int32)


@arrow_udf(ArrayType(IntegerType()))
def _residue_ids(s: pa.Array) -> pa.Array:
    s = s.cast(pa.string()).fill_null("")
    if not len(s):
        return pa.array([], pa.list_(pa.int32()))
    ends = np.frombuffer(s.buffers()[1], dtype=np.int32)[s.offset:s.offset + len(s) + 1]
    raw = np.frombuffer(s.buffers()[2] or b"", dtype=np.uint8)[ends[0]:ends[-1]]
    first = raw[(raw & 0xC0) != 0x80]  # a byte for each character
    at = np.concatenate([np.zeros(1, np.int64), np.cumsum(pc.utf8_length(s).to_numpy(), dtype=np.int64)])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(_RES_BYTES[first]))


def char_tokenize(seq: Column) -> Column:
    """H1: ids of '1' + seq + '2'; characters outside the vocabulary are dropped.
    A lookup table over code points per Arrow batch (linear in the text length)."""
    return _char_tokenize(seq)


def residue_ids(seq: Column) -> Column:
    """H2: residue letter -> id, unknown -> 0; no ids for null.  A lookup by byte over a whole Arrow batch."""
    return _residue_ids(seq)


# n-gram hash: p = sum_k c_k * 31^(n-1-k) mod 2^32 over code points; h = p * 2654435761 mod 2^32;
# bucket = h * n_bits div 2^32 (multiply-shift into [0, n_bits)).
HASH_MULT = 2654435761
HASH_BASE = 31


def ngram_bucket_array(x, n: int, n_bits: int) -> np.ndarray:
    """Sorted distinct buckets of one text: n shifted adds over its code points, and a bitmap in place of a sort."""
    cp = _codepoints(x).astype(np.uint64)
    m = len(cp) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.int64)
    p = cp[:m].copy()
    for k in range(1, n):
        p *= np.uint64(HASH_BASE)
        p += cp[k:k + m]
    p &= np.uint64(0xFFFFFFFF)
    h = (p * np.uint64(HASH_MULT)) & np.uint64(0xFFFFFFFF)
    seen = np.zeros(n_bits, dtype=bool)
    seen[((h * np.uint64(n_bits)) >> np.uint64(32)).astype(np.int64)] = True
    return np.flatnonzero(seen)


def ngram_buckets(seq: Column, n: int, n_bits: int) -> Column:
    """Sorted distinct bucket ids of all length-n substrings of the whole text."""

    @pandas_udf(ArrayType(LongType()))
    def _b(s: pd.Series) -> pd.Series:
        return pd.Series([ngram_bucket_array(x, n, n_bits) for x in s.to_numpy()])

    return _b(seq)


def hashed_fingerprint(seq: Column, n_bits: int = 2048, radius: int = 2) -> Column:
    """U3 (re-aimed): binary fingerprint of hashed character n-grams (n = radius + 1), kept sparse as
    the sorted set-bit indices.  Invalid input (NULL, or shorter than one n-gram) has no set bits,
    i.e. the all-zero fingerprint (P9)."""
    n = radius + 1
    valid = seq.isNotNull() & (F.length(seq) >= n)
    return F.when(valid, ngram_buckets(seq, n, n_bits)).otherwise(F.array().cast("array<bigint>"))


def dense_bits(indices: Column, n_bits: int) -> Column:
    """Sparse set-bit indices -> dense ARRAY<FLOAT> of length n_bits (numpy per Arrow batch)."""

    @pandas_udf(ArrayType(FloatType()))
    def _dense(idx: pd.Series) -> pd.Series:
        out = np.zeros((len(idx), n_bits), dtype=np.float32)
        for r, ix in enumerate(idx.to_numpy()):
            if ix is not None and len(ix):
                out[r, np.asarray(ix, dtype=np.int64)] = 1.0
        return pd.Series(list(out))

    return _dense(indices)


_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def upper_ascii(text: Column) -> Column:
    """a-z upper-cased; every other character stays as it is (unknown characters reach the tokenizers)."""
    return F.translate(text, _LOWER, _UPPER)


@arrow_udf(StringType())
def _upper_ascii(s: pa.Array) -> pa.Array:
    return pc.ascii_upper(s)


def upper_ascii_batch(text: Column) -> Column:
    """``upper_ascii`` of a whole Arrow batch, for texts that go on to an Arrow function; F.translate looks up each character."""
    return _upper_ascii(text)
