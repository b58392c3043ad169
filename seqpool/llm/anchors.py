"""Anchored windows of documents: the seeds from which repeated passages are found.

Every window (a run of consecutive bytes or words of one document) has an anchor, its smallest k-gram.
Equal windows have equal anchors, so windows need only be compared within one anchor, and an anchor
that occurs once in the corpus has no repeated window.  Consecutive windows with one anchor are
one row: (anchor, ctx, d, th, s, e, p) with the anchor's hash, a digest of the run's whole content, the
document's key, and the first window, last window and anchor as positions in the document.

A document's key is its id (``d``; null counts as larger than any) and a hash of its text (``th``), so
that repeated rows and repeated ids are told apart; rows with equal key have equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpool.llm import textarrays as T

NO_ID = (1 << 63) - 1
RUN_SCHEMA = "anchor bigint, ctx bigint, d bigint, th bigint, s int, e int, p int"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), the key (d, th), and ``rest``: a struct of the other columns."""
    rest = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    spare = "".join(["none", *docs.columns])  # a struct needs a field, and this is no column's name
    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.struct(*rest, F.lit(0).alias(spare)).alias("rest"))
    return x.select("doc_id", "text", "rest", F.coalesce("doc_id", F.lit(NO_ID)).cast("bigint").alias("d"),
                    F.xxhash64("text").alias("th"))


def unit_values(unit: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit values of the units (``bytes`` or ``words``) of a chunk, and each text's first unit."""
    if unit == "bytes":
        return T.byte_values()[data], offsets
    return T.word_hashes(data, offsets)


def _long_pieces(unit: str, data: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shift, values, starts) of pieces of one very long text that share window - 1 units, so that each window is in one.

    A run that a piece cuts becomes two; that changes contexts, not which windows have an equal."""
    units = data if unit == "bytes" else T.word_hashes(data, np.array([0, len(data)]))[0]
    step = T.LONG_BYTES // 8
    for lo in range(0, max(1, len(units) - window + 1), step):
        piece = units[lo: lo + step + window - 1]
        yield lo, T.byte_values()[piece] if unit == "bytes" else piece, np.array([0, len(piece)])


def window_runs(docs: DataFrame, unit: str, window: int, k: int) -> DataFrame:
    """The runs of all windows of ``keyed`` documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in T.chunks(batch):
                if part.num_rows > 1 or len(data) <= T.LONG_BYTES:
                    pieces = [(0, *unit_values(unit, data, offsets))]
                else:
                    pieces = _long_pieces(unit, data, window)
                for shift, values, starts in pieces:
                    text, first, last, place, anchor = T.anchor_runs(values, starts, window, k)
                    if not len(text):
                        continue
                    base = starts[text]
                    ctx = T.span_hashes(values, base + first, base + last + window)
                    d = np.asarray(part.column("d"))[text]
                    th = np.asarray(part.column("th"))[text]
                    at = [(x + shift).astype(np.int32) for x in (first, last, place)]
                    cols = [anchor.view(np.int64), ctx.view(np.int64), d, th, *at]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [c.split()[0] for c in RUN_SCHEMA.split(", ")])

    return docs.select("text", "d", "th").mapInArrow(run, RUN_SCHEMA)


def spans_by_document(spans: DataFrame) -> DataFrame:
    """(d, th, spans) from rows (d, th, a, b); bounded by what one document holds."""
    return spans.groupBy("d", "th").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def covered(n: int, spans: list) -> np.ndarray:
    """Which of n units the half-open spans cover."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for x in spans or ():
        edge[x["a"]] += 1
        edge[x["b"]] -= 1
    return np.cumsum(edge[:n]) > 0
