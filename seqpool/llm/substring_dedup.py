"""Substring dedup on words: seed and extend.

Seeds are the anchors (winnowed word k-grams) that documents share, joined on their hash.  Equal surroundings
of a seed are one context.  From a seed that two contexts share, the match is extended to the left and to the
right as far as the words agree; the maximal repeats of at least ``window`` words are kept.  Every window of
a repeat whose words also start in a document with a smaller id is removed.

Contexts of one seed are compared pairwise only up to ``PAIRWISE`` of them.  A hotter seed is grown to the whole
window instead: its windows are grouped by their full hash, with partial aggregation, so no group is ever held in a
task and nothing is left out.

Defined results: null or empty texts have no words; texts below the window keep all; rows with one doc_id are
not smaller than each other, so repeated rows lose the same words; a null doc_id is larger than any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpool.llm import anchors as A
from seqpool.llm import textarrays as T
from seqpool.llm.common import written

WINDOW_WORDS = 50
SEED_WORDS = 8
PAIRWISE = 48  # contexts of one seed that are compared pairwise

_CONTEXT = "anchor bigint, ctx bigint, d bigint, words binary, place int, grown bigint, rel int"
_SPAN = "anchor bigint, ctx bigint, a int, b int"


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)],
                                      [n for n, _ in fields])


def context_rows(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """The wanted contexts with their words, or, where ``hot``, a row per window with its hash.

    ``wanted``: anchor, ctx, d, th, s, e, p, hot; one row per context."""
    by_doc = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("anchor", "ctx", "s", "e", "p", "hot")).alias("ctxs"))
    texts = docs.join(by_doc, ["d", "th"])  # repeated rows give a context more than once; see extended

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in T.chunks(batch):
                values, starts = T.word_hashes(data, offsets)
                rows: list[tuple] = []
                for i, (d, ctxs) in enumerate(zip(part.column("d").to_pylist(), part.column("ctxs").to_pylist(), strict=True)):
                    base = int(starts[i])
                    for c in ctxs:
                        lo, hi = base + c["s"], base + c["e"] + window
                        if not c["hot"]:
                            rows.append((c["anchor"], c["ctx"], d, values[lo:hi].tobytes(), c["p"] - c["s"], None, None))
                            continue
                        at = np.arange(lo, hi - window + 1)
                        grown = T.span_hashes(values[lo:hi], at - lo, at - lo + window).view(np.int64)
                        rows += [(c["anchor"], c["ctx"], d, None, None, int(g), j) for j, g in enumerate(grown)]
                if rows:
                    yield _batch(list(zip(*rows, strict=True)), _CONTEXT)

    return texts.select("text", "d", "ctxs").mapInArrow(run, _CONTEXT)


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading values of the two agree."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def extend_group(contexts: list[dict], window: int) -> list[tuple[int, int, int]]:
    """(context index, first word, end word) of the maximal repeats that a context shares with one of a smaller id."""
    order = sorted(range(len(contexts)), key=lambda i: contexts[i]["d"])
    words = [np.frombuffer(c["words"], dtype=np.uint64) for c in contexts]
    found = []
    for at, i in enumerate(order):
        x, p = words[i], contexts[i]["place"]
        spans = set()
        for j in order[:at]:
            if contexts[j]["d"] >= contexts[i]["d"]:
                break
            y, q = words[j], contexts[j]["place"]
            right = _agree(x[p:], y[q:])
            left = _agree(x[:p][::-1], y[:q][::-1])
            if left + right >= window:
                spans.add((p - left, p + right))
        found += [(i, a, b) for a, b in spans]
    return found


def extended(contexts: DataFrame, window: int) -> DataFrame:
    """(anchor, ctx, a, b): the repeats of contexts, in words from the context's start."""
    groups = contexts.where(F.col("words").isNotNull()).groupBy("anchor").agg(
        F.collect_set(F.struct("ctx", "d", "words", "place")).alias("contexts"))  # at most PAIRWISE, see wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                contexts = batch.column("contexts")[i].as_py()
                anchor = batch.column("anchor")[i].as_py()
                out += [(anchor, contexts[j]["ctx"], a, b) for j, a, b in extend_group(contexts, window)]
            if out:
                yield _batch(list(zip(*out, strict=True)), _SPAN)

    pairwise = groups.mapInArrow(run, _SPAN)
    grown = contexts.where(F.col("words").isNull())
    least = grown.groupBy("anchor", "grown").agg(F.min("d").alias("least"), F.max("d").alias("most")).where("least < most")
    hot = grown.join(least.select("anchor", "grown", "least"), ["anchor", "grown"]).where("d > least")
    return pairwise.unionByName(hot.select("anchor", "ctx", F.col("rel").alias("a"), (F.col("rel") + window).alias("b")))


def repeated_spans(docs: DataFrame, window: int = WINDOW_WORDS, k: int = SEED_WORDS, pairwise: int = PAIRWISE) -> DataFrame:
    """(d, th, a, b): word spans of ``keyed`` documents that also stand in a document with a smaller id."""
    runs = written(A.window_runs(docs, "words", window, k), "substring-runs")
    shared = runs.groupBy("anchor").agg(F.min("d").alias("d0"), F.max("d").alias("d1"),
                                        F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    shared = written(shared.where("d0 < d1").select("anchor", (F.col("c0") != F.col("c1")).alias("many")), "substring-anchors")
    hits = written(runs.join(shared, "anchor"), "substring-hits")
    place = F.min(F.struct("d", "th", "s", "e", "p")).alias("first")
    firsts = written(hits.groupBy("anchor", "ctx", "many").agg(place).select("anchor", "ctx", "many", "first.*"), "substring-contexts")
    groups = firsts.where("many").groupBy("anchor").agg(
        F.count(F.lit(1)).alias("n"), F.min("d").alias("d0"), F.max("d").alias("d1"))
    groups = written(groups.where("d0 < d1").select("anchor", (F.col("n") > pairwise).alias("hot")), "substring-groups")
    wanted = firsts.where("many").join(groups, "anchor").select("anchor", "ctx", "d", "th", "s", "e", "p", "hot")
    contexts = written(context_rows(docs, wanted, window), "substring-words")
    spans = extended(contexts, window)
    occurrence = hits.join(firsts.select("anchor", "ctx", F.col("d").alias("first_d")), ["anchor", "ctx"])
    later = occurrence.where("d > first_d").select("d", "th", F.col("s").alias("a"), (F.col("e") + window).alias("b"))
    own = occurrence.where("d = first_d").join(spans, ["anchor", "ctx"]).select(
        "d", "th", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))
    return later.unionByName(own)


def dedup(docs: DataFrame, window: int = WINDOW_WORDS, k: int = SEED_WORDS, pairwise: int = PAIRWISE) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text of the kept words, joined by a space) for every row of ``docs``."""
    x = A.keyed(docs)
    spans = A.spans_by_document(repeated_spans(x.select("text", "d", "th"), window, k, pairwise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_words, n_removed, kept = [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    words = text.encode().split()
                    n_words.append(len(words))
                    if found:
                        gone = A.covered(len(words), found)
                        words = [w for w, g in zip(words, gone, strict=True) if not g]
                    n_removed.append(n_words[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                    ["doc_id", "n_words", "n_removed", "kept"])

    kind = x.schema["doc_id"].dataType.simpleString()
    joined = x.join(spans, ["d", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")
