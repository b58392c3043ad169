"""Exact substring dedup on bytes by suffix arrays.

Every byte that a string of ``window`` bytes covers which also starts anywhere else, same document included, is removed.

Only windows that share an anchor (see ``anchors``) can be equal, so the corpus is cut into shards of anchors: a shard is the
text of the distinct contexts of its anchors, and contexts of anchors that occur once are left out.  In each shard the suffixes
are sorted by external induced sorting with common-prefix values (``induced_sort``), the queues' blocks going to the
shared folder; neighbours with a common prefix of at least ``window`` bytes are repeats.  A context that occurs more than once
repeats as a whole, however often, and enters its shard once.

An anchor with more than ``HOT`` contexts would crowd a shard: its windows are dealt by their cores instead, the longer part
around the anchor that windows at about the same place share, and equal surroundings of a core are one.  If even a core has more than
``HOT_CORE`` surroundings, its windows are dealt by their whole content and counted with partial aggregation; nothing is left out.

Defined results: null and empty texts have no bytes; texts below the window keep all; matches never cross documents; repeated
rows and copies at least as long as the window lose every byte; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from seqpool.llm import anchors as A
from seqpool.llm import textarrays as T
from seqpool.llm.common import written
from seqpool.llm.induced_sort import MEMORY_ENTRIES, sorted_suffixes
from seqpool.session import shared_scratch

WINDOW_BYTES = 200
SEED_BYTES = 32
HOT = 512  # contexts of one anchor that a shard takes
HOT_CORE = 4096  # surroundings of one core that a shard takes
SHARD_BYTES = 1 << 20  # small shards keep the sort in a core's cache
CORE_STEP = 24

_CONTEXT = "anchor bigint, ctx bigint, bytes binary, cores array<bigint>, core bigint, sub bigint, rel int"
_SPAN = "anchor bigint, ctx bigint, a int, b int"
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def context_rows(docs: DataFrame, wanted: DataFrame, window: int, k: int) -> DataFrame:
    """The wanted contexts with their bytes and cores, or, where ``hot``, a row per core with its surroundings.

    ``wanted``: anchor, ctx, d, th, s, e, p, hot; one row per context.  A core is the part around the anchor that all
    windows have whose anchor stands at about the same place, so contexts with an equal window have an equal core."""
    by_doc = wanted.groupBy("d", "th").agg(F.collect_list(F.struct("anchor", "ctx", "s", "e", "p", "hot")).alias("ctxs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in T.chunks(batch):
                raw = data.tobytes()
                values = T.byte_values()[data]
                lists = part.column("ctxs")
                owner = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                anchor, ctx, s, e, p = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "ctx", "s", "e", "p"))
                hot = flat.field("hot").to_numpy(zero_copy_only=False)
                lo, hi, place = offsets[owner] + s, offsets[owner] + e + window, offsets[owner] + p
                cores: list[list[int]] = [[] for _ in owner]
                rows: list[tuple] = []
                for g in range(0, window - k + 1, CORE_STEP):  # bytes that a window has before its anchor
                    has = np.flatnonzero((p - e <= g + CORE_STEP - 1) & (p - s >= g))
                    start = place[has] - g
                    end = np.minimum(start + window - CORE_STEP + 1, hi[has])
                    core = T.mix(T.span_hashes(values, start, end) ^ T.mix(anchor[has].view(np.uint64) + np.uint64(g))).view(np.int64)
                    first = np.maximum(place[has] - g - CORE_STEP + 1, lo[has])  # of the windows with this core
                    stop = np.minimum(place[has] - g + window, hi[has])
                    sub = T.span_hashes(values, first, stop).view(np.int64)
                    for i, x, y, u, v in zip(has.tolist(), core.tolist(), sub.tolist(), first.tolist(), stop.tolist(), strict=True):
                        if hot[i]:
                            rows.append((anchor[i], ctx[i], raw[u:v], None, x, y, u - lo[i]))
                        else:
                            cores[i].append(x)
                rows += [(anchor[i], ctx[i], raw[lo[i]: hi[i]], cores[i], None, None, None) for i in np.flatnonzero(~hot)]
                if rows:
                    yield _batch(list(zip(*rows, strict=True)), _CONTEXT)

    return docs.join(by_doc, ["d", "th"]).select("text", "ctxs").mapInArrow(run, _CONTEXT)


def with_shared_core(contexts: DataFrame) -> DataFrame:
    """anchor, ctx, bytes of the contexts of which another context has a core; no other can have an equal window."""
    plain = contexts.where(F.col("core").isNull())
    cores = plain.select("anchor", "ctx", F.explode("cores").alias("core"))
    often = cores.groupBy("core").agg(F.min("ctx").alias("a"), F.max("ctx").alias("b")).where("a <> b").select("core")
    found = cores.join(often, "core").select("anchor", "ctx").distinct()
    return plain.select("anchor", "ctx", "bytes").join(found, ["anchor", "ctx"])


def shard_repeats(contexts: list[tuple[int, int, bytes]], window: int, space) -> list[tuple[int, int, int, int]]:
    """(anchor, ctx, a, b): maximal spans of windows that stand more than once in the shard's contexts."""
    if len(contexts) < 2:
        return []
    raw = b"".join(c[2] for c in contexts)
    sizes = np.array([len(c[2]) for c in contexts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    text = np.zeros(int(sizes.sum()) + len(contexts) + 1, dtype=np.uint16)
    text[:-1] = 1  # behind each context
    inside = np.ones(len(text), dtype=bool)
    inside[starts + sizes] = False
    inside[-1] = False
    text[inside] = np.frombuffer(raw, dtype=np.uint8).astype(np.uint16) + 2
    repeated = np.zeros(len(text), dtype=bool)
    last = [None]

    def emit(positions: np.ndarray, prefixes: np.ndarray) -> None:
        hit = prefixes >= window
        repeated[positions[hit]] = True
        repeated[positions[:-1][hit[1:]]] = True
        if len(hit) and hit[0] and last[0] is not None:
            repeated[last[0]] = True
        if len(positions):
            last[0] = int(positions[-1])

    sorted_suffixes(text, 258, window, emit, space)
    at = np.flatnonzero(repeated)
    owner = np.searchsorted(starts, at, side="right") - 1
    rel = at - starts[owner]
    good = rel + window <= sizes[owner]
    owner, rel = owner[good], rel[good]
    first = np.ones(len(rel), dtype=bool)
    first[1:] = (owner[1:] != owner[:-1]) | (rel[1:] != rel[:-1] + 1)
    heads = np.flatnonzero(first)
    tails = np.append(heads[1:], len(rel)) - 1
    return [(contexts[o][0], contexts[o][1], int(a), int(b) + window)
            for o, a, b in zip(owner[heads], rel[heads], rel[tails], strict=True)]


def repeats(contexts: DataFrame, window: int, shard_bytes: int, hot_core: int) -> DataFrame:
    """(anchor, ctx, a, b): the repeated spans of contexts, in bytes from the context's start."""
    folder = shared_scratch(contexts.sparkSession, "suffix-queues")
    subs = contexts.where(F.col("core").isNotNull())
    kinds = written(subs.groupBy("core", "sub").agg(F.count(F.lit(1)).alias("n"), F.first("bytes").alias("bytes")), "suffix-cores")
    many = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    of_core = kinds.join(many, "core").select(F.col("core").alias("anchor"), F.col("sub").alias("ctx"), "bytes", "kinds")
    sorted_cores = of_core.where(F.col("kinds") <= hot_core).select("anchor", "ctx", "bytes")
    plain = written(with_shared_core(contexts).unionByName(sorted_cores), "suffix-shards")
    size = plain.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], bytes] = {}
        for b in batches:
            held |= {(x, y): z for x, y, z in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)}
        if len(held) < 2:
            return
        fs, root = pafs.FileSystem.from_uri(folder)
        found = shard_repeats([(x, y, z) for (x, y), z in held.items()], window, (fs, root, MEMORY_ENTRIES))
        for lo in range(0, len(found), 1 << 16):
            yield _batch(list(zip(*found[lo: lo + (1 << 16)], strict=True)), _SPAN)

    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    sorted_ = plain.repartition(shards, "anchor").mapInArrow(run, _SPAN)
    starts = F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - window)).alias("a")
    grown = of_core.where(F.col("kinds") > hot_core).select("anchor", "ctx", "bytes", starts)
    grown = grown.select("anchor", "ctx", "a", F.substring("bytes", F.col("a") + 1, F.lit(window)).alias("whole"))
    often = grown.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "whole")
    grown = grown.join(often, ["anchor", "whole"]).select("anchor", "ctx", "a", (F.col("a") + window).alias("b"))
    found = written(sorted_.unionByName(grown), "suffix-repeats")
    again = kinds.where("n > 1").select("core", "sub", F.lit(0).alias("a"), F.octet_length("bytes").alias("b"))
    inside = found.select(F.col("anchor").alias("core"), F.col("ctx").alias("sub"), "a", "b").unionByName(again)
    inside = subs.select("anchor", "ctx", "core", "sub", "rel").join(inside, ["core", "sub"])
    return found.unionByName(inside.select("anchor", "ctx", (F.col("rel") + F.col("a")).alias("a"), (F.col("rel") + F.col("b")).alias("b")))


def repeated_spans(docs: DataFrame, window: int = WINDOW_BYTES, k: int = SEED_BYTES, hot: int = HOT,
                   shard_bytes: int = SHARD_BYTES, hot_core: int = HOT_CORE) -> DataFrame:
    """(d, th, a, b): byte spans of ``keyed`` documents whose windows also start elsewhere."""
    runs = written(A.window_runs(docs, "bytes", window, k), "suffix-runs")
    shared = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1"))
    shared = written(shared.where("n > 1").select("anchor", (F.col("c0") != F.col("c1")).alias("many")), "suffix-anchors")
    hits = written(runs.join(shared, "anchor"), "suffix-hits")
    place = F.min(F.struct("d", "th", "s", "e", "p")).alias("first")
    firsts = hits.where("many").groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("n"), place)
    firsts = written(firsts.select("anchor", "ctx", "n", "first.*"), "suffix-contexts")
    groups = written(firsts.groupBy("anchor").agg((F.count(F.lit(1)) > hot).alias("hot")), "suffix-groups")
    wanted = firsts.join(groups, "anchor")
    contexts = written(context_rows(docs, wanted, window, k), "suffix-bytes")
    spans = repeats(contexts, window, shard_bytes, hot_core)
    whole = F.col("s").alias("a"), (F.col("e") + window).alias("b")
    alone = hits.where("NOT many").select("d", "th", *whole)
    again = hits.where("many").join(firsts.where("n > 1").select("anchor", "ctx"), ["anchor", "ctx"]).select("d", "th", *whole)
    once = firsts.where("n = 1").join(spans, ["anchor", "ctx"]).select(
        "d", "th", (F.col("s") + F.col("a")).alias("a"), (F.col("s") + F.col("b")).alias("b"))
    return alone.unionByName(again).unionByName(once)


def dedup(docs: DataFrame, window: int = WINDOW_BYTES, k: int = SEED_BYTES, hot: int = HOT,
          shard_bytes: int = SHARD_BYTES, hot_core: int = HOT_CORE) -> DataFrame:
    """doc_id, n_bytes, n_spans (maximal removed runs), kept (the remaining bytes), kept_text, rest, for every row of ``docs``.

    kept_text leaves out what is left of characters that lost a part; ``rest`` has the other columns of ``docs``."""
    x = A.keyed(docs)
    spans = A.spans_by_document(repeated_spans(x.select("text", "d", "th"), window, k, hot, shard_bytes, hot_core))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n_bytes, n_spans, kept = [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    raw = text.encode()
                    n_bytes.append(len(raw))
                    if found:
                        gone = A.covered(len(raw), found)
                        n_spans.append(int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])))
                        raw = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                    else:
                        n_spans.append(0)
                    kept.append(raw)
                texts = [x.decode("utf-8", "ignore") for x in kept]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("rest"), pa.array(n_bytes, pa.int64()), pa.array(n_spans, pa.int64()),
                     pa.array(kept, pa.binary()), pa.array(texts, pa.string())],
                    ["doc_id", "rest", "n_bytes", "n_spans", "kept", "kept_text"])

    schema = StructType([x.schema["doc_id"], x.schema["rest"], StructField("n_bytes", LongType()), StructField("n_spans", LongType()),
                         StructField("kept", BinaryType()), StructField("kept_text", StringType())])
    return x.join(spans, ["d", "th"], "left").select("doc_id", "rest", "text", "spans").mapInArrow(run, schema)
