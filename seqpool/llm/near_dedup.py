"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star candidates.

A document's set holds the hashes of its distinct word shingles.  One hash function deals the shingles to bins; a
bin's value is its smallest hash, and an empty bin takes the value of a non-empty bin chosen by a hash
of its own (optimal densification).  Bands of bins are bucket keys.  In a bucket every document is paired with the bucket's
hub only (a star), so that a bucket of n gives n - 1 candidates.  Candidates are confirmed on the full
sets.  Documents with equal sets are one node from the start; ids come in at the end.

Buckets that still hold several components after that may hide links that no star saw.  Their members are compared by prefixes:
with the shingles of every set in one order, rarest first, two sets at 0.8 share one among the first n - ceil(0.8 n) + 1 of
either, so common shingles never become keys.  Sizes and places bound what a pair can share before it is made.

Defined results: null texts, and texts without words, have empty sets and are linked with nothing; fewer words than a
shingle are one shingle; rows that share an id are one document, which has the links of each of its texts; a null doc_id is kept
alone, with a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqpool.llm import textarrays as T
from seqpool.llm.common import written
from seqpool.llm.graph import components

SHINGLE_WORDS = 5
SIMILARITY = 80  # hundredths
BANDS, ROWS = 64, 8  # a pair at 0.8 shares no band with a chance of (1 - 0.8**8)**64 < 1e-5
_SEED = np.uint64(0x8CB92BA72F3D8DD7)

_SET = "doc_id bigint, th bigint, n_shingles bigint, set_key bigint, set_key2 bigint, bands array<bigint>"


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk; A-Z count as lower case."""
    hashes, starts = T.word_hashes(T.lower_ascii(data), offsets)
    grams = T.gram_hashes(hashes, k)
    sets = []
    for lo, hi in zip(starts[:-1], starts[1:], strict=True):
        if hi - lo >= k:
            sets.append(np.unique(grams[lo: hi - k + 1]))
        elif hi > lo:
            sets.append(T.span_hashes(hashes[lo:hi], np.array([0]), np.array([hi - lo])))
        else:
            sets.append(np.empty(0, dtype=np.uint64))
    return sets


def signature(values: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash of a non-empty set, with optimal densification."""
    x = T.mix(values ^ _SEED)
    place = ((x >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    order = np.lexsort((x, place))
    first = np.ones(len(x), dtype=bool)
    first[1:] = place[order][1:] != place[order][:-1]
    out = np.zeros(bins, dtype=np.uint64)
    filled = np.zeros(bins, dtype=bool)
    at = place[order][first].astype(np.int64)
    out[at], filled[at] = x[order][first], True
    empty = np.flatnonzero(~filled)
    attempt = 1
    while len(empty):
        donor = (T.mix(empty.astype(np.uint64) * np.uint64(0x10001) + np.uint64(attempt << 20)) % np.uint64(bins)).astype(np.int64)
        found = filled[donor]
        out[empty[found]] = out[donor[found]]
        empty = empty[~found]
        attempt += 1
    return out


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    blocks = signature(values, bands * rows).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = T.mix(key * T.BASE + blocks[:, j])
    return key


def document_sets(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, a digest of the set (two keys) and its band keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in T.chunks(batch):
                sets = shingle_sets(data, offsets, k)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                key = np.array([T.mix(s ^ np.uint64(1)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                key2 = np.array([T.mix(s ^ np.uint64(2)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                keys = [band_keys(s, bands, rows).view(np.int64) if len(s) else np.empty(0, dtype=np.int64) for s in sets]
                flat = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(n), pa.array(key.view(np.int64)), pa.array(key2.view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    [c.split()[0] for c in _SET.split(", ")])

    return docs.select("doc_id", "th", "text").mapInArrow(run, _SET)


def shingle_rows(texts: DataFrame, k: int) -> DataFrame:
    """node, shingle: a row per distinct shingle of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in T.chunks(batch):
                sets = shingle_sets(data, offsets, k)
                nodes = np.repeat(np.asarray(part.column("node")), [len(x) for x in sets])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.concatenate(sets).view(np.int64))], ["node", "shingle"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, shingle bigint")


def compared(texts: DataFrame, pairs: DataFrame, k: int, similarity: int) -> DataFrame:
    """The candidate pairs (u, v) with the size of their full sets' intersection, and whether that links them.

    ``texts`` has one row per node."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                left, right = part.column("left").to_pylist(), part.column("right").to_pylist()
                distinct = {t: i for i, t in enumerate(dict.fromkeys(left + right))}
                raw = [t.encode() for t in distinct]
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                sets = shingle_sets(data, np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), k)
                shared, linked = [], []
                for a, b in zip(left, right, strict=True):
                    x, y = sets[distinct[a]], sets[distinct[b]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    shared.append(both)
                    linked.append(both > 0 and 100 * both >= similarity * (len(x) + len(y) - both))
                yield pa.RecordBatch.from_arrays(
                    [part.column("u"), part.column("v"), pa.array(shared, pa.int64()), pa.array(linked, pa.bool_())],
                    ["u", "v", "both", "linked"])

    hub = texts.select(F.col("node").alias("u"), F.col("text").alias("left"))
    member = texts.select(F.col("node").alias("v"), F.col("text").alias("right"))
    return pairs.join(member, "v").join(hub, "u").select("u", "v", "left", "right").mapInArrow(
        run, "u bigint, v bigint, both bigint, linked boolean")


def star_pairs(shared: DataFrame) -> DataFrame:
    """(u, v), u < v: each bucket's members with its two hubs.

    One hub is the member that meets most others over all its buckets: in a group of near copies one that was changed
    little.  The other is the smallest member."""
    met = written(shared.groupBy("v").agg(F.sum("size").alias("met")), "near-met")
    hubs = shared.join(met, "v").groupBy("key").agg(F.max(F.struct("met", "v")).alias("hub"), F.min("v").alias("least"))
    hubs = written(hubs.select("key", F.array_distinct(F.array("hub.v", "least")).alias("hubs")), "near-hubs")
    pairs = shared.join(hubs, "key").select("v", F.explode("hubs").alias("hub")).where("v <> hub")
    return pairs.select(F.least("hub", "v").alias("u"), F.greatest("hub", "v").alias("v")).distinct()


def _with_roots(nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``nodes`` with the root of the component that the links give so far."""
    return nodes.join(roots.select(F.col("node").alias(node), "root"), node, "left").withColumn("root", F.coalesce("root", node))


def prefix_rows(shared: DataFrame, roots: DataFrame, texts: DataFrame, k: int, similarity: int) -> DataFrame:
    """(shingle, node, n, i): the prefixes of the nodes in buckets that hold several components of ``roots``.

    ``shared``: key, v, n_shingles.  Shingles that no other open node has need no row, but count as places of the order."""
    placed = written(_with_roots(shared.select("key", "v", "n_shingles"), roots, "v"), "near-placed")
    kinds = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a < b").select("key")
    kinds = written(kinds, "near-mixed")  # a join of two plain sides can split a hot key
    nodes = placed.join(kinds, "key").groupBy(F.col("v").alias("node")).agg(F.first("n_shingles").alias("n"))
    nodes = written(nodes, "near-open")
    rows = written(shingle_rows(texts.join(nodes.select("node"), "node", "left_semi"), k), "near-shingles")
    often = written(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "near-often")
    of_node = Window.partitionBy("node")
    x = rows.join(often, "shingle").join(nodes, "node")
    place = F.row_number().over(of_node.orderBy("c", "shingle")) + F.col("n") - F.count(F.lit(1)).over(of_node)
    first = F.col("n") - F.floor((F.col("n") * similarity + 99) / 100) + 1
    return x.withColumn("i", place).where(F.col("i") <= first).select("shingle", "node", "n", "i")


def _may_link(a: str, b: str, similarity: int):
    """Whether two prefix rows of one shingle and of different components may belong to similar sets."""
    x = {c: (F.col(f"{a}.{c}"), F.col(f"{b}.{c}")) for c in ("node", "root", "n", "i")}
    most = 1 + F.least(x["n"][0] - x["i"][0], x["n"][1] - x["i"][1])
    return (x["root"][0] != x["root"][1]) & (100 * most >= similarity * (x["n"][0] + x["n"][1] - most))


def prefix_stars(prefixes: DataFrame, similarity: int) -> DataFrame:
    """(u, v), u < v: the rows of each shingle with its hub, the node whose prefix has it first."""
    hubs = prefixes.groupBy("shingle").agg(F.min(F.struct("i", "node", "n", "root")).alias("h"))
    hubs = written(hubs.select("shingle", "h.*"), "near-prefix-hubs")
    pairs = prefixes.alias("a").join(hubs.alias("b"), F.col("a.shingle") == F.col("b.shingle")).where(_may_link("a", "b", similarity))
    return pairs.select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).distinct()


def prefix_pairs(prefixes: DataFrame, similarity: int) -> DataFrame:
    """(u, v), u < v: all pairs of a shingle that are still of different components and may be similar."""
    a, b = prefixes.alias("a"), prefixes.alias("b")
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.node") < F.col("b.node")) & _may_link("a", "b", similarity))
    return pairs.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, similarity: int = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("th", F.xxhash64("text"))
    sets = written(document_sets(texts, k, bands, rows), "near-sets")
    same = ["set_key", "set_key2", "n_shingles"]
    full = sets.where("n_shingles > 0 AND doc_id IS NOT NULL").withColumn("node", F.xxhash64(*same))
    # equal sets are one node, shown by one of its rows
    nodes = full.groupBy("node", "n_shingles").agg(F.min(F.struct("doc_id", "th", "bands")).alias("x"))
    nodes = written(nodes.select("node", "n_shingles", "x.doc_id", "x.th", "x.bands"), "near-nodes")
    banded = nodes.select("node", "n_shingles", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = written(banded.join(sizes, "key").select("key", F.col("node").alias("v"), "n_shingles", "size"), "near-buckets")
    stars = written(star_pairs(shared), "near-stars")
    # the texts of bucket members, one per node: all that the later steps read of the documents
    shown = nodes.select("node", "doc_id", "th").join(shared.select(F.col("v").alias("node")).distinct(), "node", "left_semi")
    texts = texts.join(shown, ["doc_id", "th"]).groupBy("node").agg(F.max("text").alias("text"))
    texts = written(texts, "near-texts")
    stars = written(compared(texts, stars, k, similarity), "near-stars")
    roots = components(stars.where("linked").select("u", "v"))
    judged = stars.select("u", "v")
    prefixes = written(prefix_rows(shared, roots, texts, k, similarity), "near-prefixes")
    for candidates in (prefix_stars, prefix_pairs):
        rows_now = written(_with_roots(prefixes, roots, "node"), "near-rooted")
        new = candidates(rows_now, similarity).join(judged, ["u", "v"], "left_anti")
        new = written(compared(texts, written(new, "near-across"), k, similarity), "near-across")
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new.where("linked").select("u", "v")))
        judged = judged.unionByName(new.select("u", "v"))
    named = document_components(full.select("doc_id", "node"), roots)
    out = sets.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def document_components(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, component_id): the smallest id reachable through components of nodes, and through ids that several nodes share."""
    x = members.distinct().join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root")).distinct()
    x = written(x, "near-members")
    of_id = written(x.groupBy("doc_id").agg(F.min("root").alias("u"), F.max("root").alias("w")).where("u < w"), "near-shared-ids")
    again = components(x.join(of_id, "doc_id").where("root <> u").select("u", F.col("root").alias("v")))
    x = x.join(again.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    x = written(x.select("doc_id", F.coalesce("top", "root").alias("root")).distinct(), "near-roots")
    least = written(x.groupBy("root").agg(F.min("doc_id").alias("component_id")), "near-least")
    return x.join(least, "root").select("doc_id", "component_id")
