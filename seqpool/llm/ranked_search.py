"""Ranked lexical search by dual trees: the best documents of every item, exactly.

Items and documents are sparse vectors over the items' terms: an item's coordinate is a term's weight times its
occurrences, a document's the saturated term frequency; a score is their product sum, all in integers.

1. One pass over the texts keeps, per document, its length and the frequencies of the items' terms; sums over that table give the number
   of documents, their length and the document frequencies.
2. Documents, ordered by their leading terms, form units of at most ``UNIT_DOCS`` within a task; a unit has a
   hierarchy of ``FANOUT`` children a node whose nodes hold the maximum of each coordinate.  Items have one too.
3. A first search descends for each item to the unit's most promising node and scores its documents; the k-th best of all
   those scores is a lower bound of the item's k-th score.
4. The second search walks node pairs from both roots.  The bound of a pair is the product sum of the two nodes' maxima; it is
   dropped if it lies below the weakest k-th score among the node's items, for all documents and items beneath at once.
   Where a pair reaches one item and documents, scores are exact, and the item's k-th score rises.
5. Each unit's best k of an item meet in a window with a limit per task.

Items are taken in batches of at most ``BATCH_BYTES`` of text (or one item), cut along a running sum, so what a task gets of them is
bounded; every batch is searched in all documents.

Defined results: null and empty texts have no terms and are never found; items without terms find nothing; rows that
agree in item_id and text are one item, other rows of one item_id are ranked each for itself; repeated documents
are found each for itself; equal scores by ascending doc_id, rows without an id first; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqpool.llm.common import written
from seqpool.plans.prefix import running_sums

TOP = 20
BATCH_BYTES = 4 << 20
FANOUT = 16
UNIT_DOCS = 8192
UNIT_TERMS = 1 << 21  # (document, term) pairs of a unit

# Bytes of terms: digits, letters (A-Z made small) and all bytes of other signs; the rest is a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def doc_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return 75 + (25 * n * n_docs) // max(1, n_terms)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * norm)


# --------------------------------------------------------------------------------------- documents and items

SLICE_BYTES = 1 << 22


def _counted(text: str | None, number: dict[bytes, int]) -> tuple[int, dict[int, int]]:
    """Number of terms, and occurrences of the known ones; a long text is taken in slices that end before a separator."""
    data = (text or "").encode().translate(_FOLD)
    n, found, at = 0, Counter(), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES) if at + SLICE_BYTES < len(data) else -1
        terms = data[at: end if end >= 0 else len(data)].split()
        n += len(terms)
        found.update(x for x in map(number.get, terms) if x is not None)
        at = end if end >= 0 else len(data)
    return n, found


def doc_vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats), terms and tfs (of the vocabulary's numbers, ascending) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary)}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows = [_counted(x.as_py(), number) for x in part.column("text")]
                found = [sorted(own.items()) for _, own in rows]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for n, _ in rows], pa.int64()),
                     pa.array([np.array([t for t, _ in x], dtype="<i4").tobytes() for x in found], pa.binary()),
                     pa.array([np.array([c for _, c in x], dtype="<i8").tobytes() for x in found], pa.binary())],
                    names=["doc_id", "n", "terms", "tfs"])

    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return x.mapInArrow(run, "doc_id bigint, n bigint, terms binary, tfs binary")


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each of the vocabulary's terms; a task sends its sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, dtype=np.int64)
        for batch in batches:
            seen += np.bincount(np.frombuffer(b"".join(batch.column("terms").to_pylist()), "<i4"), minlength=size)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(seen[used], pa.int64())], names=["t", "n"])

    rows = vectors.select("terms").mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, dtype=np.int64)
    for r in rows:
        out[r["t"]] = r["n"]
    return out


def item_batches(items: DataFrame) -> Iterator[list[tuple]]:
    """Distinct (item_id, text) in lists of at most ``BATCH_BYTES`` of text, or a single item."""
    x = items.select("item_id", "text").distinct().where(F.length("text") > 0)
    x = written(x.withColumn("bytes", F.octet_length("text").cast("bigint")).withColumn("h", F.xxhash64("item_id", "text")), "search-items")
    total = x.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    if total <= BATCH_BYTES:
        yield [tuple(r) for r in x.select("item_id", "text").collect()]
        return
    sums = running_sums(x.select("h", "item_id", "bytes"), "h", ["bytes"], descending=False, tiebreak=["item_id"])
    batch = F.floor((F.col("cum_bytes") - 1) / F.lit(BATCH_BYTES))
    dealt = written(sums.select("h", "item_id", batch.alias("batch")), "search-batches")
    same = (dealt["h"] == x["h"]) & dealt["item_id"].eqNullSafe(x["item_id"])
    dealt = written(x.join(dealt, same).select("batch", x["item_id"], "text"), "search-dealt")
    for i in range(-(-total // BATCH_BYTES)):
        rows = dealt.where(F.col("batch") == i).select("item_id", "text").collect()
        if rows:
            yield [tuple(r) for r in rows]


# --------------------------------------------------------------------------------------- trees


class ItemTree:
    """Items in the order of their heaviest terms; a node is (terms, maxima, first item, end item, children)."""

    def __init__(self, queries: list[tuple[np.ndarray, np.ndarray]]):
        heavy = [tuple(t[np.argsort(-w, kind="stable")][:3].tolist()) for t, w in queries]
        self.order = sorted(range(len(queries)), key=lambda i: heavy[i])
        level = [(queries[i][0], queries[i][1], at, at + 1, []) for at, i in enumerate(self.order)]
        while len(level) > 1:
            level = [self._above(level[i: i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.root = level[0] if level else None

    @staticmethod
    def _above(nodes: list[tuple]) -> tuple:
        terms, values = np.concatenate([x[0] for x in nodes]), np.concatenate([x[1] for x in nodes])
        order = np.lexsort((-values, terms))
        terms, values = terms[order], values[order]
        first = np.append(True, terms[1:] != terms[:-1])
        return terms[first], values[first], nodes[0][2], nodes[-1][3], nodes


class DocTree:
    """A unit of documents: per level the maxima of every node, sorted by (term, node).  Level 0 are the documents."""

    def __init__(self, doc_ids: np.ndarray, missing: np.ndarray, rows: np.ndarray, terms: np.ndarray, values: np.ndarray,
                 weights: np.ndarray):
        n = len(doc_ids)
        order = self._by_leading_terms(n, rows, terms, values * weights[terms])
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        self.doc_ids, self.missing = doc_ids[order], missing[order]
        self.sizes, self.keys, self.values = [n], [], []
        keys = terms.astype(np.int64) * n + place[rows]
        at = np.argsort(keys)
        self.keys.append(keys[at])
        self.values.append(values[at])
        while self.sizes[-1] > 1:
            below, size = self.sizes[-1], -(-self.sizes[-1] // FANOUT)
            term, node = np.divmod(self.keys[-1], below)
            keys = term * size + node // FANOUT  # ascending, as the children's are
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
            self.keys.append(keys[first])
            self.values.append(np.maximum.reduceat(self.values[-1], first) if len(first) else self.values[-1])
            self.sizes.append(size)

    @staticmethod
    def _by_leading_terms(n: int, rows: np.ndarray, terms: np.ndarray, gain: np.ndarray) -> np.ndarray:
        """Documents ordered by their two terms of largest gain, so that neighbours are alike."""
        lead = np.full((n, 2), -1, dtype=np.int64)
        order = np.lexsort((terms, -gain, rows))
        r, t = rows[order], terms[order]
        start = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, np.int64)
        rank = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
        for k in (0, 1):
            lead[r[rank == k], k] = t[rank == k]
        return np.lexsort((lead[:, 1], lead[:, 0]))

    def sums(self, level: int, terms: np.ndarray, weights: np.ndarray, parents: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Product sums of (terms, weights) with the nodes of ``level`` below ``parents`` (null: all): nodes and sums above 0."""
        size, keys, values = self.sizes[level], self.keys[level], self.values[level]
        if parents is not None and len(terms) * len(parents) > len(keys):  # more ranges than entries: look at each entry
            dense = np.zeros(int(terms.max()) + 1, dtype=np.int64)
            dense[terms] = weights
            below = np.zeros(-(-size // FANOUT), dtype=bool)
            below[parents] = True
            term, node = np.divmod(keys[: np.searchsorted(keys, len(dense) * size)], size)
            at = np.flatnonzero((dense[term] > 0) & below[node // FANOUT])
            each = dense[term[at]]
        else:
            base = terms.astype(np.int64)[:, None] * size
            if parents is None:
                starts, ends, each = base.ravel(), base.ravel() + size, weights
            else:
                starts, ends = (base + parents * FANOUT).ravel(), (base + np.minimum((parents + 1) * FANOUT, size)).ravel()
                each = np.repeat(weights, len(parents))
            lo, hi = np.searchsorted(keys, starts), np.searchsorted(keys, ends)
            width = hi - lo
            at = np.repeat(lo - (np.cumsum(width) - width), width) + np.arange(int(width.sum()))
            each = np.repeat(each, width)
        out = np.zeros(size, dtype=np.int64)
        np.add.at(out, keys[at] % size, values[at] * each)
        nodes = np.flatnonzero(out)
        return nodes, out[nodes]


class Best:
    """An item's best documents so far, and the score that a further one must reach."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.scores, self.ids, self.missing = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        fits = scores >= self.least
        s, i, m = (np.concatenate(x) for x in ((self.scores, scores[fits]), (self.ids, ids[fits]), (self.missing, missing[fits])))
        order = np.lexsort((i, ~m, -s))[: self.k]
        self.scores, self.ids, self.missing = s[order], i[order], m[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.scores[-1]))


def first_look(items: ItemTree, docs: DocTree, best: list[Best]) -> None:
    """For each item the documents below the unit's most promising node above them."""
    for at, i in enumerate(items.order):
        terms, weights = _leaf(items, at)
        parents = None
        for level in range(len(docs.sizes) - 1, 0, -1):
            nodes, sums = docs.sums(level, terms, weights, parents)
            if not len(nodes):
                break
            parents = nodes[[int(sums.argmax())]]
        else:
            nodes, sums = docs.sums(0, terms, weights, parents)
            best[i].add(sums, docs.doc_ids[nodes], docs.missing[nodes])


def _leaf(items: ItemTree, at: int) -> tuple[np.ndarray, np.ndarray]:
    node = items.root
    while node[4]:
        node = next(c for c in node[4] if c[2] <= at < c[3])
    return node[0], node[1]


def search(items: ItemTree, docs: DocTree, best: list[Best]) -> int:
    """Walk the pairs of nodes; returns the number of pairs whose bound was taken."""
    taken = 0
    stack = [(items.root, len(docs.sizes) - 1, None)] if items.root else []
    while stack:
        node, level, parents = stack.pop()
        terms, weights, first, end, children = node
        nodes, bounds = docs.sums(level, terms, weights, parents)
        taken += len(nodes)
        if level == 0 and not children:
            best[items.order[first]].add(bounds, docs.doc_ids[nodes], docs.missing[nodes])
            continue
        weakest = min(best[items.order[i]].least for i in range(first, end))
        nodes = nodes[bounds >= weakest]
        if not len(nodes):
            continue
        if level == 0:  # single documents, several items: look at the items apart, among these documents' parents
            up = np.unique(nodes // FANOUT) if len(docs.sizes) > 1 else None
            stack += [(c, 0, up) for c in children]
        else:
            stack += [(c, level - 1, nodes) for c in children or [node]]
    return taken


def _searcher(queries: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int,
              least: list[int], whole: bool):
    """Vectors -> (slot, doc_id, score): each unit's best k documents of the items (of the first look only, or of all)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = ItemTree(queries)
        for rows in _units(batches):
            doc_ids = np.array([d or 0 for d, *_ in rows], dtype=np.int64)
            missing = np.array([d is None for d, *_ in rows])
            terms = [np.frombuffer(t, "<i4") for _, _, t, _ in rows]
            tfs = np.frombuffer(b"".join(c for *_, c in rows), "<i8")
            row = np.repeat(np.arange(len(rows)), [len(t) for t in terms])
            norm = doc_norm(np.array([n for _, n, *_ in rows], dtype=np.int64), n_docs, n_terms)
            docs = DocTree(doc_ids, missing, row, np.concatenate(terms), impact(tfs, norm[row]), weights)
            best = [Best(k, x) for x in least]
            (search if whole else first_look)(tree, docs, best)
            kept = [(slot, b) for slot, b in enumerate(best) if len(b.ids)]
            if kept:
                slots = np.repeat([s for s, _ in kept], [len(b.ids) for _, b in kept])
                ids = pa.array(np.concatenate([b.ids for _, b in kept]), pa.int64(), mask=np.concatenate([b.missing for _, b in kept]))
                yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), ids, pa.array(np.concatenate([b.scores for _, b in kept]), pa.int64())],
                                                 names=["slot", "doc_id", "score"])

    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows that hold terms, in lists bounded by documents and terms."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs")), strict=True):
            if row[2]:
                held.append(row)
                size += len(row[2]) // 4
                if len(held) >= UNIT_DOCS or size >= UNIT_TERMS:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _query_vectors(batch: list[tuple]) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """The batch's vocabulary, and per item its term numbers and their occurrences."""
    counted = [Counter(terms_of(text)) for _, text in batch]
    vocabulary = sorted(set().union(*counted))
    number = {t: i for i, t in enumerate(vocabulary)}
    out = []
    for own in counted:
        pairs = sorted((number[t], c) for t, c in own.items())
        out.append((np.array([t for t, _ in pairs], dtype=np.int64), np.array([c for _, c in pairs], dtype=np.int64)))
    return vocabulary, out


def _search_batch(docs: DataFrame, batch: list[tuple], k: int) -> DataFrame:
    """slot, doc_id, score, rank of a batch's items."""
    spark = docs.sparkSession
    vocabulary, occurrences = _query_vectors(batch)
    vectors = written(doc_vectors(docs, vocabulary), "search-vectors")
    s = vectors.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = s["docs"], s["terms"] or 0
    weights = np.array([term_weight(n_docs, int(df)) for df in document_frequencies(vectors, len(vocabulary))], dtype=np.int64)
    queries = [(t[weights[t] > 0], c[weights[t] > 0] * weights[t][weights[t] > 0]) for t, c in occurrences]

    by_score = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())

    def found(least: list[int], whole: bool) -> DataFrame:
        rows = vectors.mapInArrow(_searcher(queries, weights, n_docs, n_terms, k, least, whole), "slot bigint, doc_id bigint, score bigint")
        return rows.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)

    least = [1] * len(batch)
    for r in found(least, False).where(F.col("rank") == k).select("slot", "score").collect():  # at most a row per item
        least[r["slot"]] = r["score"]
    slots = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(batch)], "slot bigint, item_id bigint")
    return found(least, True).join(slots, "slot").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    out = None
    for batch in item_batches(items):
        if batch:
            rows = written(_search_batch(docs, batch, k), "search-found")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return out
