"""Phrase collocations, counted exactly with counting quotient filters.

1. Every task cuts its texts into chunks of about ``CHUNK_BYTES``: a sequence of chunk-local word numbers (0 between
   pieces) and the chunk's dictionary with counts, ordered by hash.  Only dictionaries are shuffled to count words, each in
   pieces by the leading bits of the hash.  Words below ``min_count`` cannot be part of a candidate; the others get dense
   ids, which go back to the chunks that hold them.
2. Two-word phrases: each chunk packs its pairs of ids, permutes them and sends one filter per shard (the leading bits
   of the permuted key); a shard merges its sorted filters and sends back to each chunk which of its pairs are frequent.
3. Longer phrases the same way, at places where every pair is frequent: all others are below ``min_count`` too, so nothing is lost.
4. Scores, the test for longer phrases and the ranks are joins over the frequent phrases.  A longer candidate that
   covers a phrase has a part one word longer than the phrase that does so too, so only that step is joined.

A key is at most once in a filter, a filter at most once per chunk and shard, and permuted keys are even: a very
frequent phrase or word is no hot key.  The number of shards follows the number of words, so that a shard's filters fit a task.

Defined results: null and empty texts have no words; a null language is ``und``, counted together with rows that say
``und``; repeated rows and ids count each time; ties end with the phrase in UTF-8 byte order; an empty table gives no rows; other columns
are not read.  A word of any length is one word; texts are worked on in slices, whatever their length.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpool.llm import quotient_filter as Q
from seqpool.llm import textarrays as T
from seqpool.llm.common import written

MIN_COUNT, MAX_WORDS, TOP, COVERED_PERCENT = 100, 5, 2000, 100
CHUNK_BYTES = 8 << 20
SLICE_BYTES = 1 << 20
SHARD_BYTES = 64 << 20  # of filters, by a bound from the number of words
SHARD_WORDS = 1 << 20  # dictionary entries of all chunks that meet in a task

# Bytes of the pieces' ends become a line feed, the tab a space, A-Z small letters; UTF-8 bytes of other signs stay.
_FOLD = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK_SCHEMA = "chunk bigint, body binary, entries array<struct<h:bigint,lang:string,word:string,n:bigint,local:int>>, n_entries bigint"


def _pressed(ids: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, compressed: the upper planes are nearly empty."""
    planes = np.ascontiguousarray(ids, dtype="<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _opened(body: bytes) -> np.ndarray:
    size = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], decompressed_size=size, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _slices(data: bytes) -> Iterator[bytes]:
    """``data`` cut behind spaces or line feeds, in parts of about ``SLICE_BYTES``."""
    at = 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data):
            stops = [x for x in (data.find(b" ", end), data.find(b"\n", end)) if x >= 0]
            end = min(stops) + 1 if stops else len(data)
        yield data[at:end]
        at = end


class _Chunk:
    """Word numbers of texts: the number of a (language, word) is its first place among the chunk's distinct ones."""

    def __init__(self):
        self.next = itertools.count(1).__next__
        self.numbers: dict[str, defaultdict] = {}
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, lang: str, text: str | None) -> None:
        if lang not in self.numbers:
            self.numbers[lang] = defaultdict(self.next, {b"": -1, b"\n": 0})
        number = self.numbers[lang].__getitem__
        data = (text or "").encode().translate(_FOLD)
        for part in _slices(data):
            words = part.replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(number, words), dtype=np.int32, count=len(words))
            self.parts.append(ids[ids >= 0])
        self.parts.append(np.zeros(1, dtype=np.int32))
        self.size += len(data) + 1

    def row(self, chunk: int) -> pa.RecordBatch:
        ids = np.concatenate(self.parts)
        ids = ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))]  # one 0 between pieces
        entries = [(k, lang, word) for lang, own in self.numbers.items() for word, k in own.items() if k > 0]
        counts = np.bincount(ids, minlength=len(entries) + 1)
        local = np.array([x[0] for x in entries], dtype=np.int64)
        ends = np.cumsum([len(x[2]) for x in entries], dtype=np.int64)
        data = np.frombuffer(b"".join(x[2] for x in entries), dtype=np.uint8)
        seeds = {lang: zlib.crc32(lang.encode()) for lang in self.numbers}
        hashes = T.span_hashes(T.byte_values()[data], np.append(0, ends)[:-1], ends) if entries else np.empty(0, np.uint64)
        hashes = T.mix(hashes + np.array([seeds[x[1]] for x in entries], dtype=np.uint64)) >> np.uint64(1)
        order = np.argsort(hashes)
        values = pa.StructArray.from_arrays(
            [pa.array(hashes[order].astype(np.int64)), pa.array([entries[i][1] for i in order], pa.string()),
             pa.array([entries[i][2].decode() for i in order], pa.string()), pa.array(counts[local[order]], pa.int64()),
             pa.array(local[order], pa.int32())], names=["h", "lang", "word", "n", "local"])
        lists = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [pa.array([chunk], pa.int64()), pa.array([_pressed(ids)], pa.binary()), lists, pa.array([len(entries)], pa.int64())],
            names=["chunk", "body", "entries", "n_entries"])


def chunk_table(docs: DataFrame) -> DataFrame:
    """chunk, body (its word numbers), entries (hash, language, word, count and number of its words), n_entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, held, now = TaskContext.get().partitionId() << 32, 0, _Chunk()
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                now.add(lang.as_py(), text.as_py())
                if now.size >= CHUNK_BYTES:
                    yield now.row(base + held)
                    held, now = held + 1, _Chunk()
        if now.size:
            yield now.row(base + held)

    x = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return x.mapInArrow(run, _CHUNK_SCHEMA)


_PIECE_SCHEMA = "shard bigint, chunk bigint, entries array<struct<lang:string,word:string,n:bigint,local:int>>"


def _dealt_entries(shard_bits: int):
    """A chunk's dictionary in pieces: a row per shard, which is the leading bits of the words' hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, entries in zip(batch.column("chunk"), batch.column("entries"), strict=True):
                shards = np.asarray(entries.values.field("h")) >> (63 - shard_bits)
                if not len(shards):
                    continue
                starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
                own = pa.StructArray.from_arrays([entries.values.field(c) for c in ("lang", "word", "n", "local")],
                                                 names=["lang", "word", "n", "local"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(shards)), pa.int32()), own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards[starts]), pa.array([chunk.as_py()] * len(starts), pa.int64()), lists], names=["shard", "chunk", "entries"])

    return run


_WORD_SCHEMA = "lang string, word string, n bigint, id bigint, chunk bigint, local binary, ids binary"


def _merge_words(shard_bits: int, min_count: int):
    """A shard's dictionaries -> frequent words with ids (id set), sums per language (lang only), and per chunk its words' ids."""
    def run(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        entries = group["entries"].combine_chunks()
        flat = entries.flatten()
        lang, word = (flat.field(c).dictionary_encode() for c in ("lang", "word"))
        code = np.asarray(lang.indices).astype(np.int64) * len(word.dictionary) + np.asarray(word.indices)
        distinct, place = np.unique(code, return_inverse=True)
        counts = np.zeros(len(distinct), dtype=np.int64)
        np.add.at(counts, place, np.asarray(flat.field("n")))
        of_lang, of_word = np.divmod(distinct, len(word.dictionary))
        sums = np.zeros(len(lang.dictionary), dtype=np.int64)
        np.add.at(sums, of_lang, counts)
        often = np.flatnonzero(counts >= min_count)
        ids = np.zeros(len(distinct), dtype=np.int64)
        ids[often] = (np.arange(len(often)) << shard_bits) + shard + 1

        sizes = np.asarray(entries.value_lengths())
        local, found = np.asarray(flat.field("local")), ids[place]
        back, at = [], 0
        for chunk, size in zip(group["chunk"].to_pylist(), sizes, strict=True):
            held = np.flatnonzero(found[at: at + size]) + at
            if len(held):
                back.append((chunk, _pressed(local[held]), _pressed(found[held].astype(np.uint32).view(np.int32))))
            at += size
        m, k = len(often), len(sums)
        empty = [None] * (m + k)
        return pa.table({
            "lang": pa.concat_arrays([lang.dictionary.take(pa.array(of_lang[often])), lang.dictionary, pa.nulls(len(back), pa.string())]),
            "word": pa.concat_arrays([word.dictionary.take(pa.array(of_word[often])), pa.nulls(k + len(back), pa.string())]),
            "n": pa.array([*counts[often], *sums, *[None] * len(back)], pa.int64()),
            "id": pa.array([*ids[often], *[None] * (k + len(back))], pa.int64()),
            "chunk": pa.array([*empty, *(x[0] for x in back)], pa.int64()),
            "local": pa.array([*empty, *(x[1] for x in back)], pa.binary()),
            "ids": pa.array([*empty, *(x[2] for x in back)], pa.binary())})

    return run


def _relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunk bodies in ids of the frequent words; -1 for other words."""
    for batch in batches:
        for chunk, body, known in zip(*(batch.column(c) for c in ("chunk", "body", "known")), strict=True):
            local = _opened(body.as_py())
            table = np.full(int(local.max(initial=0)) + 1, -1, dtype=np.int32)
            table[0] = 0
            for piece in known.as_py() or []:
                table[_opened(piece["local"])] = _opened(piece["ids"])
            yield pa.RecordBatch.from_arrays([pa.array([chunk.as_py()], pa.int64()), pa.array([_pressed(table[local])], pa.binary())],
                                             names=["chunk", "body"])


def frequent_words(chunks: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words with id, totals per language, chunks in those ids), the last a written table."""
    n_entries = chunks.agg(F.sum("n_entries").alias("n")).first()["n"] or 0
    shard_bits = max(0, (n_entries // SHARD_WORDS).bit_length())
    pieces = chunks.select("chunk", "entries").mapInArrow(_dealt_entries(shard_bits), _PIECE_SCHEMA)
    merged = written(pieces.groupBy("shard").applyInArrow(_merge_words(shard_bits, min_count), _WORD_SCHEMA), "phrase-words")
    words = merged.where("id IS NOT NULL").select("lang", "word", "n", "id")
    totals = merged.where("id IS NULL AND chunk IS NULL").groupBy("lang").agg(F.sum("n").alias("total"))
    known = merged.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("local", "ids")).alias("known"))
    bodies = chunks.select("chunk", "body").join(known, "chunk", "left").select("chunk", "body", "known")
    return words, totals, written(bodies.mapInArrow(_relabel, "chunk bigint, body binary"), "phrase-chunks")


def _filters(lengths: Sequence[int], bits: int, shard_bits: int):
    """Rows (n, shard, chunk, filter) of a chunk's phrases; with a column ``pairs`` only where every pair is frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = batch.column("body")
            pairs = batch.column("pairs") if "pairs" in batch.schema.names else None
            for i, chunk in enumerate(batch.column("chunk").to_pylist()):
                ids = _opened(bodies[i].as_py())
                good = (ids[:-1] > 0) & (ids[1:] > 0)  # a pair starts here
                if pairs is not None:
                    good = _frequent_pairs(ids, good, pairs[i].as_py() or [], bits, shard_bits)
                for n in lengths:
                    fits = good[: max(0, len(ids) - n + 1)].copy()
                    for j in range(1, n - 1):
                        fits &= good[j: j + len(fits)]
                    at = np.flatnonzero(fits)
                    if len(at):
                        kind = Q.Keys(n, bits)
                        keys, counts = Q.count_keys(kind.permute([ids[at + j] for j in range(n)]))
                        yield _rows(kind, keys, counts, chunk, shard_bits)

    return run


def _frequent_pairs(ids: np.ndarray, good: np.ndarray, pairs: list[dict], bits: int, shard_bits: int) -> np.ndarray:
    kind = Q.Keys(2, bits)
    known = [Q.decode(kind, p["filter"], p["shard"], shard_bits)[0] for p in sorted(pairs, key=lambda p: p["shard"])]
    out = np.zeros_like(good)
    if known:
        at = np.flatnonzero(good)
        out[at] = Q.member(kind.permute([ids[at], ids[at + 1]]), [np.concatenate(x) for x in zip(*known, strict=True)])
    return out


def _rows(kind: Q.Keys, keys: list[np.ndarray], counts: np.ndarray, chunk: int | None, shard_bits: int) -> pa.RecordBatch:
    """A row per shard that has keys."""
    shards = kind.shard(keys, shard_bits)
    starts = np.flatnonzero(np.append(True, shards[1:] != shards[:-1]))
    ends = np.append(starts[1:], len(shards))
    blobs = [Q.encode(kind, [x[a:b] for x in keys], counts[a:b], shard_bits) for a, b in zip(starts, ends, strict=True)]
    m = len(blobs)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind.n] * m, pa.int32()), pa.array(shards[starts], pa.int64()), pa.array([chunk] * m, pa.int64()),
         pa.array(blobs, pa.binary())], names=["n", "shard", "chunk", "filter"])


_FILTER_SCHEMA = "n int, shard bigint, chunk bigint, filter binary"


def _merge(bits: int, shard_bits: int, min_count: int, send_back: bool):
    """A shard's filters -> the filter of its frequent phrases (chunk null), and each chunk's frequent phrases if wanted."""
    def run(group: pa.Table) -> pa.Table:
        n, shard = group["n"][0].as_py(), group["shard"][0].as_py()
        kind = Q.Keys(n, bits)
        parts = [Q.decode(kind, x.as_py(), shard, shard_bits) for x in group["filter"]]
        keys, counts, place = Q.merge(parts)
        often = counts >= min_count
        out = []
        if often.any():
            out.append(_rows(kind, [x[often] for x in keys], counts[often], None, shard_bits))
            if send_back:
                at = 0
                for chunk, (own, own_counts) in zip(group["chunk"].to_pylist(), parts, strict=True):
                    kept = often[place[at: at + len(own_counts)]]
                    at += len(own_counts)
                    if kept.any():
                        out.append(_rows(kind, [x[kept] for x in own], own_counts[kept], chunk, shard_bits))
        schema = pa.schema([("n", pa.int32()), ("shard", pa.int64()), ("chunk", pa.int64()), ("filter", pa.binary())])
        return pa.Table.from_batches(out, schema=schema)

    return run


def _unpacked(bits: int, shard_bits: int):
    """Filters -> (ids, a): the word ids and count of every phrase."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, shard, raw in zip(*(batch.column(c).to_pylist() for c in ("n", "shard", "filter")), strict=True):
                kind = Q.Keys(n, bits)
                keys, counts = Q.decode(kind, raw, shard, shard_bits)
                ids = np.stack(kind.restore(keys), axis=1).astype(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * n, pa.int32()), pa.array(ids.ravel()))
                yield pa.RecordBatch.from_arrays([lists, pa.array(counts, pa.int64())], names=["ids", "a"])

    return run


def frequent_phrases(chunks: DataFrame, bits: int, n_words: int, min_count: int, max_words: int) -> DataFrame:
    """ids, a: the phrases of 2 to ``max_words`` words that occur ``min_count`` times or more."""
    per_key = -(-2 * bits // 8) + 1
    shard_bits = max(0, (n_words * per_key // SHARD_BYTES).bit_length())

    def counted(x: DataFrame, lengths: Sequence[int], send_back: bool) -> DataFrame:
        filters = x.mapInArrow(_filters(lengths, bits, shard_bits), _FILTER_SCHEMA)
        merged = filters.groupBy("n", "shard").applyInArrow(_merge(bits, shard_bits, min_count, send_back), _FILTER_SCHEMA)
        return written(merged, f"phrase-filters-{lengths[0]}")

    found = counted(chunks, [2], max_words > 2)
    frequent = found.where("chunk IS NULL")
    if max_words > 2:
        back = found.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("shard", "filter")).alias("pairs"))
        rest = counted(chunks.join(back, "chunk").select("chunk", "body", "pairs"), list(range(3, max_words + 1)), False)
        frequent = frequent.unionByName(rest)
    return frequent.select("n", "shard", "filter").mapInArrow(_unpacked(bits, shard_bits), "ids array<bigint>, a bigint")


def _exact_score(a: Column, n: Column, left: Column, right: Column) -> Column:
    """floor(1000 a n / (l r)); products in 38 digits."""
    wide = [x.cast("decimal(19,0)") for x in (a * F.lit(1000), n, left, right)]
    return F.call_function("div", wide[0] * wide[1], wide[2] * wide[3])


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
         covered_percent: int = COVERED_PERCENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of ``docs`` (text, lang)."""
    chunks = written(chunk_table(docs), "phrase-texts")
    words, totals, bodies = frequent_words(chunks, min_count)
    totals = written(totals, "phrase-totals")
    size = words.agg(F.max("id").alias("id")).first()["id"] or 1
    if size >= 1 << 31:
        raise ValueError("chunks hold word ids in 31 bits: raise min_count")
    n_words = totals.agg(F.sum("total").alias("n")).first()["n"] or 0
    phrases = written(frequent_phrases(bodies, int(size).bit_length(), n_words, min_count, max_words), "phrase-counts")

    counts = phrases.unionByName(words.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    lang_of = words.select(F.col("id").alias("first_id"), "lang").join(totals, "lang")
    x = phrases.join(lang_of, F.get("ids", F.lit(0)) == F.col("first_id")).drop("first_id")

    longer = phrases.where(F.size("ids") > 2)
    m = F.size("ids") - 1
    parts = F.explode(F.array(F.slice("ids", F.lit(1), m), F.slice("ids", F.lit(2), m)))
    cover = longer.select(parts.alias("ids"), F.col("a").alias("longer")).groupBy("ids").agg(F.max("longer").alias("longer"))
    x = x.join(written(cover, "phrase-cover"), "ids", "left")
    x = x.where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))

    cuts = x.select("ids", "lang", "total", "a", F.explode(F.sequence(F.lit(1), m)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, m))
    cuts = cuts.join(counts.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    cuts = cuts.withColumn("score", _exact_score(F.col("a"), F.col("total"), F.col("l"), F.col("r")))
    scored = cuts.groupBy("lang", "ids").agg(F.min(F.struct("score", "k", "l", "r", "a", F.col("total").alias("n"))).alias("s"))
    scored = scored.select("lang", "ids", "s.score", "s.l", "s.r", "s.a", "s.n")

    by_score = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc())
    best = written(scored.withColumn("place", F.rank().over(by_score)).where(F.col("place") <= top).drop("place"), "phrase-best")
    spelled = best.select("ids", F.posexplode("ids").alias("place", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("w"))
    spelled = spelled.select("ids", F.concat_ws(" ", F.col("w.word")).alias("phrase"))
    by_all = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = best.join(spelled, "ids").withColumn("rank", F.row_number().over(by_all).cast("bigint")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
