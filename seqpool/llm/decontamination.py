"""Benchmark decontamination by template canonicalisation.

Numbers, names (capitalised words) and units (after a number) become typed placeholders, other words
are lower-cased.  Windows of five words are joined on their hash between documents and benchmark items, in two families: literal
windows of lower-cased words, which neither capitals nor punctuation change, and template windows of canonical words, which
grow until they have three plain words.  A capital that opens a sentence matches as a plain word and as a name; a name also as the
same word without its capital.  A document holds an item if, within a stretch of about the item's length, at least ``CONTAINMENT``
of the item's windows of one family stand in it, and the slots are consistent: each value of the item's slots goes with one value in
the document (literal windows have no slots).  That finds copies as well as questions with other numbers, names or units.

Defined results: one row per (doc_id, item_id) that match, with the best match of repeated ids; null and empty texts match
nothing; an item of fewer than five words is one window, looked up at its own width in every text, and an item with fewer than
three plain words is only found literally; repeated items each match; an empty table on either side gives no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqpool.llm import textarrays as T
from seqpool.llm.common import written

WINDOW = 5
CONTAINMENT = 0.8
CONSISTENCY = 0.8
LEAST_PLAIN = 3
PREFILTER_WINDOWS = 1 << 22  # up to so many distinct benchmark windows (32 MB) are sent to every task as a first filter

# Unit words.
UNITS = """kg g mg lb lbs oz t ton tons km m cm mm mi mile miles ft feet foot inch inches yard yards hour hours h min mins minute
minutes s sec secs second seconds day days week weeks month months year years dollar dollars usd euro euros eur cent cents pound
pounds percent litre litres liter liters l ml degrees degree celsius fahrenheit kmh mph watt watts w kw volt volts v hz""".split()
PLAIN, NUMBER, UNIT, NAME = 0, 1, 2, 3

_HIT = "doc_id {}, th bigint, pos int, hash bigint, slots array<string>"
_ITEM = "item_id bigint, item_th bigint, family int, n_words int, item_pos int, hash bigint, item_slots array<string>"
_MATCH = "doc_id {}, th bigint, item_id bigint, n_windows int, n_matched int, n_slots int, consistency double, verbatim boolean"


def lower_latin(data: np.ndarray) -> np.ndarray:
    out = T.lower_ascii(data)
    if len(out) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:] += wide.astype(np.uint8) << 5
    return out


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return T.span_hashes(T.byte_values()[raw], np.array([0]), np.array([len(raw)]))[0]


def canonical(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends, kinds in each reading and plain hashes of the words of a chunk, and each text's first word.

    A capital that opens a sentence is plain in the first reading and a name in the second; in the third no word is a name."""
    letter = np.zeros(256, dtype=bool)
    letter[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
    spaced = np.where(letter[data], data, np.uint8(32))
    starts, ends = T.words(spaced, offsets)
    head = data[starts] if len(starts) else np.empty(0, dtype=np.uint8)
    digit = (head >= 48) & (head <= 57)
    if len(starts) > 1:  # 3.14 and 1,000 are one number
        gap = data[np.minimum(ends[:-1], len(data) - 1)]
        text = np.searchsorted(offsets, starts, side="right")
        part = digit[1:] & digit[:-1] & (starts[1:] - ends[:-1] == 1) & ((gap == 46) | (gap == 44)) & (text[1:] == text[:-1])
        keep = np.concatenate([[True], ~part])
        ends = np.concatenate([ends[np.flatnonzero(keep)[1:] - 1], ends[-1:]])
        starts, digit, head = starts[keep], digit[keep], head[keep]
    first = np.searchsorted(starts, offsets)
    hashes = T.span_hashes(T.byte_values()[lower_latin(data)], starts, ends)
    kinds = np.zeros(len(starts), dtype=np.int8)
    kinds[digit] = NUMBER
    after = np.concatenate([[False], digit[:-1]]) if len(digit) else digit
    kinds[after & ~digit & np.isin(hashes, np.array([_hash_of(u) for u in UNITS], dtype=np.uint64))] = UNIT
    second = data[np.minimum(starts + 1, max(len(data) - 1, 0))] if len(starts) else head
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    mark = np.isin(data, np.frombuffer(b".!?:\n", dtype=np.uint8))
    marks = np.concatenate([[0], np.cumsum(mark)])
    opens = np.ones(len(starts), dtype=bool)
    if len(starts):
        opens[1:] = marks[starts[1:]] > marks[ends[:-1]]
        opens[first[:-1][first[:-1] < len(starts)]] = True
    capital &= kinds == PLAIN
    readings = np.stack([kinds, kinds, kinds])
    readings[0][capital & ~opens] = NAME
    readings[1][capital] = NAME
    return starts, ends, readings, hashes, first


def template_spans(kinds: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the template windows of a chunk: WINDOW words, or as many more as give LEAST_PLAIN plain words.

    Windows grow to the right.  The last two arrays are those that grow to the left, where the words before an end are slots."""
    n = len(kinds)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, stop = first[:-1][text], first[1:][text]
    plain = np.flatnonzero(kinds == PLAIN)
    before = np.concatenate([[0], np.cumsum(kinds == PLAIN)])
    starts = np.arange(n)
    none_right, none_left = np.full(LEAST_PLAIN, n), np.full(LEAST_PLAIN, -1)
    ends = np.maximum(starts + WINDOW, np.concatenate([plain, none_right])[before[:-1] + LEAST_PLAIN - 1] + 1)
    good = ends <= stop
    left = np.concatenate([none_left, plain])[before[1:]]
    wide = (left >= begin) & (left < starts + 1 - WINDOW)
    return starts[good], ends[good], left[wide], starts[wide] + 1


def template_hashes(kinds: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return np.where(kinds == PLAIN, hashes, T.mix(kinds.astype(np.uint64) + np.uint64(0xABCDEF)))


def short_spans(first: np.ndarray, width: int) -> np.ndarray:
    """Starts of the spans of ``width`` words that lie in one text."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return np.flatnonzero(np.arange(len(text)) + width <= first[1:][text])


def chunk_windows(readings: np.ndarray, hashes: np.ndarray, first: np.ndarray,
                  widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(reading, starts, ends, positions, hashes) of the windows of a chunk; in reading -1 they are literal.

    A literal window is the hash of lower-cased words, so neither capitals nor punctuation matter.  A window that grew to the left
    stands at the position of its last WINDOW words."""
    n = len(hashes) - WINDOW + 1
    if n > 0:
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
        at = np.flatnonzero(np.arange(n) + WINDOW <= first[1:][text])
        yield -1, at, at + WINDOW, at, T.mix(T.gram_hashes(hashes, WINDOW) ^ np.uint64(0x5EED))[at]
    for reading, kinds in enumerate(readings):
        words = template_hashes(kinds, hashes)
        starts, ends, left, stops = template_spans(kinds, first)
        yield reading, starts, ends, starts, T.span_hashes(words, starts, ends)
        yield reading, left, stops, stops - WINDOW, T.mix(T.span_hashes(words, left, stops) ^ np.uint64(0x1EF7))
        plain = np.concatenate([[0], np.cumsum(kinds == PLAIN)])
        for k in widths:
            at = short_spans(first, k)
            if not reading:
                yield -1, at, at + k, at, T.mix(T.span_hashes(hashes, at, at + k) ^ np.uint64(0x5EED + k))
            n_plain = plain[at + k] - plain[at]
            at = at[(n_plain >= min(LEAST_PLAIN, k)) & (n_plain < k)]
            yield reading, at, at + k, at, T.mix(T.span_hashes(words, at, at + k) + np.uint64(k))


def filter_table(only: np.ndarray) -> np.ndarray:
    """Which leading bits the sorted hashes have: a quick first look-up."""
    bits = min(26, max(16, (16 * len(only)).bit_length()))
    out = np.zeros(1 << bits, dtype=bool)
    out[only >> np.uint64(64 - bits)] = True
    return out


def text_windows(batch: pa.RecordBatch, widths: list[int], only: np.ndarray | None = None, quick: np.ndarray | None = None):
    """(rows, each text's first word, windows) of each chunk; a window: (row, readings, start, end, position, hash, slots)."""
    for part, data, offsets in T.chunks(batch):
        begins, stops, readings, hashes, first = canonical(data, offsets)
        found, raw = {}, None
        for reading, starts, ends, places, values in chunk_windows(readings, hashes, first, widths):
            if only is not None:
                near = np.flatnonzero(quick[values >> np.uint64(64 - (len(quick).bit_length() - 1))])
                values = values[near]
                if len(only):
                    real = only[np.minimum(np.searchsorted(only, values), len(only) - 1)] == values
                    near, values = near[real], values[real]
                starts, ends, places = starts[near], ends[near], places[near]
            row = np.searchsorted(first, starts, side="right") - 1
            for i, j, k, at, h in zip(row.tolist(), starts.tolist(), ends.tolist(), places.tolist(), values.tolist(), strict=True):
                raw = raw or data.tobytes()
                place = at if k - j >= WINDOW else -1  # of a short item's hash one place is enough
                if (i, place, h) in found:
                    found[i, place, h][1].append(reading)
                    continue
                # slots behind the first words are those of the next windows
                kinds, stop = readings[reading], k if at > j else min(k, j + WINDOW)
                slots = [] if reading < 0 else [
                    f"{kinds[x]}{raw[begins[x]:stops[x]].decode()}" for x in range(j, stop) if kinds[x] != PLAIN]
                found[i, place, h] = (i, [reading], j, k, at - int(first[i]), h, slots)
        if found:
            yield part, first, list(found.values())


def _batch(part: pa.RecordBatch, id_column: str, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """The id and text hash of each row's first entry, then its hash and slots behind the integers between."""
    take = pa.array([r[0] for r in rows], pa.int64())
    middle = [pa.array([r[i] for r in rows], pa.int32()) for i in range(1, len(names) - 3)]
    return pa.RecordBatch.from_arrays(
        [part.column(id_column).take(take), part.column("th").take(take), *middle,
         pa.array(np.array([r[-2] for r in rows], dtype=np.uint64).view(np.int64)), pa.array([r[-1] for r in rows], pa.list_(pa.string()))],
        names)


def document_windows(docs: DataFrame, widths: list[int], only: np.ndarray | None = None) -> DataFrame:
    """doc_id, th, pos, hash, slots of the windows of ``docs``; of those in ``only``, if it is given."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quick = None if only is None else filter_table(only)
        for batch in batches:
            for part, _, found in text_windows(batch, widths, only, quick):
                yield _batch(part, "doc_id", [(i, pos, h, slots) for i, _, _, _, pos, h, slots in found],
                             ["doc_id", "th", "pos", "hash", "slots"])

    x = docs.select("doc_id", "text").withColumn("th", F.xxhash64("text"))
    return x.mapInArrow(run, _HIT.format(x.schema["doc_id"].dataType.simpleString()))


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, item_th, family, n_words, item_pos, hash, item_slots of the windows of the items.

    Family 0 has the literal windows.  The others have the templates: one family for the positions that each reading has, with the
    windows of every reading there; each family is held against a document on its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, found in text_windows(batch, list(range(1, WINDOW))):
                size, out = np.diff(first).tolist(), []
                places: dict[int, list[set]] = defaultdict(lambda: [set(), set(), set()])
                kept = []
                for w in found:
                    i, readings, j, k, pos, _, _ = w
                    if k - j < WINDOW and k - j != size[i]:
                        continue  # of a short item only the whole is a window
                    if pos != j - first[i] and k != first[i + 1]:
                        continue  # only the last window of an item grows to the left
                    kept.append(w)
                    for reading in readings:
                        if reading >= 0:
                            places[i][reading].add(pos)
                for i, readings, _, _, pos, h, slots in kept:
                    if readings[0] < 0:
                        families = [0]
                    else:
                        kinds = dict.fromkeys(frozenset(x) for x in places[i] if x)
                        families = [n + 1 for n, x in enumerate(kinds) if pos in x]
                    out += [(i, family, size[i], pos, h, slots) for family in families]
                if out:
                    yield _batch(part, "item_id", out, [c.split()[0] for c in _ITEM.split(", ")])

    return items.select("item_id", "text").withColumn("th", F.xxhash64("text")).mapInArrow(run, _ITEM)


def longest_chain(pairs: list[dict]) -> list[dict]:
    """The longest chain of pairs (sorted by pos, item_pos) that rises in both texts; of equal ones that with fewest shifts."""
    places = {x: i + 1 for i, x in enumerate(sorted({p["item_pos"] for p in pairs}))}
    tree: list[tuple[int, int, int]] = [(0, 0, -1)] * (len(places) + 1)  # best (length, -shifts, pair) up to an item position
    ends: list[tuple[int, int, int]] = []
    before: list[int] = []
    shift_ends: dict[int, int] = {}
    at = 0
    while at < len(pairs):
        stop = at
        while stop < len(pairs) and pairs[stop]["pos"] == pairs[at]["pos"]:
            p = pairs[stop]
            best, i = (0, 0, -1), places[p["item_pos"]] - 1
            while i:
                best = max(best, tree[i])
                i &= i - 1
            if best[0]:
                best = (best[0], best[1] - 1, best[2])
            along = shift_ends.get(p["pos"] - p["item_pos"])
            if along is not None and ends[along][:2] > best[:2]:
                best = ends[along]
            before.append(best[2])
            ends.append((best[0] + 1, best[1], stop))
            stop += 1
        for j in range(at, stop):  # pairs of one document position never follow each other
            p = pairs[j]
            shift_ends[p["pos"] - p["item_pos"]] = j
            i = places[p["item_pos"]]
            while i < len(tree):
                tree[i] = max(tree[i], ends[j])
                i += i & -i
        at = stop
    chain, j = [], max(ends)[2] if ends else -1
    while j >= 0:
        chain.append(pairs[j])
        j = before[j]
    return chain


def slot_votes(aligned: list[dict]) -> tuple[float, int, bool]:
    """(consistency, slot pairs, equal) of pairs that align each item position at most once."""
    votes: dict[str, Counter] = defaultdict(Counter)
    for p in aligned:
        for a, b in zip(p["item_slots"], p["slots"], strict=True):
            votes[a][b] += 1
    total = sum(sum(c.values()) for c in votes.values())
    agree = sum(max(c.values()) for c in votes.values())
    return agree / total if total else 1.0, total, all(set(c) == {a} for a, c in votes.items())


def best_match(pairs: list[dict], n_windows: int, n_words: int) -> tuple[int, int, float, bool]:
    """(windows matched, slot pairs, consistency, verbatim) of the best stretch of the document; literal windows all found are verbatim.

    ``pairs``: pos, item_pos, hash, slots, item_slots of the windows that the two share.  An item position votes once: along
    the longest chain of the stretch, or along one shift (pos - item_pos) that aligns as many windows and agrees better."""
    pairs = sorted(pairs, key=lambda p: (p["pos"], p["item_pos"], -len(p["slots"])))
    pairs = [p for i, p in enumerate(pairs)
             if not i or (p["pos"], p["item_pos"]) != (pairs[i - 1]["pos"], pairs[i - 1]["item_pos"])]
    reach, lo, best = 2 * n_words + WINDOW, 0, (0, 0, 0)
    inside: Counter = Counter()
    for hi, p in enumerate(pairs):
        inside[p["item_pos"]] += 1
        while p["pos"] - pairs[lo]["pos"] > reach:
            inside[pairs[lo]["item_pos"]] -= 1
            if not inside[pairs[lo]["item_pos"]]:
                del inside[pairs[lo]["item_pos"]]
            lo += 1
        if len(inside) > best[0]:
            best = (len(inside), lo, hi + 1)
    chain = longest_chain(pairs[best[1]: best[2]])
    shifts: dict[int, list[dict]] = defaultdict(list)
    for p in pairs:
        shifts[p["pos"] - p["item_pos"]].append(p)
    ways = [chain] + [x for x in shifts.values() if len(x) >= len(chain)]
    agreed, total, equal = max(map(slot_votes, ways))
    return best[0], total, agreed, best[0] == n_windows and equal


def matches(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT,
            consistency: float = CONSISTENCY) -> DataFrame:
    """doc_id, th (hash of the text), item_id, n_windows, n_matched, n_slots, consistency, verbatim of the matching pairs,
    once for each family of windows that matches.

    ``docs``: doc_id, text; ``benchmark``: item_id, text."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    windows = written(item_windows(items), "benchmark-windows")
    hashes = windows.select("hash").distinct()
    only = None
    if hashes.count() <= PREFILTER_WINDOWS:
        only = np.sort(hashes.toArrow()["hash"].to_numpy().view(np.uint64))  # eight bytes a window
    widths = sorted(r["n_words"] for r in windows.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect())
    one = ["item_id", "item_th", "family"]
    per_item = windows.groupBy(*one).agg(F.countDistinct("item_pos").cast("int").alias("n_windows"), F.max("n_words").alias("n_words"))
    hits = document_windows(docs, widths, only)
    kind = hits.schema["doc_id"].dataType.simpleString()
    shared = hits.join(windows.drop("n_words"), "hash")
    # at most the windows of one document that one item shares
    groups = shared.groupBy("doc_id", "th", *one).agg(
        F.collect_list(F.struct("pos", "item_pos", "slots", "item_slots")).alias("pairs"),
        F.countDistinct("item_pos").alias("seen"))
    groups = groups.join(per_item, one).where(F.col("seen") >= containment * F.col("n_windows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.select(["pairs", "n_windows", "n_words"]).to_pylist():
                out.append((r["n_windows"], *best_match(r["pairs"], r["n_windows"], r["n_words"])))
            if out:
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("th"), batch.column("item_id"), pa.array(c[0], pa.int32()),
                     pa.array(c[1], pa.int32()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.bool_())],
                    ["doc_id", "th", "item_id", "n_windows", "n_matched", "n_slots", "consistency", "verbatim"])

    found = groups.select("doc_id", "th", "item_id", "n_windows", "n_words", "pairs").mapInArrow(run, _MATCH.format(kind))
    return found.where((F.col("n_matched") >= containment * F.col("n_windows")) & (F.col("consistency") >= consistency))


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT,
                 consistency: float = CONSISTENCY) -> DataFrame:
    """The best match of each (doc_id, item_id) that match."""
    share = (F.col("n_matched") / F.col("n_windows")).alias("share")
    best = F.max(F.struct(share, "verbatim", "consistency", "n_matched", "n_slots", "n_windows")).alias("m")
    return matches(docs, benchmark, containment, consistency).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "m.n_windows", "m.n_matched", "m.n_slots", "m.consistency", "m.verbatim")
