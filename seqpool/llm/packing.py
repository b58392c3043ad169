"""Best-fit packing of token sequences through a configuration linear program.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.  A configuration is a
multiset of piece lengths that fit one sequence.  The linear program over configurations (use as few
sequences as cover the length histogram) is solved by multiplicative weights: lengths that are
already covered lose weight, and a knapsack dynamic program prices, for every length, the best configuration with it under the
current weights.  Multiplicities are rounded as they are taken; the few pieces left are packed by best fit, sequences of equal content being
one group.

Only the histogram (at most ``capacity`` counts) reaches the driver, and the plan it makes has a number of rows
that the rounds and the capacity bound, whatever the corpus holds (63 020 for 10 000 000 log-normal lengths).  Pieces find their place by rank: every piece has a rank among those of its
length (counted per lot of at most ``LOT_PIECES`` pieces while tokenising, plus the sum of the lots before), and the plan
gives each range of ranks a configuration, first sequence and offset.

Defined results: null and empty texts are the end token alone; repeated rows and ids are packed row by row;
an empty table gives no rows.  A document longer than the capacity has its short piece first.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqpool.llm.common import written

CAPACITY = 2048
END_ID = 0
LOT_PIECES = 1 << 14
LP_SHARE = 0.5  # of what a configuration could still cover, taken in one step
LP_GAP = 0.005  # a configuration taken weighs at most so much less than the best, relatively
LP_REST = 0.05  # of the pieces, left to best fit at most, unless nothing priced fits any more
LEARNING_RATE = 0.02  # a covered length loses so much weight
LONG_BONUS = 0.02  # long pieces first: short ones fill gaps later
TOKENIZER = "byte_bpe_50k.json"
RANK_BITS = 40  # ranks of a length, beside the length in one key
SPACE_RUN = 1 << 16  # tiktoken's pattern runs out of stack on a million white spaces in a row

_PIECE = "doc_id {}, piece int, start bigint, length bigint, ids_crc32 bigint, lot bigint, lot_rank bigint"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> ids of the byte-level BPE file at ``path``, as the ``tokenizers`` library gives them.

    The merges run in ``tiktoken`` over the same vocabulary (about three times as fast); texts that hold one of the
    file's special strings, or a run of white space that its pattern cannot take, go to ``tokenizers`` itself."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    whole = Tokenizer.from_file(path)
    special = [x["content"] for x in spec["added_tokens"]]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    sign = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(sign[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    long_space = re.compile(r"\s{%d}" % SPACE_RUN)
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special) or len(text) >= SPACE_RUN and long_space.search(text):
            return np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; the first may be shorter."""
    head = n % capacity
    pieces = [(0, head)] if head else []
    return pieces + [(i, capacity) for i in range(head, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, lot, lot_rank and, if wanted, the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer or tokenizer_path())
        task, done, ranks = TaskContext.get().partitionId(), 0, Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.array([END_ID], dtype="<u4"))
                    for i, (start, length) in enumerate(cut(len(ids), capacity)):
                        lot, within = divmod(done, LOT_PIECES)
                        if within == 0:
                            ranks.clear()
                        own = ids[start: start + length]
                        rows.append((doc_id, i, start, length, zlib.crc32(own.tobytes()), (task << 32) + lot, ranks[length],
                                     own if with_ids else None))
                        ranks[length] += 1
                        done += 1
                columns = list(zip(*rows, strict=True))
                kinds = [part.schema.field("doc_id").type, pa.int32(), *[pa.int64()] * 5]
                arrays = [pa.array(c, k) for c, k in zip(columns[:7], kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "lot", "lot_rank"]
                if with_ids:
                    arrays.append(pa.array(columns[7], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    x = docs.select("doc_id", "text")
    schema = _PIECE.format(x.schema["doc_id"].dataType.simpleString()) + ", ids array<bigint>" * with_ids
    return x.mapInArrow(run, schema)


def knapsack(weights: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Unbounded knapsack by dynamic programming: the largest weight within each room, and the piece it takes next (0: none).

    ``weights`` by length, -inf where no piece has the length; its last index is the capacity."""
    capacity = len(weights) - 1
    best, pick = np.zeros(capacity + 1), [0] * (capacity + 1)
    turned = weights[::-1].copy()
    for c in range(1, capacity + 1):
        value = best[:c] + turned[capacity - c: capacity]  # of equal values the longest piece
        i = int(value.argmax())
        if value[i] > 0:
            best[c], pick[c] = value[i], c - i
    return best, pick


def configuration(room: int, pick: list[int], config: Counter) -> Counter:
    """``config`` with the pieces that ``pick`` takes within ``room``."""
    while room > 0 and pick[room]:
        config[pick[room]] += 1
        room -= pick[room]
    return config


def price(lengths: np.ndarray, weights: np.ndarray, capacity: int) -> Counter:
    """The configuration of largest weight."""
    dense = np.full(capacity + 1, -np.inf)
    fits = lengths <= capacity
    dense[lengths[fits]] = weights[fits]
    return configuration(capacity, knapsack(dense)[1], Counter())


def solve_program(histogram: dict[int, int], capacity: int, rest: float = LP_REST) -> list[tuple[Counter, int]]:
    """Configurations with whole multiplicities that use no length more often than it occurs.

    A round prices, under the present weights, the best configuration that holds each length, and takes those within
    ``LP_GAP`` of the best of all, ``LP_SHARE`` of what they could still cover at a time (rounded down, but once at least).  The
    rounds end when at most ``rest`` of the pieces are left, or when none of the configurations fits what is left."""
    size = np.arange(capacity + 1)
    wanted, used = np.zeros(capacity + 1), np.zeros(capacity + 1)
    for k, n in histogram.items():
        wanted[k] = n
    taken: Counter = Counter()
    left, most = wanted.sum(), rest * wanted.sum()
    while left > most:
        covered = used / np.maximum(wanted, 1)
        weights = np.where(used < wanted, size * np.exp(-LEARNING_RATE * covered) * (1 + LONG_BONUS * size / capacity), -np.inf)
        best, pick = knapsack(weights)
        near = weights + best[capacity - size] >= (1 - LP_GAP) * best[capacity]
        before = left
        for k in np.flatnonzero(near & (used < wanted))[::-1].tolist():
            config = configuration(capacity - k, pick, Counter([k]))
            fit = min((wanted[x] - used[x]) // a for x, a in config.items())
            times = int(max(min(fit, 1), LP_SHARE * fit))
            if times:
                taken[frozenset(config.items())] += times
                for x, a in config.items():
                    used[x] += a * times
                left -= times * sum(config.values())
        if left == before:
            break
    return [(Counter(dict(config)), times) for config, times in taken.items()]


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """Best fit decreasing over a histogram: sequences that hold the same are one group with a count."""
    groups: dict[int, list[tuple[tuple, int]]] = {capacity: []}  # room -> (content, sequences)
    rooms: list[int] = []  # rooms that have groups, ascending

    def put(room: int, content: tuple, times: int) -> None:
        if times:
            if not groups.get(room):
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((content, times))

    for k in sorted(histogram, reverse=True):
        n = histogram[k]
        while n:
            at = bisect.bisect_left(rooms, k)
            if at < len(rooms):  # the tightest room that fits
                room = rooms[at]
                content, times = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, content, times = capacity, (), n
            each = room // k
            whole = min(times, n // each)
            put(room - each * k, (*content, (k, each)), whole)
            n -= whole * each
            times -= whole
            if n and times:  # the last few go into one sequence
                put(room - n * k, (*content, (k, n)), 1)
                n, times = 0, times - 1
            if content:
                put(room, content, times)
    return [(Counter(dict(content)), times) for room in rooms for content, times in groups[room]]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Counter, int]]:
    """(configuration, number of sequences) that take every piece of the histogram exactly once.

    The program's rounded solution, and best fit for what is left; or best fit for all, if that takes fewer."""
    left = Counter(histogram)
    rounded = solve_program(histogram, capacity)
    for config, times in rounded:
        left.subtract({k: a * times for k, a in config.items()})
    plans = [rounded + best_fit(+left, capacity), best_fit(histogram, capacity)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def plan_rows(plan: list[tuple[Counter, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of the length in a sequence, first offset)."""
    rows, used, sequence = [], Counter(), 0
    for config, times in plan:
        offset = 0
        for k in sorted(config, reverse=True):
            rows.append((k, used[k], used[k] + times * config[k], sequence, config[k], offset))
            used[k] += times * config[k]
            offset += k * config[k]
        sequence += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The written ``pieces`` with sequence_id and offset; other columns are carried along."""
    counts = pieces.groupBy("length", "lot").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1))
    lots = counts.select("length", "lot", F.coalesce(before, F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = plan_rows(make_plan(histogram, capacity))  # bounded by the rounds and the capacity, whatever the corpus holds
    plan = np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)
    starts = (plan[:, 0] << RANK_BITS) + plan[:, 1]
    ranked = pieces.join(lots, ["length", "lot"]).withColumn("rank", F.col("lot_rank") + F.col("before"))
    kept = [c for c in pieces.columns if c not in ("lot", "lot_rank")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            _, lo, _, first, copies, base = plan[np.searchsorted(starts, (length << RANK_BITS) + rank, side="right") - 1].T
            turn, place = np.divmod(rank - lo, copies)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(first + turn), pa.array(base + place * length)],
                [*kept, "sequence_id", "offset"])

    ranked = ranked.select(*kept, "rank")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset for every piece of ``docs`` (doc_id, text)."""
    pieces = written(token_pieces(docs, capacity, tokenizer, with_ids), "packing-pieces")
    return pack(pieces, capacity)
