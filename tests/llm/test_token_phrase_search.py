"""Token files, phrase mining and ranked search against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqpool.llm import packing, phrases, queries, quotient_filter, ranked_search, token_files

SCHEMA = "doc_id bigint, text string, lang string, ids string, n_tokens string, task string, row string"


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000, 70_001])
def test_block_round_trip(n):
    rng = np.random.default_rng(n)
    values = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype("<u4")
    control, data = token_files.encode_block(values)
    assert len(control) == -(-n // 4)
    assert len(data) == sum(1 if v < 1 << 8 else 2 if v < 1 << 16 else 3 if v < 1 << 24 else 4 for v in values.tolist())
    assert (token_files.decode_block(control, data, n) == values).all()


def test_white_space_runs_have_the_ids_of_tokenizers():
    from tokenizers import Tokenizer

    encode = packing.encoder(packing.tokenizer_path())
    whole = Tokenizer.from_file(packing.tokenizer_path())
    for text in (" " * 3_000_000, "a" + "\n" * 70_000 + "b", "　" * 70_000 + "x", " " * 65_535 + "y"):
        assert encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("stripe,block", [(1 << 20, 1 << 18), (300, 128), (1, 7)])
def test_token_files(spark, monkeypatch, stripe, block):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "STRIPE_IDS", stripe)
    monkeypatch.setattr(token_files, "BLOCK_IDS", block)
    rng = random.Random(3)
    texts = [None, "", "  \n", "<|endoftext|> é 漢字", "word " * 9000] + [
        " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    ids = [7, None, 7, -3, 1 << 60, None] + rng.sample(range(1000), len(texts) - 6)
    rows = [(i, t, "en", "x", "y", "z", "r") for i, t in zip(ids, texts, strict=True)] + [(5000, "same", *"abcde")] * 3
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    folder, index = token_files.write_files(docs)
    got = token_files.read_files(spark, folder, index, with_ids=True).collect()

    whole = Tokenizer.from_file(packing.tokenizer_path())
    want = sorted(((i is not None, i or 0), whole.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows)
    at, found = 0, []
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        found.append(((r["doc_id"] is not None, r["doc_id"] or 0), r["ids"]))
        at += r["n_tokens"]
    assert [k for k, _ in found] == [k for k, _ in want]  # ascending, those without an id first
    assert sorted(found) == want
    if stripe == 1:
        assert index.count() == len(rows)  # a stripe a document
        one = index.where("stripe = 0").limit(1)
        assert token_files.read_files(spark, folder, one).count() == 1
    ranks = token_files.read_rank_table(folder).tolist()
    counts = np.bincount([x for _, own in want for x in own])
    assert ranks == sorted(np.flatnonzero(counts).tolist(), key=lambda x: (-counts[x], x))


def test_token_files_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    folder, index = token_files.write_files(docs)
    assert token_files.read_files(spark, folder, index).count() == 0


# phrases ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n,bits", [(2, 1), (2, 17), (3, 21), (4, 17), (5, 12), (5, 13), (5, 30), (2, 32)])
@pytest.mark.parametrize("shard_bits", [0, 1, 5])
def test_filters_lose_nothing(n, bits, shard_bits):
    rng = np.random.default_rng(n * bits)
    kind = quotient_filter.Keys(n, bits)
    ids = [rng.integers(0, 1 << bits, 700, dtype=np.uint64) for _ in range(n)]
    ids = [np.concatenate([x, x[:300], x[:1].repeat(400)]) for x in ids]
    want = Counter(zip(*(x.tolist() for x in ids), strict=True))
    half = [quotient_filter.count_keys(kind.permute([x[i::2] for x in ids])) for i in (0, 1)]
    found: Counter = Counter()
    for shard in range(1 << kind.shard_bits(shard_bits)):
        parts = []
        for keys, counts in half:
            own = kind.shard(keys, shard_bits) == shard
            raw = quotient_filter.encode(kind, [x[own] for x in keys], counts[own], shard_bits)
            again, back = quotient_filter.decode(kind, raw, shard, shard_bits)
            assert all((a == b[own]).all() for a, b in zip(again, keys, strict=True)) and (back == counts[own]).all()
            parts.append((again, back))
        keys, counts, place = quotient_filter.merge(parts)
        assert quotient_filter.member(parts[0][0], keys).all() and len(place) == sum(len(p[1]) for p in parts)
        restored = kind.restore(keys)
        found.update(dict(zip(zip(*(x.tolist() for x in restored), strict=True), counts.tolist(), strict=True)))
    assert found == want


def brute_phrases(rows, min_count, max_words, top, percent):
    f, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            f.update((lang, *w[i:i + k]) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    cands = {k: a for k, a in f.items() if len(k) > 2 and a >= min_count}
    inside = {(k[0], *k[1:][i:j]) for k, a in cands.items() for i in range(len(k) - 1) for j in range(i + 2, len(k))
              if j - i < len(k) - 1 and 100 * a >= percent * cands[(k[0], *k[1:][i:j])]}
    out = []
    for k, a in cands.items():
        if k not in inside:
            cuts = [(1000 * a * total[k[0]] // (f[k[:c]] * f[(k[0], *k[c:])]), c) for c in range(2, len(k))]
            score, c = min(cuts)
            out.append((k[0], " ".join(k[1:]), a, f[k[:c]], f[(k[0], *k[c:])], total[k[0]], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    seen: Counter = Counter()
    ranked = []
    for r in out:
        seen[r[0]] += 1
        if seen[r[0]] <= top:
            ranked.append((r[0], seen[r[0]], *r[1:]))
    return ranked


@pytest.mark.parametrize("min_count,max_words,top,percent", [(3, 5, 40, 100), (2, 3, 2000, 60), (4, 2, 5, 100)])
def test_phrases(spark, monkeypatch, min_count, max_words, top, percent):
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 2000)
    monkeypatch.setattr(phrases, "SHARD_WORDS", 100)
    rng = random.Random(8)
    vocabulary = ["a", "b", "c", "é", "漢", "X", "x", "w1", "w2", "\x00", "\xa0", "ß-", "''", "dd", "ee"]
    rows = [(None, "en"), ("", None), (" \t ", "en"), ("a a a a a a a", "en"), (". , ;\n", "fr"), ("one", None)]
    for i in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\r\n"]) for _ in range(rng.randrange(60)))
        rows += [(text, [None, "en", "und", "fr", ""][i % 5])] * (3 if i % 20 == 0 else 1)
    docs = spark.createDataFrame([(i, *r, "w", 1, "k") for i, r in enumerate(rows)],
                                 "doc_id bigint, text string, lang string, word string, n int, ids string").repartition(3)
    got = phrases.mine(docs, min_count, max_words, top, percent).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_phrases(rows, min_count, max_words, top, percent))


def test_phrases_of_long_and_no_texts(spark):
    assert phrases.mine(spark.createDataFrame([], "doc_id bigint, text string, lang string")).count() == 0
    text = "x" * 2_500_000 + " " + "some words here. " * 150_000
    got = phrases.mine(spark.createDataFrame([(1, text, "en")], "doc_id bigint, text string, lang string"))
    assert [(r["phrase"], r["a"], r["n"]) for r in got.collect()] == [("some words here", 150_000, 450_001)]
    assert b"".join(phrases._slices(b"ab " * 900_000)) == b"ab " * 900_000


def test_products_beyond_64_bits(spark):
    x = spark.createDataFrame([(10 ** 12, 10 ** 15, 10 ** 12, 10 ** 12 - 1), (100, 10 ** 13, 333, 101)], "a bigint, n bigint, l bigint, r bigint")
    rows = x.withColumn("s", phrases._exact_score(*(x[c] for c in "anlr"))).collect()
    assert [r["s"] for r in rows] == [1000 * r["a"] * r["n"] // (r["l"] * r["r"]) for r in rows]


# ranked search ---------------------------------------------------------------------------------------


def brute_ranks(docs, items, k):
    pattern = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    split = lambda t: re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, Counter(split(t))) for d, t in docs]
    big_n, big_l = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        rows = []
        for d, b in bags:
            m = 100 - 25 + (25 * b.total() * big_n) // big_l if big_l else 0
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * b[t]) // (1000 * b[t] + 12 * m))
                    for t in split(text) if t in b)
            if s > 0:
                rows.append((-s, d is not None, d or 0))
        out += [(item, i + 1, d if known else None, -s) for i, (s, known, d) in enumerate(sorted(rows)[:k])]
    return out


@pytest.mark.parametrize("unit,batch,fanout", [(8192, 4 << 20, 16), (7, 60, 2), (40, 300, 3)])
def test_ranked_search(spark, monkeypatch, unit, batch, fanout):
    monkeypatch.setattr(ranked_search, "UNIT_DOCS", unit)
    monkeypatch.setattr(ranked_search, "BATCH_BYTES", batch)
    rng = random.Random(unit)
    word = lambda: rng.choice(["Common", f"w{rng.randrange(12)}", f"r{rng.randrange(200)}", "é漢", "x-y", "_", "\x85"])
    docs = [(None, "common w1"), (None, None), (3, ""), (4, "--- ..."), (4, "w1 w1 w2"), (5, "r1 " * 4000), (1 << 60, "r7 w3")]
    docs += [(i + 10, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(150)] + [(900, "w1 w2 w3")] * 30
    items = [(1, None), (2, ""), (3, "!!!"), (4, "w1 w1 w2"), (4, "w1 w1 w2"), (4, "r5"), (None, "common é漢"), (5, "absent"), (6, "W3 R7 x-y")]
    items += [(i + 20, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(25)]
    d = spark.createDataFrame([(*r, 1, "s", 2) for r in docs], "doc_id bigint, text string, rank int, slot string, score int").repartition(3)
    q = spark.createDataFrame([(*r, 1, "s") for r in items], "item_id bigint, text string, rank int, h string")
    got = ranked_search.rank_documents(d, q, 20).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, brute_ranks(docs, items, 20)))


def test_ranked_search_of_empty_tables(spark):
    none, one = (spark.createDataFrame(r, "doc_id bigint, item_id bigint, text string") for r in ([], [(1, 1, "a b")]))
    assert ranked_search.rank_documents(none, one).count() == 0
    assert ranked_search.rank_documents(one, none).count() == 0
    # N = df = 1, L = n = 2: weight floor(1000 ln(4 / 3)) = 287, m = 100, each of the two terms 10**9 div 2200
    assert [tuple(r) for r in ranked_search.rank_documents(one, one).collect()] == [(1, 1, 1, 2 * 287 * (10 ** 9 // 2200))]


def test_dual_tree_prunes_and_keeps_the_best():
    rng = np.random.default_rng(4)
    n, v = 3000, 300
    rows = np.repeat(np.arange(n), 12)
    topic = np.arange(n) % 30
    pairs = np.unique(np.stack([rows, topic[rows] * 10 + rng.integers(0, 10, len(rows))]), axis=1)
    values = rng.integers(1, 1000, pairs.shape[1])
    docs = ranked_search.DocTree(np.arange(n), np.zeros(n, bool), pairs[0], pairs[1], values, np.ones(v, np.int64))
    queries = [(np.sort(rng.choice(10, 4, replace=False)) + 10 * (i % 30), rng.integers(1, 9, 4)) for i in range(60)]
    items = ranked_search.ItemTree(queries)
    best = [ranked_search.Best(20, 1) for _ in queries]
    ranked_search.first_look(items, docs, best)
    second = [ranked_search.Best(20, b.least) for b in best]
    taken = ranked_search.search(items, docs, second)
    dense = np.zeros((n, v), dtype=np.int64)
    dense[pairs[0], pairs[1]] = values
    for (t, w), b in zip(queries, second, strict=True):
        want = dense[:, t] @ w
        order = np.lexsort((np.arange(n), -want))[:20]
        assert b.ids.tolist() == order.tolist() and b.scores.tolist() == want[order].tolist()
    assert taken < 60 * n / 10


@pytest.mark.parametrize("name", ["op12_phrases", "op13_ranked_search"])
def test_queries_have_sql(name):
    assert name in queries.QUERIES and name in queries.SQL
