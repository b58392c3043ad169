"""Operators on whole texts against brute force: near duplicates, substring and suffix dedup, fingerprints, decontamination."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqpool.llm import decontamination, fingerprints, graph, induced_sort, near_dedup, substring_dedup, suffix_dedup
from seqpool.llm import textarrays as T

SCHEMA = "doc_id bigint, text string, spans string, th string, key int, row string, doc_id2 bigint"


def words(rng, n, vocabulary=400):
    return [f"{'abcdefghij'[w % 10]}w{w}" for w in (rng.randrange(vocabulary) for _ in range(n))]


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and blank texts, repeats, shared passages, near copies, a very long text, one periodic text."""
    rng = random.Random(5)
    passage, other = words(rng, 70), words(rng, 55)
    base = words(rng, 150)
    out = [None, "", "   \n\t ", "one", "Two words", "two words", "é ß 漢字 " * 30, "x " * 400, "aaaa" * 120]
    out += [" ".join(base)] * 3
    for i in range(14):
        near = list(base)
        for _ in range(1 + i % 7):
            near[rng.randrange(len(near))] = f"new{rng.randrange(99)}"
        out.append(" ".join(near))
    for i in range(25):
        w = words(rng, rng.randrange(20, 160))
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = passage if i % 2 else passage[: 40 + i]
        if i % 4 == 0:
            w += other[i % 5:]
        out.append(" ".join(w) if i % 5 else "  ".join(w).upper() + "\n")
    out.append(" ".join(words(rng, 9000)) + " " + " ".join(passage))
    out.append(" ".join(passage + words(rng, 10) + passage))  # twice in one text
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "s", "t", 1, "r", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(texts, k, similarity=80):
    sets = [shingles(t, k) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= similarity * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i), find(i) == i) for i, s in enumerate(sets)}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, texts, k):
    got = {r[0]: tuple(r[1:]) for r in near_dedup.near_duplicates(docs, k=k).collect()}
    assert got == brute_components(texts, k)


def test_near_duplicates_repeated_rows_and_null_ids(spark, nothing):
    text = " ".join(f"w{i}" for i in range(40))
    x = spark.createDataFrame([(3, text), (3, text), (9, text), (None, text), (None, None)], "doc_id bigint, text string")
    got = sorted(near_dedup.near_duplicates(x).select("doc_id", "component_id", "kept").collect(), key=str)
    assert got == sorted([(3, 3, True), (3, 3, True), (9, 3, False), (None, None, True), (None, None, True)], key=str)
    assert near_dedup.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("edges", [[], [(5, 2), (2, 9), (2, 7)], [(i, i + 1) for i in range(40)], [(1, 3), (2, 3), (2, 8), (8, 1), (6, 7), (4, 4)]])
def test_components(spark, edges):
    """None, a star, a path, a cycle beside a pair and a loop; the roots found may stand among the edges of a later call."""
    got = graph.components(spark.createDataFrame(edges, "u bigint, v bigint"))
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(map(tuple, got.collect())) == sorted((x, r) for x, r in root.items() if x != r)
    more = got.selectExpr("node AS u", "root AS v").unionByName(spark.createDataFrame([(-1, 7)], "u bigint, v bigint"))
    again = {r["node"]: r["root"] for r in graph.components(more).collect()}
    joined = [x for x in root if 7 in root and root[x] == root[7]] or [7]
    assert again == {x: r for x, r in root.items() if x != r} | {x: -1 for x in joined}


def test_links_that_no_hub_sees(spark):
    """a - b - c - d: a chain of near copies, where only neighbours are similar."""
    base = [f"w{i}" for i in range(300)]
    rows, w = [], list(base)
    for i in range(12):
        rows.append((11 - i, " ".join(w)))
        for j in range(5):
            w[(i * 25 + j * 5) % 300] = f"x{i}_{j}"
    x = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r[0]: tuple(r[1:]) for r in near_dedup.near_duplicates(x, k=4).collect()}
    assert got == brute_components([t for _, t in sorted(rows)], 4)


def test_an_id_has_the_links_of_all_its_texts(spark):
    def text(name, changed=0):
        return " ".join(f"{name}{i}" if i >= changed else f"new{name}{i}" for i in range(60))

    rows = [(1, text("a")), (1, text("b")), (1, ""), (2, text("a", 2)), (3, text("b", 2)), (4, text("c")), (4, text("d")), (5, text("d")),
            (6, text("e")), (6, text("f")), (7, text("f")), (7, text("g")), (8, text("g", 1)), (9, None), (None, text("a"))]
    x = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(x).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 4, False), (6, 6, True), (7, 6, False), (8, 6, False),
                   (9, 9, True), (None, None, True)}


def test_members_of_a_bucket_far_from_its_hub(spark):
    """Many texts of one template: what they share is common, links hang on rare words."""
    rng = random.Random(17)
    template = words(rng, 120)
    texts = []
    for g in range(12):
        own = template[:60] + words(rng, 12, 10_000) + template[60:]
        for _ in range(3):
            w = list(own)
            w[rng.randrange(len(w))] = f"z{rng.randrange(9999)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    x = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r[0]: tuple(r[1:]) for r in near_dedup.near_duplicates(x, k=4, bands=64, rows=4).collect()}
    assert got == brute_components(texts, 4)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    x = T.mix(rng.integers(1, 1 << 62, 1000).astype(np.uint64))
    a, b = near_dedup.signature(x[:900], 512), near_dedup.signature(x[100:], 512)
    assert abs((a == b).mean() - 0.8) < 0.08
    assert len(near_dedup.signature(x[:1], 512)) == 512  # one shingle fills every bin


def brute_windows(texts, window=50):
    first = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j:j + window]), i)
    out = {}
    for i, t in enumerate(texts):
        w = (t or "").encode().split()
        gone = set()
        for j in range(len(w) - window + 1):
            if first[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), kept.decode())
    return out


@pytest.mark.parametrize("pairwise", [1, 48])
def test_substring_dedup(docs, texts, pairwise):
    """With pairwise = 1 every seed that several contexts share is grown to the window."""
    got = {r[0]: tuple(r[1:]) for r in substring_dedup.dedup(docs, pairwise=pairwise).collect()}
    assert got == brute_windows(texts)


def test_substring_dedup_ties(spark, nothing):
    text = " ".join(f"w{i}" for i in range(60))
    x = spark.createDataFrame([(4, text), (4, text), (None, text), (5, text)], "doc_id bigint, text string")
    got = sorted(substring_dedup.dedup(x).select("doc_id", "n_removed").collect(), key=str)
    assert got == sorted([(4, 0), (4, 0), (None, 60), (5, 60)], key=str)
    assert substring_dedup.dedup(nothing).count() == 0


def brute_bytes(texts, window):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for r in raws:
        for j in range(len(r) - window + 1):
            seen[r[j:j + window]] = seen.get(r[j:j + window], 0) + 1
    out = {}
    for i, r in enumerate(raws):
        gone = np.zeros(len(r) + 1, dtype=bool)
        for j in range(len(r) - window + 1):
            if seen[r[j:j + window]] > 1:
                gone[j:j + window] = True
        runs = int(np.count_nonzero(gone[:-1] & ~np.concatenate([[False], gone[:-2]]))) if len(r) else 0
        out[i] = (len(r), runs, bytes(b for b, g in zip(r, gone, strict=False) if not g))
    return out


@pytest.mark.parametrize(("window", "hot", "shard_bytes", "hot_core"),
                         [(200, 512, 1 << 20, 4096), (60, 1, 1 << 20, 4096), (80, 1, 1 << 20, 1), (100, 512, 3000, 4096)])
def test_suffix_dedup(docs, texts, window, hot, shard_bytes, hot_core):
    """hot = 1 deals every shared window by its core, hot_core = 1 by its content; small shards cut the corpus in many."""
    x = suffix_dedup.dedup(docs, window=window, hot=hot, shard_bytes=shard_bytes, hot_core=hot_core)
    got = {r["doc_id"]: (r["n_bytes"], r["n_spans"], bytes(r["kept"])) for r in x.collect()}
    assert got == brute_bytes(texts, window)
    assert {f.name for f in x.schema["rest"].dataType} >= {"spans", "th", "key", "row"}


def test_suffix_dedup_repeated_rows(spark, nothing):
    text = "".join(chr(97 + i * i % 26) for i in range(300))
    x = spark.createDataFrame([(1, text), (1, text), (None, "é" * 150), (2, "short")], "doc_id bigint, text string")
    got = sorted(suffix_dedup.dedup(x).select("doc_id", "kept_text").collect(), key=str)
    assert got == sorted([(1, ""), (1, ""), (None, ""), (2, "short")], key=str)
    assert suffix_dedup.dedup(nothing).count() == 0
    alone = suffix_dedup.dedup(x.select("text", "doc_id")).select("doc_id", "n_bytes")
    assert sorted(map(tuple, alone.collect()), key=str) == sorted([(1, len(text.encode()))] * 2 + [(None, 300), (2, 5)], key=str)


def test_very_long_texts_in_pieces(texts, monkeypatch):
    """With a low limit the long texts are worked on in pieces; hashes and windows stay the same."""
    from seqpool.llm import anchors

    monkeypatch.setattr(T, "LONG_BYTES", 4000)
    raw = [t.encode() for t in texts if t and len(t) > 9000]
    for r in raw:
        data = np.frombuffer(r, dtype=np.uint8)
        hashes, starts = T.word_hashes(data, np.array([0, len(data)]))
        whole = T.span_hashes(T.byte_values()[data], *T.words(data, np.array([0, len(data)])))
        assert starts[1] == len(whole) and (hashes == whole).all()
        for unit, window, k in (("bytes", 200, 32), ("words", 50, 8)):
            n = len(data) if unit == "bytes" else len(whole)
            seen = []
            for shift, values, begin in anchors._long_pieces(unit, data, window):
                t, f, e, _, _ = T.anchor_runs(values, begin, window, k)
                seen += [i + shift for a, b in zip(f, e, strict=True) for i in range(a, b + 1)]
            assert sorted(seen) == list(range(n - window + 1))
    assert raw


@pytest.mark.parametrize("seed", range(40))
def test_induced_sort_with_disk_queues(tmp_path, monkeypatch, seed):
    import pyarrow.fs as pafs

    rng = np.random.default_rng(seed)
    n, symbols = int(rng.integers(1, 250)), int(rng.choice([2, 4, 30]))
    x = rng.integers(1, symbols + 1, n)
    if seed % 3 == 0 and n > 60:
        x[30:58] = x[:28]
    if seed % 5 == 0:
        x = np.repeat(x[: n // 7 + 1], 7)[:n]
    text, depth = np.append(x, 0), int(rng.integers(3, 40))
    monkeypatch.setattr(induced_sort, "BLOCK", int(rng.choice([4, 64])))
    monkeypatch.setattr(induced_sort, "RECURSION_SYMBOLS", int(rng.choice([0, 5000])))
    out = []
    space = (pafs.LocalFileSystem(), str(tmp_path), int(rng.choice([8, 1 << 20])))
    induced_sort.sorted_suffixes(text, symbols + 1, depth, lambda p, v: out.append((p, v)), space)
    order = np.concatenate([p for p, _ in out]).tolist()
    prefix = np.concatenate([v for _, v in out]).tolist()
    t = text.tolist()
    assert sorted(order) == list(range(len(t)))
    for i in range(1, len(order)):
        a, b = order[i], order[i - 1]
        assert t[a:a + depth] <= t[b:b + depth]
        k = 0
        while k < depth and max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        assert prefix[i] == k
    assert not list(tmp_path.iterdir())


@pytest.mark.parametrize("seed", range(10))
def test_anchor_runs_cover_every_window_once(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 120, 6)
    values = rng.integers(0, 2 if seed % 2 else 40, sizes.sum()).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    anchors, seen = {}, []
    for t, f, e, p, a in zip(*T.anchor_runs(T.mix(values + np.uint64(9)), starts, 20, 5), strict=True):
        for i in range(f, e + 1):
            w = tuple(values[starts[t] + i: starts[t] + i + 20])
            assert anchors.setdefault(w, (a, p - i)) == (a, p - i)
            seen.append((t, i))
    assert sorted(seen) == [(t, i) for t, n in enumerate(sizes) for i in range(max(0, n - 19))]


def test_fingerprints(docs, texts, nothing):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(docs).collect()}
    n = len(texts)
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i - 1) % n] or ""
        half = len(t) // 2
        assert rows[i]["n_chars"] == len(t)
        assert rows[i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert rows[i]["next_fp"] == rows[(i - 1) % n]["fp"]
    assert rows[9]["fp"] == rows[10]["fp"] == rows[11]["fp"]
    assert rows[0]["fp"] == rows[1]["fp"] == 0
    assert fingerprints.fingerprint_documents(nothing).count() == 0


def test_fingerprints_by_hand(spark):
    """Votes of the words of one text, counted one by one."""
    text = "some words some longerwords x words"
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(w,) for w in set(text.split())], "w string").select(
        "w", F.xxhash64("w")).collect()}
    votes = [0] * 64
    for w in text.split():
        weight = min(16, max(1, len(w) - 2))
        for i in range(64):
            votes[i] += weight if hashes[w] >> i & 1 else -weight
    expected = sum(1 << i for i in range(64) if votes[i] > 0)
    x = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = fingerprints.fingerprint_documents(x).select(fingerprints.as_hex(F.col("fp"))).first()[0]
    assert int(got, 16) == expected


@pytest.mark.parametrize("ids", [[5, 7, 1 << 40, (1 << 62) + 3, -9, 0], [None, 3, 300, 70000, 3], [4]])
def test_successors_of_sparse_null_and_repeated_ids(spark, ids):
    x = spark.createDataFrame([(i, f"text {n} of {i}") for n, i in enumerate(ids)], "doc_id bigint, text string")
    rows = [tuple(r) for r in x.select("doc_id", "text", F.xxhash64("text")).collect()]
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[2]))
    got = {(r["doc_id"], r["text"]): r["edited"] for r in fingerprints.edited_documents(x).collect()}
    for i, (d, t, _) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        assert got[(d, t)] == t[: len(t) - len(t) // 2] + after[: len(t) // 2]


def test_hamming_search(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    near = [b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(6))) for b in base for _ in range(4)]
    every = sorted({x - (1 << 64) if x >> 63 else x for x in base + near})
    index = spark.createDataFrame([(x,) for x in every], "fp bigint")
    queries = index.where("fp % 3 = 0")
    got = {(r["query"], r["fp"], r["distance"]) for r in fingerprints.near_fingerprints(queries, index).collect()}
    asked = [r[0] for r in queries.collect()]
    mask = (1 << 64) - 1
    expected = {(q, x, bin((q ^ x) & mask).count("1")) for q in asked for x in every if bin((q ^ x) & mask).count("1") <= 3}
    assert got == expected


ITEM = ("Marta bought 12 apples and 7 pears for 30 dollars at the market near Lisbon. Then she sold 5 apples to Peter "
        "for 3 dollars each and kept the other fruit. How many apples does she have now?")
OTHER = ("Rosa bought 44 apples and 9 pears for 80 euros at the market near Madrid. Then she sold 6 apples to Oscar "
         "for 8 euros each and kept the other fruit. How many apples does she have now?")


def test_decontamination(spark):
    rng = random.Random(1)
    plain = " ".join(words(rng, 300))
    mixed = OTHER.replace("sold 6", "sold 44").replace("Oscar", "Madrid").replace("8 euros", "44 euros")
    docs = spark.createDataFrame([
        (1, f"{plain} {ITEM} {plain}", "x"), (2, f"{plain} {OTHER} {plain}", "x"), (3, plain, "x"), (4, None, "x"), (5, "", "x"),
        (6, ITEM[: len(ITEM) // 3] + " " + plain, "x"), (7, "short text", "x"), (8, f"{plain}. {ITEM.lower()}", "x"),
        (1, f"{plain} {ITEM} {plain}", "x"), (None, ITEM, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(70, ITEM), (71, "Short text"), (72, None), (73, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, items).collect()}
    assert {k for k in got if k[0] != 8} == {(1, 70), (2, 70), (7, 71), (None, 70)}
    assert got[(1, 70)]["consistency"] == 1.0 and got[(2, 70)]["n_slots"] > 0
    assert not got[(2, 70)]["verbatim"]
    assert mixed != OTHER
    empty = docs.where("false")
    assert decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(docs, items.where("false")).count() == 0


def test_slots_must_be_consistent():
    def pair(i, a, b):
        return {"pos": i, "item_pos": i, "slots": [b], "item_slots": [a]}

    steady = [pair(i, "1five", "1nine") for i in range(10)]
    changing = [pair(i, "1five", f"1x{i}") for i in range(10)]
    assert decontamination.best_match(steady, 10, 14)[2] == 1.0
    assert decontamination.best_match(changing, 10, 14)[2] == 0.1


REPEATED = "A shop sells 12 red marbles on Monday, 15 red marbles on Tuesday and 9 red marbles on Sunday. How many in all?"


def test_item_that_repeats_a_template(spark):
    """Windows of one template vote along the alignment only, so a copy is consistent with itself."""
    rng = random.Random(2)
    plain = " ".join(words(rng, 60))
    other = REPEATED.replace("12", "31").replace("15", "42").replace("Tuesday", "Friday")
    docs = spark.createDataFrame([(1, f"{plain}. {REPEATED} {plain}"), (2, f"{plain}. {other} {plain}"),
                                  (3, f"{plain}. {other} {REPEATED}")], "doc_id bigint, text string")
    items = spark.createDataFrame([(70, REPEATED)], "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {1, 2, 3}
    assert got[1]["verbatim"] and got[1]["consistency"] == 1.0
    assert not got[2]["verbatim"] and got[2]["consistency"] == 1.0
    assert got[3]["verbatim"]


def test_votes_follow_the_longest_chain():
    def pair(pos, item_pos):
        return {"pos": pos, "item_pos": item_pos, "slots": [f"1{pos}"], "item_slots": [f"1{item_pos}"]}

    every = [pair(a, b) for a in range(6) for b in range(6)]  # one template throughout: only the diagonal is an alignment
    assert decontamination.best_match(every, 6, 11) == (6, 6, 1.0, True)
    moved = [pair(a, a) for a in range(3)] + [pair(a + 4, a) for a in range(3, 6)]  # words put in between
    assert [p["item_pos"] for p in decontamination.longest_chain(moved)] == [5, 4, 3, 2, 1, 0]


STOPPED = "The dog ran home. It was late. Nobody saw the cat. They all went to bed."


def test_copies_without_capitals_or_stops(spark):
    rng = random.Random(1)
    plain = " ".join(words(rng, 300))
    bare = STOPPED.replace(".", "")
    docs = spark.createDataFrame([(8, f"{plain}. {ITEM.lower()}"), (9, f"{ITEM.upper()} {plain}"), (10, f"{plain} {bare} {plain}"),
                                  (11, plain)], "doc_id bigint, text string")
    items = spark.createDataFrame([(70, ITEM), (71, STOPPED)], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {(8, 70), (9, 70), (10, 71)}
    assert all(r["verbatim"] and r["consistency"] == 1.0 and r["n_matched"] == r["n_windows"] for r in got.values())


def test_dense_slots_opening_names_and_short_items(spark):
    rng = random.Random(4)
    plain = " ".join(words(rng, 60))
    sums, fruits = "What is 12 plus 15 plus 20?", "Tom has 5 apples. Ann has 7 pears. How many fruits do they have?"
    other = fruits.replace("Tom", "Bob").replace("Ann", "Eve").replace("5", "8").replace("7", "3")
    texts = ["What is 31 plus 42 plus 53?", f"{plain}. What is 31 plus 42 plus 53? {plain}", f"{plain}. {other} {plain}",
             f"{plain} Count 12 big apples {plain}", f"{plain}. Count 9 big apples. Count 9 big apples. {plain}",
             f"{plain} PARIS {plain} paris", ITEM.lower().replace("12", "14").replace("30", "39").replace("5 apples", "8 apples"),
             f"What is 31 plus 42 minus 53? {plain}", f"{plain} 1 2 3 4 5 6 {plain}", "1 2 3 4 5 7"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    items = spark.createDataFrame([(70, sums), (71, fruits), (72, "Count 12 big apples"), (73, "Paris"), (74, ITEM), (75, "1 2 3 4 5 6")],
                                  "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {(0, 70), (1, 70), (2, 71), (3, 72), (4, 72), (5, 73), (6, 74), (8, 75)}
    assert all(r["consistency"] == 1.0 and r["n_matched"] == r["n_windows"] for r in got.values())
    assert {k for k in got if got[k]["verbatim"]} == {(3, 72), (5, 73), (8, 75)}


def test_template_windows_by_hand():
    """Windows of every start and end over random kinds of words, counted one by one."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        sizes = rng.integers(0, 14, 5)
        kinds, first = (rng.random(sizes.sum()) < 0.5).astype(np.int8), np.concatenate([[0], np.cumsum(sizes)])
        right, left = [], []
        for lo, hi in zip(first[:-1], first[1:], strict=True):
            for i in range(lo, hi):
                right += [(i, e) for e in range(i + 5, hi + 1) if (kinds[i:e] == 0).sum() >= 3][:1]
                left += [(b, i + 1) for b in range(i - 4, lo - 1, -1) if (kinds[b:i + 1] == 0).sum() >= 3][:1]
        starts, ends, begins, stops = decontamination.template_spans(kinds, first)
        assert list(zip(starts, ends, strict=True)) == right
        assert list(zip(begins, stops, strict=True)) == [x for x in left if x[1] - x[0] > 5]
