"""URL filter, WARC, HTML text, packing, toxicity and the pipeline."""

import base64
import hashlib
import random
import time
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from seqpool.llm import html_text, packing, queries, toxicity, url_filter, warc

SMALL = "/root/testdata/sf0.001"


# URL filter -----------------------------------------------------------------------------------------

URLS = [
    (1, "https://Shop.Example.NET/en/a/12?x=1", "shop.example.net", "/en/a/12", "example.net/en/", "allow"),
    (2, "http://example.net/de/", "example.net", "/de/", "net/", "block"),
    (3, "http://example.com/de/x#y", "example.com", "/de/x", "example.com/de/", "block"),
    (4, "http://notexample.com/de/x", "notexample.com", "/de/x", None, None),
    (5, "ftp://a.org/fr/", "a.org", "/fr/", "org/fr/", "allow"),
    (6, "http://a.org?u=/fr/", "a.org", "", None, None),
    (7, "no scheme", "", "", None, "allow"),
    (8, None, "", "", None, "allow"),
    (9, "", "", "", None, "allow"),
    (10, "x://ÄB.net", "Äb.net", "", None, None),
    (11, "x://b.net/" + "p/" * 3000, "b.net", "/" + "p/" * 3000, "net/", "block"),
    (1, "http://example.net/de/", "example.net", "/de/", "net/", "block"),
]


def test_url_rules(spark):
    x = spark.createDataFrame([(i, u, "h", "t") for i, u, *_ in URLS], "page_id bigint, url string, host string, tokens string")
    got = sorted(url_filter.filter_urls(x, queries.URL_RULES, min_support=0.3).collect(), key=lambda r: (r["page_id"], r["host"]))
    assert len(got) == len(URLS)
    for r, (i, _, host, path, rule, verdict) in zip(got, sorted(URLS, key=lambda u: (u[0], u[2])), strict=True):
        assert (r["page_id"], r["host"], r["path"]) == (i, host, path)
        if i == 10:
            continue
        assert r["rule"] == rule
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)
    assert url_filter.filter_urls(x.where("false"), queries.URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(x.where("page_id in (4, 6)"), queries.URL_RULES).collect()} == {"allow"}


def test_labels_decide_where_no_rule_does(spark):
    """Hosts of one kind are labelled block; a page of such a host without a label is blocked, others are not."""
    rows = [(i, f"https://{'spam' if i % 4 == 0 else 'good'}{i % 3}.x{i % 5}.info/a/{i}") for i in range(80)]
    rows += [(200, "https://spam0.x0.info/b/1"), (201, "https://good1.x1.info/b/1"), (202, "https://spam0.net/en/1")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    labels = spark.createDataFrame([(i, "block" if i % 4 == 0 else "allow") for i in range(80)] + [(3, "allow"), (5, "odd")], "page_id bigint, label string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, queries.URL_RULES, labels, min_support=0.02).collect()}
    assert got[200]["verdict"] == "block" and got[200]["mined_rule"] and got[200]["rule"] is None
    assert got[201]["verdict"] == "allow"
    assert got[202]["rule"] == "net/" and got[202]["mined_rule"] is None
    assert all(got[i]["verdict"] == ("block" if i % 4 == 0 else "allow") for i in range(80))


def test_mined_rules_are_those_of_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(200):
        tokens = sorted({f"t{rng.randrange(7)}" for _ in range(4)})
        rows.append((tokens, "block" if ("t1" in tokens and "t2" in tokens) or rng.random() < 0.1 else "allow"))
    got = {(tuple(r["antecedent"]), r["verdict"]): (round(r["confidence"], 9), round(r["support"], 9), r["token"])
           for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.8).collect()}
    single = Counter(t for tokens, _ in rows for t in tokens)
    expected = {}
    for n in range(1, 5):
        for items in combinations([f"t{i}" for i in range(7)], n):
            holds = [v for tokens, v in rows if set(items) <= set(tokens)]
            for verdict in ("block", "allow"):
                both = holds.count(verdict)
                if both >= 0.05 * len(rows) and both / len(holds) >= 0.8:
                    rarest = min(items, key=lambda t: (single[t], t))
                    expected[(items, verdict)] = (round(both / len(holds), 9), round(both / len(rows), 9), rarest)
    assert got == expected


# WARC -----------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/", "<p>same</p>"), (5, "http://b/ c\r\n", "<p>same</p>"), (3, None, "<p>other é</p>"), (4, "u", None),
         (9, "u", ""), (2, "u", "x" * 300_000), (5, "http://b/ c\r\n", "<p>same</p>"), (None, "u", "<p>same</p>"), (None, "v", "alone")]


@pytest.mark.parametrize(("min_bytes", "revisits"), [(0, {(1, 5), (None, 5), (4, 9)}), (5, {(1, 5), (None, 5)})])
def test_warc_round_trip(spark, min_bytes, revisits):
    x = spark.createDataFrame([(*p, "o", "f") for p in PAGES], "page_id bigint, url string, html string, offset string, file string")
    folder, index = warc.write_archives(x.repartition(3), min_bytes=min_bytes)
    got = warc.read_records(folder, index).collect()
    assert len(got) == len(PAGES)
    want = Counter((i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()) for i, _, h in PAGES)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in got) == want
    assert {(r["page_id"], r["refers_to"]) for r in got if r["record_type"] == "revisit"} == revisits
    by_id = {r["page_id"]: r for r in got if r["record_type"] == "response"}
    assert bytes(by_id[3]["payload"]).decode() == "<p>other é</p>" and by_id[3]["url"] is None
    assert len(by_id[2]["payload"]) == 300_000
    assert by_id[5]["url"] == "http://b/%20c%0D%0A"
    some = warc.read_records(folder, index.where("page_id in (2, 3)"), with_payload=False)
    assert {r["page_id"] for r in some.collect()} == {2, 3}


def test_warc_files_are_whole_gzip_archives(spark):
    x = spark.createDataFrame(PAGES[:6], "page_id bigint, url string, html string").coalesce(1)
    folder, index = warc.write_archives(x)
    fs, root = pafs.FileSystem.from_uri(folder)
    raw = b""
    for name in {r["file"] for r in index.collect()}:
        data = fs.open_input_file(f"{root}/{name}").read()
        while data:  # member after member, as any reader does
            d = zlib.decompressobj(31)
            raw += d.decompress(data)
            data = d.unused_data
    assert raw.count(b"WARC/1.1\r\n") == 6
    assert warc.read_records(*warc.write_archives(x.where("false"))).count() == 0


def test_ids_above_the_integers_of_floats(spark):
    big = (1 << 53) + 1
    page = f"<article><p>{LONG}</p></article>"
    rows = [(big, "u", page), (big + 2, "v", page), (None, "w", page), ((1 << 62) + 1, "x", "<p>other"), (-big, "y", None), (3, "z", "")]
    x = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    folder, index = warc.write_archives(x)
    assert {r["page_id"] for r in index.collect()} == {r[0] for r in rows}
    got = {r["url"]: (r["page_id"], r["refers_to"]) for r in warc.read_records(folder, index).collect()}
    assert got == {"u": (big, big + 2), "v": (big + 2, None), "w": (None, big + 2), "x": ((1 << 62) + 1, None), "y": (-big, 3), "z": (3, None)}
    assert {(r["page_id"], r["url"]) for r in html_text.extract(x).collect()} == {r[:2] for r in rows}


def test_warc_finds_a_broken_payload():
    member = zlib.compress(b"")
    record = warc.make_record(1, "u", b"abc", warc.base32_sha1(b"abd"))
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    member = packer.compress(record) + packer.flush()
    with pytest.raises(ValueError):
        warc.parse_record(member)


# HTML -----------------------------------------------------------------------------------------------

LONG = "A sentence of the main text that is long enough to count as such, with some words more in it."


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
    ("<article><h1>Title &amp; more</h1><p>One\n  two&nbsp;three<br>four</p><p>Short.</p></article>", "Title & more\nOne two three four\nShort."),
    (f"<nav><a href=/>Home</a></nav><article><p>{LONG}</article><footer><p>&copy; {LONG}</footer>", LONG),
    ("<article><p>a <b>bold</b>er <i>word<p>b</article>", "a bolder word\nb"),
    ("<article><p>x</p><div class='ad box'>Buy</div><aside>more</aside><p>y</p><section id=comments><p>Nice!</section></article>", "x\ny"),
    ("<article><p>x</p><form><label>Mail</label><input></form><script>if (a<b) '</p>'</script><style>p{}</style><p>y &lt;z&gt;</article>", "x\ny <z>"),
    (f"<div class=menu><a>one</a></div><div id=content class='with-sidebar'><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><div class=sidebar>{LONG}</div>",
     f"{LONG}\nShort.\n{LONG}"),
    (f"<ul><li><a href=1>{LONG}</a></li></ul><p>{LONG}</p>", LONG),
    ("<article><p>cut off in a <a href='x", "cut off in a"),
    (f"<nav><ul><li><a>h</a><article><p>{LONG}</p></article>", LONG),
    (f"<aside><article><p>{LONG}</p></article></aside><article><p>z</p></article>", "z"),
    ("<main><p>if a < b and c > d</p><!-- <p>no</p> --></main>", "if a < b and c > d"),
    ("<article><header class=post-header><h1>T</h1></header><ul><li>1<li>2</ul><table><tr><td>c1<td>c2</table><pre>k  l\nm</pre></article>",
     "T\n1\n2\nc1\nc2\nk l m"),
    ("<div><p>A short note.</p><p>Two.</p></div>", "A short note.\nTwo."),
    ("<div role=dialog>Cookies!</div><article><div class='cookie-notice'>ok?</div><p hidden>h</p><p>z</p></article>", "z"),
])
def test_main_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(("page", "text"), [
    (f"<!doctype html><html><head><title>x</title><body><article><p>{LONG}</article>", LONG),
    (f"<html><head><meta charset=utf-8><title>x</title><link href=a><script>b</script><p>{LONG}<p>{LONG}", f"{LONG}\n{LONG}"),
    (f"<html><head><title>x</title><noscript><link href=a></noscript><div class=menu><a>m</a></div><main><p>{LONG}</main>", LONG),
    (f"<head><title>x</title><noscript><link href=a><body><p>{LONG}", LONG),
    (f"<head><title>x</title>\n{LONG}", LONG),
    (f"<head><title>x</title></head><noscript>Turn it on<body><p>{LONG}", LONG),
    (f"<head><title>x</title><noscript>Turn it on</noscript></head><p>{LONG}", LONG),
    *[(f"<body><{tag}>menu<article><p>{LONG}</p></article>", LONG)
      for tag in ("aside", "button", "select", "noscript", "menu", "footer", "dialog", "div class=sidebar")],
    (f"<aside>menu<article><p>{LONG}</p><aside>note</aside></article>", LONG),
    (f"<aside>menu<article><p>{LONG}</p></article></aside><p>{LONG} z</p>", f"{LONG} z"),
])
def test_main_text_without_optional_or_forgotten_end_tags(page, text):
    assert html_text.main_text(page) == text


def test_html_table(spark):
    page = f"<article><p>{LONG}</p></article>"
    x = spark.createDataFrame([(1, "u", page, "t"), (1, "u", page, "t"), (None, None, None, "t"), (2, "v", "<p>" * 50_000, "t")],
                              "page_id bigint, url string, html string, text string")
    got = sorted(html_text.extract(x).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, "u", LONG), (1, "u", LONG), (None, None, ""), (2, "v", "")], key=str)
    assert html_text.extract(x.where("false")).count() == 0


def test_article_keeps_parts_whose_class_only_holds_a_dropped_word():
    page = """<article><p>first</p><div class="social-history"><p>second</p></div><section class="related-work">third</section>
    <pre class="comment">fourth</pre><div class="related-posts">no</div><div id="comment-list"><p>no</p></div></article>"""
    assert html_text.main_text(page) == "first\nsecond\nthird\nfourth"


def test_end_tags_without_a_start_cost_nothing():
    start = time.perf_counter()
    html_text.main_text("<b>" * 100_000 + "</i>" * 100_000 + "text")
    assert time.perf_counter() - start < 20  # the walk of the whole stack took minutes


# packing --------------------------------------------------------------------------------------------

def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    encode = packing.encoder(packing.tokenizer_path())
    odd = ["", " ", "plain words, it's", "é漢字😀 ́e", "\x85a\x1cb\u00a0 c\u2028d\ufeffg", "<|endoftext|>", "a<|endoftext|> b", "١٢٣ ²½",
           "\r\n\r\n  x\t\ty ", "a" * 5000, "!?" * 3000, "\x00\x01"]
    rng = random.Random(8)
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 800), rng.randrange(0x4e00, 0x4f00), 32, 10]))
                    for _ in range(200)) for _ in range(30)]
    for t in odd:
        assert encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t[:20])


def test_packing_holds_every_token_once(spark):
    rng = random.Random(2)
    texts = [None, "", "word"] + [" ".join(rng.choice(["some", "words", "über", "x1"]) for _ in range(rng.randrange(1, 900))) for _ in range(60)]
    rows = [(i % 50, t, "p", 1) for i, t in enumerate(texts)] + [(None, "no id", "p", 1)]
    x = spark.createDataFrame(rows, "doc_id bigint, text string, piece string, length int").repartition(4)
    got = packing.pack_documents(x, capacity=256, with_ids=True).collect()
    encode = packing.encoder(packing.tokenizer_path())
    want = Counter()
    for i, t, *_ in rows:
        ids = [*encode(t or "").tolist(), 0]
        head = len(ids) % 256
        cuts = [c for c in [0, *range(head, len(ids), 256)] if c < len(ids)]
        cuts = sorted(set(cuts))
        for n, a in enumerate(cuts):
            own = ids[a: cuts[n + 1] if n + 1 < len(cuts) else len(ids)]
            want[(i, n, a, len(own), zlib.crc32(np.array(own, dtype="<u4").tobytes()), tuple(own))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(places) <= 1.05 * -(-total // 256) + 1
    assert packing.pack_documents(x.where("false")).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_takes_each_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 100, 400])
    top = capacity if seed % 2 else capacity // 3
    histogram = {k: rng.randrange(1, 500) for k in rng.sample(range(1, capacity + 1), min(capacity, 40)) if k <= top or seed % 2} or {1: 5}
    plan = packing.make_plan(histogram, capacity)
    used = Counter()
    for config, times in plan:
        assert times > 0 and sum(k * a for k, a in config.items()) <= capacity
        for k, a in config.items():
            used[k] += a * times
    assert used == Counter(histogram)
    alone = sum(times for _, times in packing.best_fit(histogram, capacity))
    assert sum(times for _, times in plan) <= alone
    ranges = {}
    for k, lo, hi, *_ in packing.plan_rows(plan):
        ranges.setdefault(k, []).append((lo, hi))
    for k, spans in ranges.items():
        at = 0
        for lo, hi in sorted(spans):
            assert lo == at
            at = hi
        assert at == histogram[k]


def test_price_is_the_best_configuration():
    lengths, weights = np.array([3, 4, 5]), np.array([3.0, 4.5, 5.0])
    assert packing.price(lengths, weights, 12) == Counter({4: 3})
    assert packing.price(np.array([7]), np.array([7.0]), 6) == Counter()


def test_program_places_nearly_all_pieces():
    """The program, not best fit, makes the plan: over 0.9 of the pieces, within a thousandth of the bound."""
    drawn = np.random.default_rng(1).lognormal(5.3, 1.1, 200_000).astype(int) + 1
    histogram = Counter((drawn[drawn < 2048]).tolist())
    start = time.perf_counter()
    solved = packing.solve_program(histogram, 2048)
    assert time.perf_counter() - start < 60
    placed = sum(times * sum(config.values()) for config, times in solved)
    assert placed > 0.9 * histogram.total()
    bound = -(-sum(k * n for k, n in histogram.items()) // 2048)
    plan = packing.make_plan(histogram, 2048)
    assert sum(times for _, times in plan) <= 1.001 * bound
    assert packing.solve_program({}, 2048) == []
    [(config, times)] = packing.solve_program({1500: 1000}, 2048)
    assert config == Counter({1500: 1}) and 950 <= times <= 1000


# toxicity -------------------------------------------------------------------------------------------

def labelled(n, rng):
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        w = [rng.choice(["the", "and", "house", "tree", "walks", "green", "Word", "other"]) for _ in range(rng.randrange(8, 60))]
        if toxic:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "zorgblat", "zorgfeet", "you"]))
            w.insert(0, rng.choice(["zorgblat", "moron"]))
        rows.append((i, " ".join(w), int(toxic), "g"))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(800, random.Random(6))
    docs = spark.createDataFrame([(i, t, g) for i, t, _, g in rows] + [(None, None, "g"), (9000, "", "g"), (0, rows[0][1], "g")],
                                 "doc_id bigint, text string, features string")
    labels = spark.createDataFrame([(i, y) for i, _, y, _ in rows] + [(None, 1), (0, None)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, labels, F.col("doc_id") % 5 != 0).select("row.doc_id", "row.features", "score").collect()
    assert len(got) == 803 and all(0 <= r["score"] <= 1 and r["features"] == "g" for r in got)
    held = [(r["score"], rows[r["doc_id"]][2]) for r in got if r["doc_id"] is not None and r["doc_id"] < 800 and r["doc_id"] % 5 == 0]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held]) > 0.95
    same = [r["score"] for r in got if r["doc_id"] == 0]
    assert len(same) == 2 and same[0] == same[1]


def test_toxicity_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, toxic int")
    none = toxicity.score_documents(docs, labels.where("false"), F.lit(True)).collect()
    assert [r["score"] for r in none] == [0.0, 0.0]
    one = toxicity.score_documents(docs, labels, F.lit(True)).collect()
    assert all(0 < r["score"] < 0.5 for r in one)
    assert toxicity.score_documents(docs.where("false"), labels, F.lit(True)).count() == 0


def test_features_of_one_text():
    f = dict(zip(toxicity.FEATURES, toxicity.features_of("YOU idiot! y0u m0ron, ok?", {"^idi": 2.0}), strict=True))
    assert f["general_any"] == 1 and f["learned_any"] == 1 and f["masked_hits"] == 1 and f["near_second"] > 0
    assert set(toxicity.features_of(None, {})) == {0.0}
    assert dict(zip(["a"], [toxicity.word_keys("abc")], strict=True))["a"] == ["abc"]


# queries and pipeline -------------------------------------------------------------------------------

def test_every_query_reads_its_whole_table(spark):
    n_docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    n_pages = spark.read.parquet(f"{SMALL}/pages.parquet").count()
    for name in ("op7_fingerprints", "op9_substring_dedup"):
        assert queries.QUERIES[name](spark, SMALL).count() == n_docs
    for name in ("op3_url_filter", "op10_html_text"):
        assert queries.QUERIES[name](spark, SMALL).count() == n_pages


def test_pipeline_stages(spark):
    """Each stage on its own input: what it drops, and that the columns stay."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    text = " ".join(f"w{i}" for i in range(80))
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first()["text"]
    extra = spark.createDataFrame([(10_001, text, "en", "s", 1), (10_002, text + " w80", "en", "s", 1), (10_003, f"Before it. {item}", "en", "s", 1),
                                   (10_003, f"Before it. {item}", "en", "s", 1), (10_004, None, None, None, None)], docs.schema)
    x = docs.unionByName(extra)
    near = corpus_pipeline.drop_near_duplicates(spark, x, SMALL)
    assert near.columns == columns
    ids = Counter(r["doc_id"] for r in near.select("doc_id").collect())
    assert ids[10_001] == 1 and ids[10_002] == 0 and ids[10_004] == 1 and max(ids.values()) == 1
    clean = corpus_pipeline.drop_contaminated(spark, x, SMALL)
    assert clean.columns == columns
    left = {r["doc_id"] for r in clean.select("doc_id").collect()}
    assert 10_003 not in left and {10_001, 10_002, 10_004} <= left
    cut = corpus_pipeline.drop_repeats(spark, x, SMALL)
    assert cut.columns == columns and cut.count() == x.count()
    by_id = {r["doc_id"]: r for r in cut.collect()}
    assert by_id[10_001]["text"] == "" and by_id[10_002]["n_chars"] == len(by_id[10_002]["text"]) < 200
    mild = corpus_pipeline.drop_toxic(spark, x, SMALL)
    assert mild.columns == columns and mild.count() > 0.7 * x.count()


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_dedup", "decontamination", "packing"]


def test_calibration_curves_of_many_edges(spark):
    rng = np.random.default_rng(3)
    edges, values = np.sort(rng.random(1000)), np.sort(rng.random(1000))
    points = [-1.0, 2.0, *edges[:5].tolist(), float(edges[-1]), *rng.random(50).tolist()]
    rows = spark.createDataFrame([(p,) for p in points], "x double")
    got = [r["y"] for r in rows.select(toxicity.interpolate(F.col("x"), edges, values).alias("y")).collect()]
    assert np.allclose(got, np.interp(points, edges, values), atol=1e-12)
    flat = rows.select(toxicity.interpolate(F.col("x"), [0.5], [0.25]).alias("y")).distinct().collect()
    assert [r["y"] for r in flat] == [0.25]
