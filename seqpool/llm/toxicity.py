"""Toxicity classifier: gradient-boosted trees over dense lexical features, calibrated by isotonic regression.

Features of a whole text: densities of a general lexicon and of a lexicon learned from the labels
(words, and beginnings and endings of words, by the
log-odds of their document frequencies), second person near lexicon words, capitals, punctuation and
obfuscated spellings.  Lexicon and trees are fitted on at most ``MAX_TRAIN`` labelled rows, chosen
by a hash of the id (documented bound); the features and scores cover every row.

Defined results: null and empty texts have zero features and get the model's score for them;
repeated rows score alike; a null doc_id is never a training row; with no labels, or one class
only, every score is the (smoothed) share of positive labels.  Ties of the calibrated score keep the
order of the raw score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from seqpool.llm.common import written

MAX_TRAIN = 20_000  # labelled rows that a fit takes at most
LEXICON_SIZE = 64  # learned words
MIN_DOCS = 5  # labelled documents a learned word must stand in
CERTAINTY = 2.0  # standard errors below the log-odds
AFFIX_MIN_WORD, PREFIXES, SUFFIXES = 5, (3, 4, 5), (3, 4)  # lexicon keys besides whole words
NEAR_WORDS = 5  # second person counts within so many words of a lexicon word
MEMO_WORDS = 200_000  # words a task remembers
RAW_SHARE = 0.001  # of the raw score in the final one: keeps order within the steps of the calibration
CALIBRATION_SHARE = 5  # one labelled row in so many calibrates

# A general lexicon, second-person words and look-alike signs.
LEXICON = """idiot idiots moron morons stupid dumb trash garbage scum loser losers pathetic worthless disgusting clown
clowns fool fools ugly filthy vile hate hateful kill die shut hell damn crap bastard jerk imbecile cretin degenerate
vermin parasite coward liar disgrace useless""".split()
SECOND_PERSON = set("""you your yours yourself yourselves u ur du dich dir dein ihr euch tu te toi ton vous votre tú ti usted
ustedes vosotros""".split())
LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": ""})

_WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*", re.UNICODE)
_MASKED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])(?=\S*[@$*0-9!])[\w@$*!]{3,}", re.UNICODE)
FEATURES = ["general", "general_any", "learned", "learned_any", "learned_weight", "learned_max", "near_second", "second",
            "capitals", "capital_words", "exclaims", "questions", "punctuation", "obfuscated", "masked_hits", "log_words"]


def features_of(text: str | None, learned: dict[str, float], memo: dict | None = None) -> list[float]:
    """The feature values of one text, in the order of ``FEATURES``; ``memo`` keeps what is known of words."""
    memo = {} if memo is None else memo
    text = text or ""
    low = text.lower()
    words = _WORDS.findall(low)
    n, chars = max(1, len(words)), max(1, len(text))
    general, hits = LEXICON_SET, []
    n_general = n_learned = 0
    weight = top = 0.0
    for i, w in enumerate(words):
        value = memo.get(w)
        if value is None:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            value = memo[w] = (w in general, max((learned.get(k, 0.0) for k in word_keys(w)), default=0.0))
        if value[0] or value[1]:
            hits.append(i)
            n_general += value[0]
            if value[1]:
                n_learned += 1
                weight += value[1]
                top = max(top, value[1])
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    near = 0
    if hits and second:
        s = np.asarray(second)
        h = np.asarray(hits)
        right = np.searchsorted(s, h + NEAR_WORDS, side="right")
        near = int(np.count_nonzero(right > np.searchsorted(s, h - NEAR_WORDS, side="left")))
    masked = [m[0] for m in _MASKED.finditer(low)] if any(c in low for c in "@$*!01345") else []
    spelled = [m.translate(LOOKALIKE) for m in masked]
    n_masked = sum(1 for m, x in zip(masked, spelled, strict=True) if x != m and (x in general or x in learned))
    upper = sum(map(str.isupper, text)) if text != low else 0
    capital_words = sum(1 for w in text.split() if len(w) > 2 and w.isupper()) if upper else 0
    marks = len(text) - sum(map(len, words)) - text.count(" ")
    return [n_general / n, float(n_general), n_learned / n, float(n_learned), weight / n, top, near / n, len(second) / n,
            upper / chars, capital_words / n, text.count("!") / chars, text.count("?") / chars, marks / chars,
            len(masked) / n, float(n_masked), float(np.log1p(len(words)))]


LEXICON_SET = frozenset(LEXICON)


def with_features(docs: DataFrame, learned: dict[str, float], key: str) -> DataFrame:
    """The column ``key`` and ``features`` (a vector) for every row of ``docs`` (key, text); texts are read batch by batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                values = np.array([features_of(t, learned, memo) for t in part.column("text").to_pylist()], dtype="float64")
                ends = pa.array(np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), pa.ListArray.from_arrays(ends, pa.array(values.ravel()))], [key, "values"])

    x = docs.select(key, "text")
    schema = StructType([x.schema[key], StructField("values", ArrayType(DoubleType()))])
    return x.mapInArrow(run, schema).select(key, array_to_vector("values").alias("features"))


def training_labels(labels: DataFrame, allowed: Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, label: at most ``max_train`` rows in the order of a hash; the largest label of a repeated id."""
    x = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & allowed)
    x = x.groupBy("doc_id").agg(F.max("toxic").cast("double").alias("label"))
    return x.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_train)


def word_keys(word: str) -> list[str]:
    """The lexicon keys of a word: itself and, for longer words, its beginnings and endings."""
    if len(word) < AFFIX_MIN_WORD:
        return [word]
    return [word, *(f"^{word[:k]}" for k in PREFIXES), *(f"{word[-k:]}$" for k in SUFFIXES)]


def _word_keys(word: Column) -> Column:
    affixes = [F.concat(F.lit("^"), F.substring(word, 1, k)) for k in PREFIXES]
    affixes += [F.concat(F.substring(word, -k, k), F.lit("$")) for k in SUFFIXES]
    return F.when(F.length(word) < AFFIX_MIN_WORD, F.array(word)).otherwise(F.array(word, *affixes))


def learn_lexicon(texts: DataFrame, size: int = LEXICON_SIZE, min_docs: int = MIN_DOCS) -> dict[str, float]:
    """The word keys that speak most surely for a toxic document; ``size`` of them reach the driver.

    Rows: text, label.  A key's weight is the lower confidence bound of its log-odds, so neither a
    rare key nor one that long documents merely tend to contain ranks high."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?U)[^\W_]+(?:['’][^\W_]+)*"), 0)
    keys = F.array_distinct(F.flatten(F.transform(F.array_distinct(found), _word_keys)))
    count = texts.select("label", F.explode(keys).alias("key")).groupBy("key").agg(
        F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    total = texts.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("q")).first()
    p, q = float(total["p"] or 0), float(total["q"] or 0)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (p - F.col("a") + 0.5)) - F.log(b / (q - F.col("b") + 0.5))
    bound = odds - CERTAINTY * F.sqrt(1 / a + 1 / b)
    precise = F.col("a") * q > 3 * F.col("b") * p  # in toxic documents at least three times as often
    top = count.where((F.col("a") + F.col("b") >= min_docs) & precise).select("key", bound.alias("weight"))
    rows = top.where("weight > 0").orderBy(F.desc("weight"), "key").limit(size).collect()
    return {r["key"]: float(r["weight"]) for r in rows}


def score_documents(docs: DataFrame, labels: DataFrame, allowed: Column, max_train: int = MAX_TRAIN) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``) and ``score`` for every row of ``docs`` (doc_id, text, ...).

    ``labels`` (doc_id, toxic); ``allowed`` says which of them may be learned from."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    train = written(training_labels(labels, allowed, max_train), "toxic-train")  # at most max_train narrow rows
    texts = docs.select("doc_id", "text").join(F.broadcast(train), "doc_id").select("text", "label")
    texts = written(texts, "toxic-texts")
    share = texts.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p")).first()
    n, positives = share["n"], share["p"] or 0.0
    if positives in (0.0, float(n)):
        flat = float(positives + 1) / (n + 2) if n else 0.0
        return rows.withColumn("score", F.lit(flat))
    learned = learn_lexicon(texts)
    fitted = written(with_features(texts, learned, "label"), "toxic-rows")
    marked = fitted.withColumn("part", F.pmod(F.xxhash64(vector_to_array("features"), "label"), F.lit(CALIBRATION_SHARE)))
    fit_rows, held = marked.where("part > 0"), marked.where("part = 0")
    if fit_rows.agg(F.countDistinct("label")).first()[0] < 2:
        fit_rows = marked
    # two partitions of bounded rows: a fit over at most max_train short vectors
    gbt = GBTClassifier(labelCol="label", featuresCol="features", maxIter=20, maxDepth=4, stepSize=0.2, seed=7)
    model = gbt.fit(fit_rows.coalesce(2))
    raw = vector_to_array("probability")[1].alias("raw")
    calibrator = None
    if held.agg(F.countDistinct("label")).first()[0] == 2:
        scored = model.transform(held).select("label", raw)
        calibrator = IsotonicRegression(labelCol="label", featuresCol="raw", predictionCol="calibrated").fit(scored)
    text = F.col("row")["text"].alias("text")
    y = model.transform(with_features(rows.select("row", text), learned, "row")).select("row", raw)
    if calibrator is None:
        return y.withColumnRenamed("raw", "score")
    edges, values = list(calibrator.boundaries), list(calibrator.predictions)
    score = (1 - RAW_SHARE) * interpolate(F.col("raw"), edges, values) + RAW_SHARE * F.col("raw")
    return y.select("row", score.alias("score"))


def interpolate(x: Column, edges: Sequence[float], values: Sequence[float]) -> Column:
    """The piecewise linear function through (edges, values), constant beyond both ends."""
    e, v = [float(a) for a in edges], [float(a) for a in values]
    slopes = [(v[i + 1] - v[i]) / (e[i + 1] - e[i]) if e[i + 1] > e[i] else 0.0 for i in range(len(e) - 1)] + [0.0]
    reached = F.size(F.filter(F.lit(e), lambda edge: edge <= x))  # the segment; literal arrays, so that the plan stays flat
    line = F.element_at(F.lit(v), reached) + (x - F.element_at(F.lit(e), reached)) * F.element_at(F.lit(slopes), reached)
    return F.when(reached == 0, F.lit(v[0])).otherwise(line)
