"""Document fingerprints: 64-bit SimHash, and a Hamming search over permuted block tables.  SQL functions only.

Every word of a text votes with its weight on the signed bits of its hash; longer words weigh more, and a word
that stands n times votes n times.  A fingerprint bit is set where the votes are positive.  The search cuts fingerprints
into blocks; two that differ in at most ``radius`` bits agree on all blocks but ``radius``, so one table per choice of the
agreeing blocks, keyed by these, finds every pair within the radius.

Defined results: null and empty texts, and texts of white space, have the fingerprint of no votes (zero); equal texts have equal
fingerprints; rows are ordered by descending doc_id with nulls last, rows of one id by a hash of their text, then the text; a
single row is its own successor; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqpool.llm.common import written

BITS = 64
LEAST_WEIGHT, MOST_WEIGHT, FREE_CHARS = 1, 16, 2  # a word weighs its length beyond FREE_CHARS, within these bounds
BUCKET_BITS, LEVEL_BITS = 8, 11  # ids per bucket of neighbours, buckets per group of a level (powers of two)
RADIUS, BLOCKS = 3, 6
NO_ID = -(1 << 63)
_LANES = 0x0000000100000001


def word_weight(word: Column) -> Column:
    n = F.length(word) - F.lit(FREE_CHARS)
    return F.when(word == "", F.lit(0)).otherwise(F.least(F.greatest(n, F.lit(LEAST_WEIGHT)), F.lit(MOST_WEIGHT))).cast("bigint")


def with_simhash(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fp`` (bigint); the keys tell the rows apart.  Two 32-bit counts share each sum."""
    words = rows.select(*keys, F.explode(F.split(F.col(text), r"[ \t-\r]+")).alias("word"))
    votes = words.select(*keys, F.xxhash64("word").alias("h"), word_weight(F.col("word")).alias("w"))
    half = BITS // 2
    sums = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"s{i}") for i in range(half)]
    counted = votes.groupBy(*keys).agg(F.sum("w").alias("total"), *sums)
    fp = F.lit(0).cast("bigint")
    for i in range(half):
        low = F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(f"s{i}", half)
        for bit, ones in ((i, low), (i + half, high)):
            value = (1 << bit) - (1 << 64 if bit == 63 else 0)
            fp = fp.bitwiseOR(F.when(2 * ones > F.col("total"), F.lit(value).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return counted.select(*keys, fp.alias("fp"))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def successors(values: DataFrame, col: str, span: int) -> DataFrame:
    """(col, next): the next smaller of distinct integers, null for the smallest.

    Integers are grouped by their leading bits, level by level, so no window holds more than a level's
    2**LEVEL_BITS.  ``span`` is the difference of the largest and the smallest."""
    down = F.col(col).desc()
    if span < 1 << LEVEL_BITS:
        return values.select(col, F.lead(col).over(Window.partitionBy(F.lit(0)).orderBy(down)).alias("next"))
    group = f"{col}_"
    x = values.withColumn(group, F.shiftright(col, LEVEL_BITS))
    heads = x.groupBy(group).agg(F.max(col).alias("head"))
    after = successors(heads.select(group), group, (span >> LEVEL_BITS) + 1)
    after = after.join(heads.select(F.col(group).alias("next"), "head"), "next").select(group, "head")
    inner = x.withColumn("in", F.lead(col).over(Window.partitionBy(group).orderBy(down)))
    return inner.join(after, group, "left").select(col, F.coalesce("in", "head").alias("next"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """b, rn (row key), doc_id, text, edited: the last half of a text replaced by the start of the next document's.

    Rows are grouped by the leading bits of their id; only a group's first text travels to the group before it."""
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    x = x.withColumn("k", F.coalesce("doc_id", F.lit(NO_ID))).withColumn("b", F.shiftright("k", BUCKET_BITS))
    order = [F.col("k").desc(), F.xxhash64("text"), F.col("text")]
    w = Window.partitionBy("b").orderBy(*order)
    rows = x.select("b", F.row_number().over(w).alias("rn"), "doc_id", "text", F.lead("text").over(w).alias("next"))
    heads = x.select("b", "text", F.row_number().over(w).alias("rn")).where("rn = 1").select("b", "text")
    buckets = x.select("b").distinct()
    ends = buckets.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).first()
    if ends["lo"] is None:
        return rows.select("b", "rn", "doc_id", "text", F.col("text").alias("edited"))
    after = successors(buckets, "b", ends["hi"] - ends["lo"])
    after = after.select("b", F.coalesce("next", F.lit(ends["hi"])).alias("b_next"))  # after the last comes the first
    after = after.join(heads.select(F.col("b").alias("b_next"), F.col("text").alias("head")), "b_next").select("b", "head")
    y = rows.join(after, "b").withColumn("next", F.coalesce("next", "head"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    return y.select("b", "rn", "doc_id", "text", edited.alias("edited"))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """b, rn, doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp for every row of ``docs`` (doc_id, text)."""
    x = edited_documents(docs)
    keys = ["b", "rn", "doc_id", "n_chars", "edited_sha256"]
    x = x.select("b", "rn", "doc_id", F.length("text").cast("bigint").alias("n_chars"),
                 F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.array("text", "edited").alias("both"))
    both = x.select(*keys, F.posexplode("both").alias("which", "one"))
    fps = with_simhash(both, [*keys, "which"], "one")
    one = [F.max(F.when(F.col("which") == i, F.col("fp"))).alias(name) for i, name in enumerate(("fp", "edited_fp"))]
    out = written(fps.groupBy(*keys).agg(*one), "fingerprints")
    w = Window.partitionBy("b").orderBy("rn")
    heads = out.where("rn = 1").select("b", "fp")
    ends = heads.agg(F.min("b").alias("lo"), F.max("b").alias("hi")).first()
    if ends["lo"] is None:
        return out.withColumn("next_fp", F.col("fp"))
    after = successors(heads.select("b"), "b", ends["hi"] - ends["lo"])
    after = after.select("b", F.coalesce("next", F.lit(ends["hi"])).alias("b_next"))
    after = after.join(heads.select(F.col("b").alias("b_next"), F.col("fp").alias("head")), "b_next").select("b", "head")
    out = out.withColumn("next_fp", F.lead("fp").over(w)).join(after, "b")
    return out.withColumn("next_fp", F.coalesce("next_fp", "head")).drop("head")


def block_tables(fps: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fp, key: one key per choice of the blocks that agree, made of the table's number and these blocks."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    keys = []
    for table, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        parts = [F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in chosen]
        keys.append(F.xxhash64(F.lit(table), *parts))
    return fps.select("fp", F.explode(F.array(*keys)).alias("key"))


def near_fingerprints(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query, fp, distance) of all pairs within the radius.  Both sides: distinct ``fp``."""
    q = block_tables(queries, radius, blocks).withColumnRenamed("fp", "query")
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fp")))
    pairs = q.join(block_tables(index, radius, blocks), "key").where(distance <= radius)
    return pairs.select("query", "fp", distance.alias("distance")).distinct()


def near_counts(fps: DataFrame, asked: Column, radius: int = RADIUS) -> DataFrame:
    """fp, n_near: how many rows lie within the radius of a fingerprint that ``asked`` picks; copies are not paired."""
    counts = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.max(asked.cast("int")).alias("asked"))
    pairs = near_fingerprints(counts.where("asked = 1").select("fp"), counts.select("fp"), radius)
    return pairs.join(counts.select("fp", "n"), "fp").groupBy("query").agg(F.sum("n").alias("n_near")).withColumnRenamed("query", "fp")
