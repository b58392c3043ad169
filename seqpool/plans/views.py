"""Views over the driver's tables that give the operators their domain shape.

Each view is a lazy DataFrame derived from the given parquet tables, so its size grows with
them.  The same definitions exist as SQL in ``seqpool.plans.oracle`` for the DuckDB check.

tokens     ragged token sets:        embeddings -> (seq_id, pos, vec)  seq_id = floor(sqrt(vec_id))
line_tokens ragged token sets:       lineitem   -> (key, pos, vec)  key = l_suppkey
features   one vector per key:       embeddings -> (key, vec)
key_features a vector for each key of the pairs, entities or edges, by the hash encoder
pairs      interaction pairs:        lineitem   -> (row_id, drug_key, target_key, label)
edges      graph edges:              lineitem   -> (row_id, p0, p1, label, split)
splits     classification table:     documents LEFT JOIN labels -> (doc_id, sequence, target, set, validation)
preds      scored predictions:       documents JOIN labels -> (row_id, score, label)
reg        regression predictions:   lineitem   -> (row_id, p, y)
mlab       multi-label predictions:  documents x 10 labels (generated, not joined) -> (protein, label, score, target)
epochs     per-run metric history:   events by (event_type, day) -> (run_id, epoch, v, t_start, t_end)
members    identity membership:      documents  -> (protein, p30, p40, p50, p70, p95)
annot_lines annotation TSV body:     events -> value = "<protein>\\t<code>,<code>"
fasta      FASTA records:            documents  -> value = ">id lang\\n<60-char lines>"
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpool.session import materialise
from seqpool.sources.store import HashEncoder, encode_keys

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Fixed values of the view definitions (must be equal in the DuckDB oracle).
TEST_SOURCES = ["src0", "src1", "src2", "src3"]
N_MLAB_LABELS = 10
KEY_DIM = 64
FASTA_LINE = 60
EPOCH_ORIGIN = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    seq = F.floor(F.sqrt(F.col("vec_id"))).cast("bigint")
    return e.select(
        seq.alias("seq_id"),
        (F.col("vec_id") - seq * seq).alias("pos"),
        F.col("embedding").alias("vec"),
    )


def key_features(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """(key, vec): a feature for every distinct key of ``keys`` (key), made by the hash encoder; written once."""
    enc = encode_keys(keys, "key", HashEncoder(KEY_DIM, "hash64"))
    kind = dict(keys.dtypes)["key"]
    return materialise(enc.select(F.col("key").cast(kind).alias("key"), "vec"), "key-features")


def pair_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct drug and target keys of the pairs."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.explode(F.array("l_partkey", "l_suppkey")).alias("key")).distinct()


def entity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")).distinct()


def edge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_keys(spark, sf_dir).select(F.col("key").cast("string").alias("key"))


def line_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ragged token sets of the suppliers: a supplier's lines, four measures each; (key, pos, vec)."""
    li = table(spark, sf_dir, "lineitem")
    scaled = [F.col("l_quantity") / 50.0, F.col("l_extendedprice") / 100000.0, F.col("l_discount") * 10.0, F.col("l_tax") * 10.0]
    return li.select(F.col("l_suppkey").alias("key"), lineitem_row_id().alias("pos"), F.array(*[c.cast("double") for c in scaled]).alias("vec"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))


def lineitem_row_id() -> Column:
    """A unique row id built from integer-valued columns only (formatting is engine-independent)."""
    parts = [
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.round(F.col("l_quantity") * 100).cast("bigint"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint"),
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")),
    ]
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        lineitem_row_id().alias("row_id"),
        F.col("l_partkey").alias("drug_key"),
        F.col("l_suppkey").alias("target_key"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("label"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part-supplier edges; split from a hash of the row id (train / val / test like the edge files)."""
    li = table(spark, sf_dir, "lineitem")
    rid = lineitem_row_id()
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("split|"), rid)), 1, 8), 16, 10).cast("bigint") % 10
    return li.select(
        rid.alias("row_id"),
        F.col("l_partkey").cast("string").alias("p0"),
        F.col("l_suppkey").cast("string").alias("p1"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("label"),
        F.when(bucket < 7, "train").when(bucket < 8, "val").otherwise("test").alias("split"),
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        "doc_id",
        F.col("text").alias("sequence"),
        F.col("lang").alias("target"),
        F.when(F.col("source").isin(TEST_SOURCES), "test").otherwise("train").alias("set"),
        (F.col("quality") == 0).alias("validation"),
    )


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("row_id"),
        ((F.col("n_chars") % 101) / F.lit(101.0)).alias("score"),
        F.col("quality").cast("bigint").alias("label"),
    )


def reg(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        lineitem_row_id().alias("row_id"),
        (F.col("l_quantity") * 1500.0).alias("p"),
        F.col("l_extendedprice").alias("y"),
    )


def mlab(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(N_MLAB_LABELS - 1).cast("bigint")))
    x = d.select(F.col("doc_id").alias("protein"), lab.alias("label"))
    return x.select(
        "protein",
        "label",
        ((F.col("protein") * 7 + F.col("label") * 13) % 97 / F.lit(97.0)).alias("score"),
        (((F.col("protein") * 3 + F.col("label") * 5) % 7) == 0).cast("bigint").alias("target"),
    )


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    epoch = F.datediff(F.col("ts").cast("date"), F.lit(EPOCH_ORIGIN).cast("date")).cast("bigint")
    return (
        ev.groupBy(F.col("event_type").alias("run_id"), epoch.alias("epoch"))
        .agg(
            F.avg("value").alias("v"),
            F.min("ts").alias("t_start"),
            F.max("ts").alias("t_end"),
        )
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")

    def flag(mod: int, lt: int) -> Column:
        return F.when(F.col("doc_id") % mod < lt, "1").otherwise("0")

    return d.select(
        F.col("doc_id").cast("string").alias("protein"),
        flag(10, 3).alias("p30"),
        flag(10, 4).alias("p40"),
        flag(10, 5).alias("p50"),
        flag(10, 7).alias("p70"),
        flag(20, 19).alias("p95"),
    )


def _annot_codes() -> Column:
    k = F.get_json_object(F.col("props"), "$.k").cast("bigint")
    base = F.concat_ws(",", F.col("event_type"), F.concat(F.lit("k"), (k % 7).cast("string")))
    with_dup = F.when(k % 4 == 0, F.concat(base, F.lit(","), F.col("event_type"))).otherwise(base)
    return F.when(k % 10 == 0, F.lit("")).otherwise(with_dup)


def annot_lines(spark: SparkSession, sf_dir: str, with_errors: bool = True) -> DataFrame:
    """Body lines of an annotation TSV: one protein per event; without those of error events for the quarantine."""
    ev = table(spark, sf_dir, "events")
    if not with_errors:
        ev = ev.where(F.col("event_type") != "error")
    return ev.select(
        F.concat(F.lit("e"), F.col("event_id").cast("string"), F.lit("\t"), _annot_codes()).alias("value")
    )


def annot_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a protein; error events have no annotation line (J8 quarantine)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("protein"))


def annot_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary: the codes of all lines, event types without a line's codes, and k7 (which never occurs)."""
    ev = table(spark, sf_dir, "events")
    own = F.array(F.col("event_type"), F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("bigint") % 7).cast("string")),
                  F.lit("k7"))
    return ev.select(F.explode(own).alias("code")).distinct()


def fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA records as ``spark.read.option('lineSep', '\\n>')`` would deliver them (leading '>' kept)."""
    d = table(spark, sf_dir, "documents")
    letters = F.translate(F.regexp_replace(F.col("text"), "[\\s>]+", ""), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    body = F.array_join(F.regexp_extract_all(letters, F.lit(f"(?s).{{1,{FASTA_LINE}}}"), 0), "\n")
    header = F.concat(F.lit(">"), F.col("doc_id").cast("string"), F.lit(" "), F.col("lang"))
    return d.select(F.concat(header, F.lit("\n"), body).alias("value"))
