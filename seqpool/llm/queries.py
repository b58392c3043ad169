"""The registered queries of this subpackage: thin contracts over the operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpool.llm import decontamination, fingerprints, html_text, near_dedup, packing, phrases, ranked_search, substring_dedup, suffix_dedup, token_files, toxicity, url_filter, warc
from seqpool.llm.common import table
from seqpool.llm.oracle import SQL as _SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = dict(_SQL)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Fixed values of the query: verdict, host, path prefix.
URL_RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


@query
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the explicit rules, else by the rules mined from labelled URLs.

    A page shows a document, whose id is the last number of the URL's path; its quality label is the URL's label."""
    pages = table(spark, sf_dir, "pages")
    number = F.regexp_extract(url_filter.path_of(F.col("url")), r"(\d{1,18})\D*$", 1)
    shown = pages.select("page_id", F.when(number != "", number).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL")
    quality = table(spark, sf_dir, "labels").where("doc_id IS NOT NULL AND quality IS NOT NULL")
    label = F.when(F.col("quality") == 0, "block").otherwise("allow").alias("label")
    labels = shown.join(quality.select("doc_id", "quality"), "doc_id").select("page_id", label)
    return url_filter.filter_urls(pages, URL_RULES, labels)


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back through the index."""
    folder, index = warc.write_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_records(folder, index, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    x = html_text.extract(table(spark, sf_dir, "pages"))
    return x.withColumn("n_chars", F.length("text").cast("bigint"))


def id_bucket():
    """0 for the fifth of the documents whose labels are held out."""
    return F.crc32(F.col("doc_id").cast("string")) % 5


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; learned from the labelled rows outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    x = toxicity.score_documents(docs, labels, id_bucket() != 0)
    x = x.select("row.doc_id", "score")
    return x.select("doc_id", F.coalesce(id_bucket() == 0, F.lit(False)).alias("held_out"), "score",
                    (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document without the 50-word windows that a document with a smaller id has."""
    x = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' token pieces packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component over its 4-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=4)


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, and which."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash, that of its edited text, and how alike they are.

    n_near: documents within the search radius (itself included), for ids divisible by 20."""
    x = fingerprints.fingerprint_documents(table(spark, sf_dir, "documents"))
    asked = F.col("doc_id") % 20 == 0
    near = fingerprints.near_counts(x.select("doc_id", "fp"), F.coalesce(asked, F.lit(False)))
    fp, edited, after = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return x.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.as_hex(fp).alias("fingerprint"),
        fingerprints.as_hex(edited).alias("edited_fingerprint"), fingerprints.likeness(fp, edited).alias("near_edited"),
        fingerprints.likeness(fp, after).alias("near_next"), F.when(asked, F.col("n_near")).alias("n_near"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that no repeated string of 200 bytes covers."""
    x = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return x.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
                    "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids written to files and read back."""
    folder, index = token_files.write_files(table(spark, sf_dir, "documents"))
    return token_files.read_files(spark, folder, index)


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 best phrases of two to five words."""
    return phrases.mine(table(spark, sf_dir, "documents"))


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return ranked_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
