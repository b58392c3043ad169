"""Record parsers for FASTA and annotation TSV text.

The readers deliver text rows; parsing is pure column expressions so it runs in the JVM and
splits like any text scan.  FASTA files are read with ``lineSep='\\n>'`` so one row is one
record even when a record spans input splits.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpool.plans.prefix import global_row_number
from seqpool.session import materialise


def read_fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per FASTA record (``value`` starts after '>' except for the file's first record),
    with an order key (file, offset) for last-wins de-duplication."""
    df = spark.read.option("lineSep", "\n>").text(path)
    return df.select("value", F.col("_metadata.file_path").alias("_file"),
                     F.col("_metadata.file_block_start").alias("_block"),
                     F.monotonically_increasing_id().alias("_rid"))


def _record_parts(value: Column):
    body = F.regexp_replace(value, "\r", "")
    body = F.regexp_replace(body, "^>", "")
    lines = F.split(body, "\n")
    header = F.get(lines, F.lit(0))
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), lambda x: F.trim(x))
    rest = F.filter(rest, lambda x: F.length(x) > 0)
    return header, rest


def fasta_records(records: DataFrame, value: str = "value", order: list[str] | None = None) -> DataFrame:
    """(acc, seq): id = first whitespace token of the header; sequence lines joined; a later
    duplicate id wins (order columns, default file path / block / row id)."""
    header, rest = _record_parts(F.col(value))
    acc = F.get(F.split(F.trim(header), r"\s+"), F.lit(0))
    parsed = records.select(acc.alias("acc"), F.array_join(rest, "").alias("seq"),
                            *(order or [c for c in ("_file", "_block", "_rid") if c in records.columns]))
    ord_cols = order or [c for c in ("_file", "_block", "_rid") if c in records.columns]
    parsed = parsed.where(F.col("acc").isNotNull() & (F.col("acc") != ""))
    if not ord_cols:
        return parsed.select("acc", "seq")
    return parsed.groupBy("acc").agg(F.max_by("seq", F.struct(*ord_cols)).alias("seq"))


def fasta_lines(records: DataFrame, value: str = "value") -> DataFrame:
    """One row per sequence line under its header; the whole header text is the name (Q4).

    A record is taken apart once, below the generator; its outer form keeps Spark from taking it apart again in a filter."""
    header, rest = _record_parts(F.col(value))
    parts = records.select(F.rtrim(header).alias("name"), rest.alias("lines"))
    return parts.select("name", F.posexplode_outer("lines").alias("line_no", "seq")).where("line_no IS NOT NULL").select(
        "name", F.col("line_no").cast("bigint").alias("line_no"), "seq")


def parse_annotation_lines(lines: DataFrame, value: str = "value", keep=()) -> DataFrame:
    """S6 body: ``protein\\tcode,code`` -> (protein, codes ARRAY<STRING>); empty items skipped and a
    missing second field gives an empty list."""
    parts = F.split(F.regexp_replace(F.col(value), "\r", ""), "\t")
    codes = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return lines.select(F.get(parts, F.lit(0)).alias("protein"),
                        F.filter(F.split(codes, ","), lambda x: x != "").alias("codes"), *keep)


HEAD_LINES = 3  # line 1 (0-based) is the vocabulary, lines 0 and 2 are titles


def read_annotation_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Returns (vocabulary (code, idx), annotations (protein, codes, line)).

    Row ids rise with the lines inside a file block, so the head of each file is found from the least id of its
    first block (one row per file), and ``line`` orders the lines of a file for the last-wins rule.  The numbered lines are
    written once, since two scans could be split differently and number them differently."""
    raw = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    raw = materialise(raw, "annotation-lines")
    first = raw.where("block = 0").groupBy("file").agg(F.min("row").alias("row0"))
    x = raw.join(first, "file").withColumn("line", F.when(F.col("block") == 0, F.col("row") - F.col("row0")))
    is_head = F.coalesce(F.col("line") < HEAD_LINES, F.lit(False))
    head = x.where(is_head & (F.col("line") == 1))
    vocab = head.select(F.posexplode(F.split(F.col("value"), "\t")).alias("idx", "code")).where(F.col("code") != "")
    vocab = vocab.groupBy("code").agg(F.min("idx").cast("bigint").alias("idx"))
    body = x.where(~is_head)
    parsed = parse_annotation_lines(body, keep=[F.struct("file", "block", "row").alias("line")])
    return vocab, parsed


def write_annotation_tsv(lines: DataFrame, codes: list[str], path: str, value: str = "value") -> None:
    """Annotation files of the layout that ``read_annotation_tsv`` reads: every file starts with the three head lines."""
    head = ["### vocabulary", "\t".join(codes), "### protein\tcodes"]

    def run(batches):
        yield pd.DataFrame({"value": head})
        for b in batches:
            yield pd.DataFrame({"value": b[value]})

    lines.select(value).mapInPandas(run, "value string").write.text(path)


def vocabulary_index(codes: DataFrame, code: str = "code") -> DataFrame:
    """Rank of each distinct code in text order, over ranges of the codes' first bytes."""
    x = codes.select(code).distinct()
    x = x.withColumn("_first", F.conv(F.hex(F.rpad(F.encode(F.col(code), "UTF-8"), 6, F.lit(b"\x00"))), 16, 10).cast("double"))
    r = global_row_number(x, "_first", tiebreak=[code], out="_rn")
    return r.select(code, (F.col("_rn") - 1).cast("bigint").alias("idx"))
