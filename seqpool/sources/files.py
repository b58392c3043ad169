"""Scans of delimited files: pre-split CSVs, a CSV with split columns, edge lists, membership flags.

Schemas are given, so no pass over the files infers them; split and label come from the file's path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EDGE_SPLITS = {"1": "train", "0": "val", "2": "test"}  # fixed values: number in the file name


def scan_split_csv(spark: SparkSession, path: str, schema: str, index: str = "index") -> DataFrame:
    """CSVs with header under ``path``/<split>..., unioned with a ``split`` tag; the index column is dropped."""
    x = spark.read.schema(f"{index} bigint, {schema}").option("recursiveFileLookup", "true").csv(path, header=True, quote='"', escape='"')
    split = F.regexp_extract(F.col("_metadata.file_path"), r"/(?:split=)?(train|val|test)(?:\.[^/]*|/[^/]*|\.[^/]*/[^/]*)$", 1)
    return x.select("*", split.alias("split")).drop(index)


def scan_flagged_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV whose rows hold their own split columns; quoted fields may hold line ends."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def scan_edge_lists(spark: SparkSession, path: str) -> DataFrame:
    """S3: space-separated pairs without header; label and split stand in the file name (Intra<n>_<pos|neg>)."""
    x = spark.read.schema("p0 string, p1 string").option("recursiveFileLookup", "true").csv(path, sep=" ", header=False)
    name = F.col("_metadata.file_path")
    number = F.regexp_extract(name, r"Intra(\d)_(pos|neg)", 1)
    split = F.lit(None).cast("string")
    for k, v in EDGE_SPLITS.items():
        split = F.when(number == k, F.lit(v)).otherwise(split)
    label = (F.regexp_extract(name, r"Intra(\d)_(pos|neg)", 2) == "pos").cast("bigint")
    return x.select("p0", "p1", label.alias("label"), split.alias("split"))


def scan_membership(spark: SparkSession, path: str, percents=(30, 40, 50, 70, 95)) -> DataFrame:
    """One 0/1 flag per identity threshold."""
    schema = "protein string, " + ", ".join(f"p{p} string" for p in percents)
    return spark.read.schema(schema).csv(path, header=True)
