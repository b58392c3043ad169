"""Feature store and result sinks as Parquet tables under the shared checkpoint folder.

The store is ``(digest STRING, key STRING, model STRING, vec ARRAY<FLOAT>)`` partitioned by ``model`` so a read
for one encoder prunes to its partition.  The encoder gets the raw string.  ``key`` is the raw string made safe
for a name ('/' becomes '|'), which distinct strings can share; rows are found by ``digest``, the 128-bit hash of the
raw string, so each string has its own vector.  Writes are idempotent: only digests that the store lacks are
encoded and appended.  Each write is a part of its own (a second partition column), which a repeated write overwrites.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpool.functions.text import sanitize_key

STORE_SCHEMA = "digest string, key string, model string, vec array<float>"


class HashEncoder:
    """Deterministic test encoder: vec[i] = int(md5(key|i)[:8], 16) / 2^32 (stands in for a real model)."""

    def __init__(self, dim: int = 8, name: str = "hash8", salt: str = ""):
        self.dim, self.name, self.salt = dim, name, salt

    def encode(self, keys: pd.Series) -> pd.Series:
        out = []
        for k in keys.to_numpy():
            start = hashlib.md5(f"{self.salt}{k}|".encode())
            row = np.empty(self.dim, dtype=np.float64)
            for i in range(self.dim):
                h = start.copy()
                h.update(str(i).encode())
                row[i] = int(h.hexdigest()[:8], 16)
            out.append((row / 2.0 ** 32).astype(np.float32))
        return pd.Series(out)


def digest_of(c: Column) -> Column:
    return F.md5(c.cast("string").cast("binary"))


def encode_keys(df: DataFrame, col: str, encoder, out: str = "vec") -> DataFrame:
    """(digest, key, model, vec) of every distinct non-null string; each goes to the encoder once."""
    x = df.select(F.col(col).cast("string").alias("key")).where(F.col("key").isNotNull())
    keys = x.groupBy(digest_of(F.col("key")).alias("digest")).agg(F.first("key").alias("key"))
    name = encoder.name

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"digest": b["digest"], "key": b["key"], "model": name, out: encoder.encode(b["key"])})

    return keys.mapInPandas(run, f"digest string, key string, model string, {out} array<float>")


def encode_distinct(df: DataFrame, col: str, encoder, out: str = "vec") -> DataFrame:
    """``df`` with the encoder's vector of ``df[col]``; joined on the digest, so texts travel once."""
    enc = encode_keys(df, col, encoder, out).select(F.col("digest").alias("_digest"), "model", out)
    return df.withColumn("_digest", digest_of(F.col(col))).join(enc, "_digest", "left").drop("_digest")


ENCODERS = {
    "hash8": lambda: HashEncoder(8),
    "salted4": lambda: HashEncoder(4, "salted4", salt="s:"),
}


def get_encoders(names: str) -> list:
    """Encoders by name, several separated by commas; an unknown name is an error."""
    parts = [n.strip() for n in names.split(",")]
    unknown = [n for n in parts if n not in ENCODERS]
    if unknown:
        raise ValueError(f"unknown encoders {unknown}; expected some of {sorted(ENCODERS)}")
    return [ENCODERS[n]() for n in parts]


def encode_concat(df: DataFrame, col: str, names: str, out: str = "vec") -> DataFrame:
    """``df`` with the vectors of the named encoders of ``df[col]``, one behind the other."""
    x, vecs = df, []
    for i, encoder in enumerate(get_encoders(names)):
        x = encode_distinct(x, col, encoder, f"_v{i}").drop("model")
        vecs.append(f"_v{i}")
    return x.withColumn(out, F.concat(*vecs)).drop(*vecs)


def store_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_parts(spark: SparkSession, path: str, model: str) -> DataFrame:
    return spark.read.schema(STORE_SCHEMA + ", part string").parquet(path).where(F.col("model") == model)


def read_store(spark: SparkSession, path: str, model: str) -> DataFrame:
    return read_parts(spark, path, model).drop("part")


def write_part(encoded: DataFrame, path: str, part: str) -> None:
    """Write encoded rows as the part ``part`` of their model's partition; the same part written before is replaced."""
    x = encoded.withColumn("key", sanitize_key(F.col("key"))).withColumn("part", F.lit(part))
    (x.select("digest", "key", "vec", "model", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("model", "part").parquet(path))


def write_missing(spark: SparkSession, keys: DataFrame, path: str, encoder, key: str = "key") -> None:
    """S9 + J7: encode the strings that the store lacks and append them (safe to re-run).

    Any error in reading an existing store is raised."""
    k = keys.select(F.col(key).cast("string").alias("key")).where(F.col("key").isNotNull())
    if store_exists(spark, path):
        have = read_store(spark, path, encoder.name).select("digest")
        k = k.withColumn("digest", digest_of(F.col("key"))).join(have, "digest", "left_anti").select("key")
    write_part(encode_keys(k, "key", encoder), path, uuid.uuid4().hex)


def lookup_with_fallback(spark: SparkSession, df: DataFrame, col: str, path: str, encoder) -> DataFrame:
    """Stored vector when present, else encode now (and report which)."""
    store = read_store(spark, path, encoder.name).select(F.col("digest").alias("_digest"), F.col("vec").alias("_stored"))
    x = df.withColumn("_digest", digest_of(F.col(col))).join(store, "_digest", "left")
    fresh = encode_keys(x.where(F.col("_stored").isNull()), col, encoder).select(F.col("digest").alias("_digest"), F.col("vec").alias("_new"))
    y = x.join(fresh, "_digest", "left")
    source = F.when(F.col("_stored").isNotNull(), "store").when(F.col("_new").isNotNull(), "encoded")
    return y.select(*df.columns, F.coalesce("_stored", "_new").alias("vec"), source.alias("source"))


def append_metrics(df: DataFrame, path: str) -> None:
    """Long (run_id, epoch, metric, value) rows appended, partitioned by run."""
    df.select("run_id", "epoch", "metric", "value").write.mode("append").partitionBy("run_id").parquet(path)
