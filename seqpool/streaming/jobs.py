"""Structured Streaming jobs over a folder of Parquet files, run to the end of what is there (availableNow).

Both jobs take the caller's folders for checkpoint and result, so a later run goes on where the last one ended; without
them they make their own.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqpool.operators.metrics import scored
from seqpool.session import materialise, shared_scratch
from seqpool.sources import store as SS


def _stream(spark: SparkSession, folder: str, schema, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def query_name(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave the query of this checkpoint folder: a new folder, or one made anew, has another."""
    return spark.read.text(f"{checkpoint.rstrip('/')}/metadata").select(F.get_json_object("value", "$.id")).first()[0]


def stream_featurize(spark: SparkSession, folder: str, schema, col: str, encoder, files_per_trigger: int = 4,
                     store: str | None = None, checkpoint: str | None = None) -> str:
    """Encode every newly arrived string once into the feature store; returns the store's folder.

    The store itself says what is known: a micro-batch encodes the strings that the store lacks and writes them as a part named by
    the query and the batch's number, overwriting that part alone.  So a batch that runs again after a loss, a later run
    on the same folders, or a store that others write to as well leaves one row per string, and no state grows with the keys."""
    out = store or shared_scratch(spark, "stream-features")
    state = checkpoint or shared_scratch(spark, "stream-state")

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        part = f"{query_name(session, state)}-{number}"
        keys = batch.select(F.col(col).cast("string").alias("key")).where(F.col("key").isNotNull())
        keys = keys.groupBy(SS.digest_of(F.col("key")).alias("digest")).agg(F.first("key").alias("key"))
        if SS.store_exists(session, out):
            keys = keys.join(SS.read_parts(session, out, encoder.name).where(F.col("part") != part).select("digest"), "digest", "left_anti")
        SS.write_part(SS.encode_keys(materialise(keys, "stream-keys"), "key", encoder), out, part)

    query = (_stream(spark, folder, schema, files_per_trigger).writeStream.foreachBatch(write)
             .option("checkpointLocation", state).trigger(availableNow=True).start())
    query.awaitTermination()
    return out


def stream_sums(spark: SparkSession, folder: str, schema, sums: dict, files_per_trigger: int = 4) -> DataFrame:
    """Running sums over a stream, one row of state; returns the final row."""
    name = f"sums_{uuid.uuid4().hex[:10]}"
    query = (_stream(spark, folder, schema, files_per_trigger).groupBy().agg(*[c.alias(k) for k, c in sums.items()])
             .writeStream.format("memory").queryName(name)
             .option("checkpointLocation", shared_scratch(spark, "stream-state")).outputMode("complete")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.table(name)


def stream_score_counts(spark: SparkSession, folder: str, schema, score: str = "score", label: str = "label", group: Sequence[str] = (),
                        files_per_trigger: int = 4, table: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """X2 for rank metrics: positives and negatives of every (group, score) as keyed state; returns (group, score, tp, fp).

    A micro-batch writes the scores whose counts it changed (update mode) as a part of its own in ``table``; the last
    part of a score holds its counts.  Only changed scores are written; a batch that runs again overwrites its part; a
    later run on the same folders goes on."""
    out = table or shared_scratch(spark, "score-counts")
    pos = F.col(label).cast("double")
    counts = scored(_stream(spark, folder, schema, files_per_trigger), score, label).groupBy(*group, F.col(score).alias("score")).agg(
        F.sum(pos).alias("tp"), F.sum(F.lit(1.0) - pos).alias("fp"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (counts.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint or shared_scratch(spark, "stream-state")).trigger(availableNow=True).start())
    query.awaitTermination()
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema), "batch bigint"])
    parts = spark.read.schema(fields).parquet(out) if SS.store_exists(spark, out) else spark.createDataFrame([], fields)
    last = parts.groupBy(*group, "score").agg(F.max_by(F.struct("tp", "fp"), "batch").alias("now"))
    return last.select(*group, "score", "now.tp", "now.fp")
