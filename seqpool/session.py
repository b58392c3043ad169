"""Session helpers: a local session for tests/bench, the shared scratch folder, shipping the package to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every session we create gets; on a cluster the operator's own settings win
# because we only fill in what is unset.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Rows in an Arrow batch where the session names no number: a row can be a whole text or token matrix, and a Python
# worker holds a batch several times over.
_BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "seqpool") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("SEQPOOL_DRIVER_MEMORY", "16g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_base(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, as the URI it was given.

    Only a session on one machine (master ``local``) may fall back to a private folder; on a
    cluster an unset folder is an error, since executors could not see each other's files."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
    configured = "file://" + os.path.join(tempfile.gettempdir(), f"seqpool-ckpt-{uuid.uuid4().hex[:8]}")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Point the context's checkpoint folder at ``checkpoint_base`` unless it already has one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(checkpoint_base(spark))
    ship_package(spark)
    if _BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*_BATCH)
    return sc.getCheckpointDir()


def shared_scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint location for written intermediate tables."""
    return f"{checkpoint_base(spark).rstrip('/')}/seqpool-tables/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df, name: str):
    """Write ``df`` once to the shared folder and read it back: one evaluation, and a cut of the lineage."""
    spark = df.sparkSession
    path = shared_scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per context (they need not share the driver's path)."""
    sc = spark.sparkContext
    if getattr(sc, "_seqpool_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="seqpool-"), "seqpool_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._seqpool_shipped = True
