"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: Bytes of rows that Python workers get at a time.
BATCH_BYTES = 8 << 20


def build_session(app_name: str = "shelfmark", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, which every executor can read.

    Only a local session without that setting gets a temporary folder; a cluster without it
    is an error, because a machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None) or sc.getConf().get(CHECKPOINT_DIR)
    if not folder:
        folder = sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shelfmark-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read back from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, most_bytes: int = BATCH_BYTES) -> None:
    """Bound the session's Arrow batches, so that a Python worker's memory does not depend on the input."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(name)).lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most_bytes:
        spark.conf.set(name, f"{most_bytes}b")


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder for one run below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """The same rows as a Parquet table of this run, for results that are read more than once
    by different columns."""
    folder = run_folder(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
