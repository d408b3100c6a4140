"""Session helpers: where intermediate tables go, and what may be broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"

# Rows here are cheap to move and costly to work on, so adaptive execution should merge shuffle
# partitions only when they are really small.  On large data it has no effect.
TUNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}


# Rows that go to Python can be long arrays of texts; a batch of them is bounded by its size, not by its rows.
BATCH_BYTES = "8m"
BATCH_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Small Arrow batches for this session, instead of Spark's of 64 MB; a bound that the session sets itself stays."""
    if spark.conf.get(BATCH_BYTES_SETTING, None) in (None, "67108864b", "64MB"):
        spark.conf.set(BATCH_BYTES_SETTING, BATCH_BYTES)


_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    Only a local master, where driver and executors are one process, falls back to a fresh folder
    of its own, one per application.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_SETTING, None) or context.getConf().get(CHECKPOINT_SETTING)
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="caseloom-")
    return _local_folders[context.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, whoever reads it.

    ``options`` are those of the writer.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``max_rows`` rows, else ``df`` unchanged.

    Meant for small summaries (labels, per-class totals).  At most ``max_rows + 1`` rows reach the
    driver; a larger ``df`` is left to an ordinary shuffle join.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def spread(df: DataFrame, scan: DataFrame | None = None) -> DataFrame:
    """``df`` over all cores if its scan has fewer partitions than that, else ``df`` unchanged.

    For small inputs of costly narrow jobs.  Scans of large tables have partitions enough and are
    never shuffled by this.  ``scan`` is the table ``df`` reads, where ``df`` does more than read it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    partitions = (df if scan is None else scan).rdd.getNumPartitions()
    return df.repartition(cores) if partitions < cores else df
