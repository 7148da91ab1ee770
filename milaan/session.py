"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime plan choices: coalesce small shuffles, split skewed join partitions even when that costs one more exchange.
# A row of this work costs far more time than bytes, and a shuffled byte takes some twenty in a task's memory, so partitions are kept
# smaller than Spark's defaults.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Plan-time estimates do not count rows that explode adds, so no side is broadcast from an estimate: literal dimension tables
    # carry a hint, and for the rest AQE decides from sizes it has measured.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.session.timeZone": "UTC",
    # Streams keep per-key state with timers.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Model replies repeat keys; the last one counts.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def tuned(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Source bytes one shuffle task should stand for.
BYTES_PER_TASK = 64 << 20


INITIAL = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def size_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """Start a session's shuffles with enough partitions for inputs of this size; AQE merges the ones that turn out small.

    Called once by whoever starts the session and knows the input.
    """
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spark.conf.set(INITIAL, str(max(least, -(-input_bytes // BYTES_PER_TASK))))


def grow_shuffles(spark: SparkSession, input_bytes: int) -> None:
    """As :func:`size_shuffles`, but only ever upwards: for readers that learn of a larger input than the session was started for."""
    if -(-input_bytes // BYTES_PER_TASK) > int(spark.conf.get(INITIAL, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        size_shuffles(spark, input_bytes)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.  The cluster names it; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="milaan-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
