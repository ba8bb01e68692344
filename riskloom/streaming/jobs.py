"""Streaming jobs: audit events per action, and scanning of arriving code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from .. import fixed
from ..fixed import Rule
from ..operators import detect, limits
from ..session import checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def audit_stream(events: DataFrame, ts: str = "timestamp", action: str = "action",
                 width: str = "15 minutes", lateness: str = "15 minutes") -> DataFrame:
    """Closed windows of events per action; later events than `lateness` are left out."""
    return limits.action_windows(events.withWatermark(ts, lateness), ts, action, width)


def session_stream(events: DataFrame, key: str, ts: str = "timestamp",
                   pause: str = "2 hours", lateness: str = "15 minutes") -> DataFrame:
    """Closed activity sessions per key, in Spark's own session windows."""
    sessions = events.withWatermark(ts, lateness).groupBy(
        F.session_window(ts, pause).alias("s"), key).agg(
        F.count("*").alias("n_events"), F.max(ts).alias("session_end"))
    return sessions.select(key, F.col("s.start").alias("session_start"), "session_end",
                           "n_events")


def scan_stream(code_rows: DataFrame, code: str = "code",
                rules: Sequence[Rule] = fixed.DEFAULT_RULES) -> DataFrame:
    """Findings for arriving code: the batch detector is stateless, so it runs as it is."""
    return detect.detect(code_rows, code, rules)


def watch_tree(spark: SparkSession, root: str, state: str, output: str,
               rules: Sequence[Rule] = fixed.DEFAULT_RULES, every: str = "1 minute") -> DataStreamWriter:
    """Scan a tree again and again, each time only what changed (`plans.jobs.scan_changes`).

    A clock starts the micro-batches; what has been scanned is in the table `state`, not in the
    stream's own state, so a batch that is repeated after a restart finds nothing to do.
    """
    from ..plans.jobs import scan_changes

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return (clock.writeStream.trigger(processingTime=every)
            .option("checkpointLocation", f"{state}/clock")
            .foreachBatch(lambda batch, n: scan_changes(spark, root, state, output, rules)))


def append_batches(stream: DataFrame, path: str, name: str) -> DataStreamWriter:
    """Write each micro-batch to its own folder, so a repeated batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/part={batch_id}")

    return stream.writeStream.foreachBatch(write).option(
        "checkpointLocation", f"{checkpoint_dir(stream.sparkSession)}/{name}")
