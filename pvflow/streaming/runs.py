"""Common parts of the streaming forms: watermark, dedup, exactly-once table sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB provider."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def watched(events: DataFrame, delay: str, unique: str | None = None) -> DataFrame:
    """Watermark on ``ts``; with ``unique`` repeated deliveries within the delay are dropped."""
    out = events.withWatermark("ts", delay)
    return out.dropDuplicatesWithinWatermark([unique]) if unique else out


def heartbeats(events: DataFrame, beats: DataFrame) -> DataFrame:
    """Events and a stream of heartbeats (ts, and any other columns of the events) as one stream.

    A watermark stands still when sources do. A heartbeat has the empty PV name: it moves the watermark on and
    meets no snapshot or subscription.
    """
    return events.unionByName(beats.withColumn("pv_name", F.lit("")), allowMissingColumns=True)


def drain(stream: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Run everything available into a Parquet table and read it back.

    The file sink commits per batch in its log, so a restart neither loses nor
    repeats rows.
    """
    writer = stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("checkpointLocation", f"{path}-checkpoint").start(path).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, path: str, plan: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a batch plan to every micro-batch and keep the results as a table.

    Each batch overwrites its own folder: a repeated batch leaves the same rows.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}-checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*").drop("batch")
