"""Writers: topics, the value archive and the snapshot blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvflow.operators.replay import calendar
from pvflow.session import work_dir

SER_HEADER = "ser-type"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared checkpoint folder and read back, for what several plans start from."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def out_messages(df: DataFrame, topic: Column, key: Column, value: Column, serialization: Column, *keep: str) -> DataFrame:
    """Kafka-shaped rows: topic, key, value, headers with the serialization."""
    header = F.struct(F.lit(SER_HEADER).alias("key"), serialization.cast("string").cast("binary").alias("value"))
    return df.select(
        topic.alias("topic"), key.alias("key"), value.cast("binary").alias("value"), F.array(header).alias("headers"), *keep
    )


def write_topics_kafka(messages: DataFrame, servers: str) -> None:
    """To Kafka; needs the connector on the class path."""
    messages.select("topic", "key", "value", "headers").write.format("kafka").option(
        "kafka.bootstrap.servers", servers
    ).option("includeHeaders", "true").save()


def write_topics(messages: DataFrame, path: str, mode: str = "append") -> None:
    """To files with the same columns, one folder per topic."""
    messages.write.mode(mode).partitionBy("topic").parquet(path)


def write_pv_values(values: DataFrame, path: str) -> None:
    """The value archive by date, rows of a PV in time order within each file.

    Ranges of (date, PV, time) go to one task each: a busy PV is split where it has many rows, a date
    has few files, and min/max statistics on (pv, ts_us) are tight.
    """
    (
        values.repartitionByRange("date", "pv", "ts_us")
        .sortWithinPartitions("date", "pv", "ts_us", "seq")
        .write.mode("append")
        .partitionBy("date")
        .option("compression", "zstd")
        .parquet(path)
    )


def write_index(index: DataFrame, path: str) -> None:
    """The snapshot index in order of time, so that a range reads few row groups."""
    index.repartitionByRange("snapshot_us", "snapshot_id").sortWithinPartitions("snapshot_us").write.mode("append").parquet(path)


def write_blobs(blobs: DataFrame, path: str) -> None:
    """Snapshot rows under year/month/day, sorted by snapshot.

    Ranges of (day, snapshot, PV) go to one task each; no task has to hold a
    whole day or a whole snapshot.
    """
    (
        blobs.withColumns(calendar(F.col("snapshot_us")))
        .repartitionByRange("year", "month", "day", "snapshot_id", "pv_name")
        .sortWithinPartitions("year", "month", "day", "snapshot_id", "pv_name")
        .write.mode("append")
        .partitionBy("year", "month", "day")
        .option("compression", "zstd")
        .parquet(path)
    )
