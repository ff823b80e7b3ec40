"""Readers: command and event streams, from Kafka or from files with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pvflow.functions.maps import first_wins

DEFAULT_KEY = "default-key"  # fixed value: key of messages without one


def kafka_stream(spark: SparkSession, servers: str, topics: str, max_per_trigger: int) -> DataFrame:
    """Messages of topics with headers; needs the connector on the class path."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topics)
        .option("includeHeaders", "true")
        .option("maxOffsetsPerTrigger", max_per_trigger)
        .load()
    )


def file_stream(
    spark: SparkSession, path: str, schema: StructType, glob: str | None = None, max_files: int = 100
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def normalize(messages: DataFrame) -> DataFrame:
    """Headers as a map, the default key where there is none; empty payloads drop out."""
    headers = first_wins(
        F.transform(
            F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")),
            lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")),
        )
    )
    return messages.where(F.length("value") > 0).withColumns(
        {
            "key": F.coalesce(F.col("key").cast("string"), F.lit(DEFAULT_KEY)),
            "headers": headers,
            "value": F.col("value").cast("string"),
        }
    )
