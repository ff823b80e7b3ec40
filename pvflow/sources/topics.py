"""An ordered log of messages per topic: batches of files and a manifest that commits each of them.

    <path>/data/batch=<n>/attempt=<id>/topic=<name>/*.parquet     messages, with their place in a range partition
    <path>/manifest/batch=<n>/*.parquet                           what belongs to the log, and from which position

A batch goes to many topics at once. It is in the log when its manifest is there, and that is one small file. A batch
that is repeated finds its manifest and does nothing; one that failed half-way leaves files no manifest names, and its
repetition writes others beside them. So each message is read exactly once.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pvflow.operators.joins import lookup_join

#: ``monotonically_increasing_id`` counts the rows of a partition in its lower bits.
_ROW_BITS = 33
_PLACE = "_place"
_MANIFEST = "attempt string, topic string, part bigint, first bigint, rows bigint, ord bigint, batch bigint"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per (batch, topic, range partition): its rows, the place of the first and that row's position."""
    try:
        return spark.read.schema(_MANIFEST).option("basePath", f"{path}/manifest").parquet(f"{path}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def _committed(spark: SparkSession, path: str, batch: int) -> bool:
    return not manifest(spark, path).where(F.col("batch") == batch).isEmpty() or _is_there(spark, f"{path}/manifest/batch={batch}")


def _is_there(spark: SparkSession, folder: str) -> bool:
    """A manifest without rows is that of a batch without messages."""
    try:
        spark.read.schema("rows bigint").parquet(folder)
        return True
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def append(messages: DataFrame, path: str, order: Sequence[str], batch: int = 0, *, attempt: str | None = None) -> None:
    """Add a batch: within each topic its messages follow those of earlier batches, in the order of ``order``.

    Ranges of (topic, order) go to one task each, so that a busy topic is split and no task holds a topic. Each row
    keeps its place in its range; the positions in the topic follow from the sizes of the ranges before it, a few
    numbers per range that go into the manifest. The messages are written once. ``order`` should order a topic
    totally; ties take any order, but the same one for every reader. Messages without a topic go nowhere.
    """
    spark = messages.sparkSession
    if _committed(spark, path, batch):
        return
    attempt = attempt or uuid.uuid4().hex
    folder = f"{path}/data/batch={batch}/attempt={attempt}"
    ranged = messages.where("topic IS NOT NULL").repartitionByRange("topic", *order).sortWithinPartitions("topic", *order)
    ranged.withColumn(_PLACE, F.monotonically_increasing_id()).write.partitionBy("topic").parquet(folder)

    part = F.shiftright(_PLACE, _ROW_BITS).alias("part")
    written = spark.read.schema(f"{_PLACE} bigint, topic string").parquet(folder)
    ranges = written.groupBy("topic", part).agg(F.min(_PLACE).alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("topic").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = manifest(spark, path).groupBy(F.col("topic").alias("_of")).agg(F.max(F.col("ord") + F.col("rows")).alias("_end"))
    placed = ranges.join(ends, F.col("topic") == F.col("_of"), "left").select(
        F.lit(attempt).alias("attempt"),
        "topic",
        "part",
        "first",
        "rows",
        (F.coalesce(F.sum("rows").over(before), F.lit(0)) + F.coalesce("_end", F.lit(0))).alias("ord"),
    )
    placed.coalesce(1).write.parquet(f"{path}/manifest/batch={batch}")


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The messages of all committed batches with ``ord``, their position in the topic from 0 without gaps.

    ``schema`` are the columns of the messages but for the topic.
    """
    data = spark.read.schema(f"{schema}, {_PLACE} bigint, batch bigint, attempt string, topic string")
    rows = data.option("basePath", f"{path}/data").parquet(f"{path}/data")
    rows = rows.withColumn("part", F.shiftright(_PLACE, _ROW_BITS))
    known = manifest(spark, path).drop("rows")
    met = lookup_join(rows, known, ["batch", "attempt", "topic", "part"])
    return met.withColumn("ord", F.col("ord") + F.col(_PLACE) - F.col("first")).drop("batch", "attempt", "part", "first", _PLACE)
