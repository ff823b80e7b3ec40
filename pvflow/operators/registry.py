"""Subscriptions: registry document, upserts, reference counts and retirement.

subscription rows: pv_name, channel_destination, event_serialization (+ id or
ts_us, processed, start_purge_ts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvflow.operators.joins import lookup_join
from pvflow.operators.ordered import carry, running_low, running_sum, slice_width

ENTRY = ["pv_name", "channel_destination", "event_serialization"]
DOCUMENT = "pv_monitor_map array<struct<key:string,dest:string,ser:int>>"
PURGE_TIMEOUT_US = 3600 * 1_000_000  # fixed value: default time without consumers


def load_documents(documents: DataFrame, text: str = "document") -> DataFrame:
    """Registry documents -> subscription rows."""
    return documents.select(
        *[c for c in documents.columns if c != text], F.inline(F.from_json(text, DOCUMENT)["pv_monitor_map"])
    ).withColumnsRenamed({"key": "pv_name", "dest": "channel_destination", "ser": "event_serialization"})


def dump_documents(subscriptions: DataFrame, by: list[str], documents_per_node: int = 1) -> DataFrame:
    """Subscription rows -> registry documents per node, entries in order.

    A node has one document, as the reader of a registry expects. Where a node holds more than fits in one
    value, ``documents_per_node`` spreads its entries by hash over that many, told apart by ``part``; loading all
    of them gives the same rows. The number is the caller's choice and never follows from the data.
    """
    if documents_per_node > 1:
        part = F.pmod(F.xxhash64(*ENTRY), F.lit(documents_per_node)).cast("int")
        subscriptions, by = subscriptions.withColumn("part", part), [*by, "part"]
    entry = F.struct(
        F.col("pv_name").alias("key"),
        F.col("channel_destination").alias("dest"),
        F.col("event_serialization").alias("ser"),
    )
    entries = F.array_sort(F.collect_list(entry)).alias("pv_monitor_map")
    grouped = subscriptions.groupBy(*by).agg(entries)
    return grouped.select(*by, F.to_json(F.struct("pv_monitor_map")).alias("document"))


def add_entries(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """The entries of ``wanted`` that are new, each once."""
    return wanted.select(*ENTRY).distinct().join(registry.select(*ENTRY), ENTRY, "left_anti")


def remove_entries(registry: DataFrame, unwanted: DataFrame) -> DataFrame:
    return registry.join(unwanted.select(*ENTRY).distinct(), ENTRY, "left_anti")


def consumer_counts(subscriptions: DataFrame, members: DataFrame, excluded: list[str]) -> DataFrame:
    """Consumer groups with members per subscription, without the excluded ones.

    members: topic, group_name, member_id (null: the group has none).
    """
    live = members.where("member_id IS NOT NULL")
    if excluded:
        live = live.where(~group_excluded(F.col("group_name"), excluded))
    groups = live.groupBy("topic").agg(F.countDistinct("group_name").alias("consumers"))
    counted = lookup_join(
        subscriptions, groups.withColumnRenamed("topic", "channel_destination"), ["channel_destination"], "left"
    )
    return counted.withColumn("consumers", F.coalesce("consumers", F.lit(0)))


def group_excluded(name: Column, patterns: list[str]) -> Column:
    """The whole name matches one of the patterns."""
    return name.rlike("^(?:" + "|".join(patterns) + ")$")


def distinct_pvs(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.select("pv_name").distinct()


def upsert(requests: DataFrame, order: str = "id") -> DataFrame:
    """One row per (PV, destination): the first request's serialization, how many asked, purge mark unset."""
    return requests.groupBy("pv_name", "channel_destination").agg(
        F.min_by("event_serialization", order).alias("event_serialization"),
        F.count(F.lit(1)).alias("counter"),
        F.lit(False).alias("processed"),
        F.lit(-1).cast("bigint").alias("start_purge_ts"),
    )


def reference_counts(changes: DataFrame, *, width: int | None = None) -> DataFrame:
    """Users per PV after each +1 / -1 ``delta``; never below 0, and at 0 the PV is dropped.

    The clamped walk equals the running sum minus its lowest point below zero.
    """
    if width is None:
        width = slice_width(changes, "ts_us")
    walked = running_low(changes, ["pv_name"], "ts_us", ["seq"], F.col("delta"), "_sum", "_low", width=width)
    users = F.col("_sum") - F.least(F.col("_low"), F.lit(0))
    return walked.withColumn("users", users).withColumn("monitored", users > 0).drop("_sum", "_low")


def start_actions(requests: DataFrame, *, width: int | None = None) -> DataFrame:
    """The first request of a (PV, destination) starts it, later ones only force an update."""
    if width is None:
        width = slice_width(requests, "ts_us")
    seen = carry(
        requests, ["pv_name", "channel_destination"], "ts_us", ["seq"], F.lit(True), "_seen", width=width, strict=True
    )
    return seen.withColumn("action", F.when(F.col("_seen"), "force_update").otherwise("start")).drop("_seen")


def purge(scans: DataFrame, keys: list[str], timeout_us: int = PURGE_TIMEOUT_US, *, width: int | None = None) -> DataFrame:
    """What each scan does: clear the mark, set it, wait, or stop the subscription.

    scans: keys, ts_us, seq, consumers. A run without consumers is marked by its
    first scan and stopped by the first scan later than the time-out; scans of
    the same run after that find nothing (``gone``).
    """
    if width is None:
        width = slice_width(scans, "ts_us")
    empty = F.col("consumers") == 0
    at = carry(scans, keys, "ts_us", ["seq"], empty, "_before", width=width, strict=True)
    opens = empty & ~F.coalesce(F.col("_before"), F.lit(False))
    at = carry(at, keys, "ts_us", ["seq"], F.when(opens, F.col("ts_us")), "_mark", width=width)
    at = at.withColumn("mark_us", F.when(empty, F.col("_mark")))
    late = empty & (F.col("ts_us") - F.col("mark_us") > timeout_us)
    at = at.withColumn("_late", late)
    stop = F.when(F.col("_late"), F.col("mark_us"))
    at = carry(at, keys, "ts_us", ["seq"], stop, "_stopped", width=width, strict=True)
    action = (
        F.when(~empty, "clear")
        .when(F.col("ts_us") == F.col("mark_us"), "mark")
        .when(F.col("_stopped") == F.col("mark_us"), "gone")
        .when(F.col("_late"), "stop")
        .otherwise("wait")
    )
    return at.withColumn("action", action).drop("_before", "_mark", "_late", "_stopped")


def process_batch(subscriptions: DataFrame, limit: int | None = None) -> DataFrame:
    """Unprocessed subscriptions of each PV with a running index from 0, the first ``limit`` of them.

    A limit is applied per task before the shuffle.
    """
    open_rows = subscriptions.where("NOT processed")
    width = slice_width(open_rows, "id", cell=1000) if limit is None else 0
    if limit is not None:
        rank = F.row_number().over(Window.partitionBy("pv_name").orderBy("id"))
        return open_rows.withColumn("idx", rank).where(F.col("idx") <= limit).withColumn("idx", F.col("idx") - 1)
    one = F.lit(1).cast("bigint")
    return running_sum(open_rows, ["pv_name"], "id", [], one, "idx", width=width).withColumn("idx", F.col("idx") - 1)


def merge_changes(subscriptions: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply all changes of each (PV, destination), column by column.

    changes: pv_name, channel_destination, change_seq, deleted, processed,
    start_purge_ts (null: keep). A deleted row is gone: later changes of a flag or mark find nothing. Each column
    takes its own latest change. Both sides have one row per key in the join.
    """
    key = ["pv_name", "channel_destination"]
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("change_seq")))
    last = changes.groupBy(*key).agg(
        F.bool_or(F.coalesce("deleted", F.lit(False))).alias("_deleted"),
        newest("processed").alias("_processed"),
        newest("start_purge_ts").alias("_mark"),
    )
    merged = subscriptions.join(last, key, "left").where("_deleted IS NULL OR NOT _deleted")
    return merged.withColumns(
        {"processed": F.coalesce("_processed", "processed"), "start_purge_ts": F.coalesce("_mark", "start_purge_ts")}
    ).drop("_deleted", "_processed", "_mark")
