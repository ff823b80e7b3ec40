"""Copy events to their subscribers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvflow.operators.joins import lookup_join


def monitor_fanout(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each data event once per (destination, serialization) subscribed to its PV."""
    subs = subscriptions.select("pv_name", "channel_destination", "event_serialization").distinct()
    return lookup_join(events.where("event_type = 'Data'"), subs, ["pv_name"])


def encode_once(events: DataFrame, subscriptions: DataFrame, encoders: dict[int, Column], since: str | None = None) -> DataFrame:
    """Messages of a fan-out whose payload is built once per (event, serialization).

    The encoders run below the fan-out join, each only for PVs that have a
    subscriber of that serialization. With ``since``, a column of the subscriptions, a subscription takes
    the events from that time on; one that is asked for again counts from the first time.
    """
    first = F.min(since) if since else F.min(F.lit(0))
    subs = subscriptions.groupBy("pv_name", "channel_destination", "event_serialization").agg(first.cast("bigint").alias("_since"))
    n_subs = subs.count()
    flags = subs.groupBy("pv_name").agg(
        *[F.min(F.when(F.col("event_serialization") == s, F.col("_since"))).alias(f"_wants_{s}") for s in encoders]
    )
    data = lookup_join(events.where("event_type = 'Data'"), flags, ["pv_name"], rows=n_subs)
    for s, encoder in encoders.items():
        data = data.withColumn(f"_payload_{s}", F.when(F.col("ts_us") >= F.col(f"_wants_{s}"), encoder))
    sent = lookup_join(data, subs, ["pv_name"], rows=n_subs).where("ts_us >= _since")
    payload = F.coalesce(
        *[F.when(F.col("event_serialization") == s, F.col(f"_payload_{s}")) for s in encoders]
    )
    return sent.select(
        F.col("channel_destination").alias("topic"),
        F.col("pv_name").alias("key"),
        "event_serialization",
        "ts_us",
        "seq",
        payload.alias("value"),
    )
