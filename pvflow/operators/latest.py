"""Current state of PVs: last value, liveness, as-of merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.operators.asof import asof_join

BROKEN = ["Fail", "Cancel"]


def last_value(events: DataFrame, payload: list[str] = ["ts_us", "seq", "value"]) -> DataFrame:
    """Last event of every PV; combined before the shuffle."""
    newest = F.max_by(F.struct(*payload), F.struct("ts_us", "seq")).alias("_last")
    return events.groupBy("pv_name").agg(newest).select("pv_name", "_last.*")


def liveness(events: DataFrame) -> DataFrame:
    """A PV is active iff its last event carried data."""
    last = last_value(events, ["ts_us", "seq", "event_type"])
    return last.select("pv_name", (F.col("event_type") == "Data").alias("active"), "event_type", "seq")


def active_total(events: DataFrame) -> DataFrame:
    return liveness(events).agg(F.count_if("active").alias("active_pv"), F.count(F.lit(1)).alias("total_pv"))


def merge_additional(principal: DataFrame, additional: DataFrame, *, width: int | None = None) -> DataFrame:
    """Each principal event with the last additional value at or before it.

    Principal events without an additional value yet are held back.
    """
    return asof_join(principal, additional, ["pv_name"], width=width)


def subscribe_initial(subscriptions: DataFrame, events: DataFrame, *, width: int | None = None) -> DataFrame:
    """The value a new or repeated subscription gets at once: the last one before it."""
    return asof_join(subscriptions, events, ["pv_name"], width=width)


def combined_get(first: DataFrame, second: DataFrame) -> DataFrame:
    """Join the two halves of a get; both must be there and successful.

    Inputs: pv_name, state, value, one row per PV. The state is that of the
    first half if both agree or it failed, else that of the second.
    """
    a = first.select("pv_name", F.col("state").alias("_a"), F.col("value").alias("principal"))
    b = second.select("pv_name", F.col("state").alias("_b"), F.col("value").alias("additional"))
    both = a.join(b, "pv_name", "full_outer")
    done = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    first_wins = (F.col("_a") == F.col("_b")) | F.col("_a").isin(BROKEN)
    state = F.when(~done, "Pending").when(first_wins, F.col("_a")).otherwise(F.col("_b"))
    good = F.col("state") == "Success"
    return both.withColumn("state", state).select(
        "pv_name",
        "state",
        F.when(good, F.col("principal")).alias("principal"),
        F.when(good, F.col("additional")).alias("additional"),
    )
