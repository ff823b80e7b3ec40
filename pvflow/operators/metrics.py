"""Operational metrics: counters, gauges, rates, deltas and the metrics text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.functions.maps import last_wins
from pvflow.operators.joins import lookup_join
from pvflow.operators.ordered import carry, running_sum, slice_width

# Fixed value: a sample line is a name, an optional label block and a number.
SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(?:\{([^}]*)\})?\s+([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)"


def events_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_events"))


def event_rate(events: DataFrame, window_sec: int = 5, per_sec: int = 1) -> DataFrame:
    """Whole events per ``per_sec`` in tumbling windows."""
    start = F.floor(F.col("ts_us") / (window_sec * 1_000_000)) * (window_sec * 1_000_000)
    counted = events.groupBy(start.cast("bigint").alias("window_us")).agg(F.count(F.lit(1)).alias("n_events"))
    return counted.withColumn("rate", F.expr(f"n_events * {per_sec} div {window_sec}"))


def mean_duration(calls: DataFrame) -> DataFrame:
    """Mean processing time per PV in µs out of ``duration_ns``."""
    mean = F.sum("duration_ns").cast("double") / F.count(F.lit(1)) / 1000.0
    return calls.groupBy("pv_name").agg(mean.alias("mean_us"), F.count(F.lit(1)).alias("invocations"))


def backlog(drains: DataFrame, window_sec: int) -> DataFrame:
    """Drained backlog per PV and flush window; windows without any are left out."""
    start = (F.floor(F.col("ts_us") / (window_sec * 1_000_000)) * (window_sec * 1_000_000)).cast("bigint")
    summed = drains.groupBy("pv_name", start.alias("window_us")).agg(F.sum("drained").alias("drained"))
    return summed.where("drained > 0")


def counter_deltas(samples: DataFrame, labels: list[str], *, width: int | None = None) -> DataFrame:
    """Increments out of absolute samples: the first counts whole, a reset or no progress adds 0."""
    if width is None:
        width = slice_width(samples, "ts_us")
    seen = carry(samples, labels, "ts_us", ["seq"], F.col("value"), "_prev", width=width, strict=True)
    delta = F.when(F.col("_prev").isNull(), F.col("value")).otherwise(
        F.greatest(F.col("value") - F.col("_prev"), F.lit(0))
    )
    return seen.withColumn("delta", delta).drop("_prev")


def counter_totals(samples: DataFrame, labels: list[str], *, width: int | None = None) -> DataFrame:
    return counter_deltas(samples, labels, width=width).groupBy(*labels).agg(F.sum("delta").alias("total"))


def rollup(samples: DataFrame, labels: list[str]) -> DataFrame:
    """Counters add up, gauges keep the last value set, per metric and label set."""
    newest = F.max_by("value", F.struct("ts_us", "seq"))
    return (
        samples.groupBy("name", "kind", *labels)
        .agg(F.sum("value").alias("_sum"), newest.alias("_last"))
        .withColumn("value", F.when(F.col("kind") == "counter", F.col("_sum")).otherwise(F.col("_last")))
        .drop("_sum", "_last")
    )


def parse_text(lines: DataFrame, line: str = "line") -> DataFrame:
    """Metrics text -> name, labels, value; comments, blank and foreign lines drop out."""
    text = F.col(line)
    found = lines.where(text.rlike(SAMPLE) & ~text.startswith("#"))
    items = F.filter(
        F.transform(F.split(F.regexp_extract(text, SAMPLE, 2), ","), lambda x: F.trim(x)), lambda x: F.contains(x, F.lit("="))
    )
    quoted = '^"(.*)"$'
    pairs = F.transform(
        items,
        lambda x: F.struct(
            F.substring_index(x, "=", 1).alias("key"),
            F.regexp_replace(_after(x), quoted, "$1").alias("value"),
        ),
    )
    return found.select(
        *[c for c in lines.columns if c != line],
        F.regexp_extract(text, SAMPLE, 1).alias("name"),
        last_wins(pairs).alias("labels"),
        F.regexp_extract(text, SAMPLE, 3).alias("value"),
    )


def _after(item):
    return F.substring(item, F.instr(item, "=") + 1, F.length(item))


def with_labels(samples: DataFrame, name: str, labels: dict[str, str]) -> DataFrame:
    """Samples of one metric whose labels hold all the given values."""
    out = samples.where(F.col("name") == name)
    for key, value in labels.items():
        out = out.where(F.try_element_at("labels", F.lit(key)) == value)
    return out


def retain(messages: DataFrame, max_age_us: int, max_bytes: int, *, width: int | None = None) -> DataFrame:
    """Messages a topic still holds: not older than the age and within the newest bytes.

    messages: topic, ts_us, seq, size.
    """
    newest = messages.groupBy("topic").agg(F.max("ts_us").alias("_newest"))
    young = lookup_join(messages, newest, ["topic"]).where(F.col("ts_us") >= F.col("_newest") - max_age_us)
    if width is None:
        width = slice_width(messages, "ts_us")
    summed = running_sum(
        young, ["topic"], "ts_us", ["seq"], F.col("size").cast("bigint"), "kept_bytes", width=width, backward=True
    )
    return summed.where(F.col("kept_bytes") <= max_bytes).drop("_newest")
