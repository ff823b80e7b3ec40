"""Silent PVs on streams: what is fed into their next window, and the pushes within a window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.operators import snapshots as snap
from pvflow.streaming.snapshots import RUN, WindowEnds, window_rows
from pvflow.streaming.stateful import ending, run


class Silence(WindowEnds):
    """Per (run, PV): when a window ends without an event, the last value known is fed into the next window.

    A fed value counts as an event of the window it goes to, so while a PV stays silent every second window is fed.
    Nothing is fed before a first event.
    """

    output = ["queue_name", "start_us", "pv_name", "iter_index", "ts_us", "seq", "value"]

    def say(self, held, window):
        silent = window - held["iter_index"]  # windows since the last one with an event
        last = held["start_us"] + window * held["window_us"] >= held["stop_us"]
        fed = (silent % 2 == 1) & ~last
        yield held.assign(iter_index=window + 1)[fed]


def forced_stream(routed: DataFrame) -> DataFrame:
    """Values fed into windows of silent PVs, from a routed stream watermarked on ts; the rows of ``snapshots.forced``."""
    schema = "queue_name STRING, start_us BIGINT, pv_name STRING, iter_index BIGINT, ts_us BIGINT, seq BIGINT, value DOUBLE"
    fed = run(window_rows(routed), Silence(), schema)
    return fed.withColumn("forced", F.lit(True))


def push_stream(routed: DataFrame) -> DataFrame:
    """Early pushes: per (run, PV, window, push) how many events it holds and the first and last of them.

    A push leaves when it has ended, before its window has; state holds one row of counts for each that has not. routed: watermarked on ts, with sub_push_delay_msec.
    """
    push_us = F.greatest(snap.push_delay_msec() * 1000, F.lit(1))
    rows = routed.withColumn("iter_index", snap.iteration())
    rows = rows.withColumn("sub_index", F.call_function("div", F.col("ts_us") - snap.window_start(), push_us))
    end_us = F.least(snap.window_start() + (F.col("sub_index") + 1) * push_us, F.coalesce(snap.window_end(), F.lit(2**62)))
    keys = [*RUN, "pv_name", "iter_index", "sub_index"]
    counts = [F.count("seq").alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")]
    return rows.select(*keys, ending(end_us), "seq").groupBy(*keys, "ended").agg(*counts).drop("ended")
