"""Snapshots on streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.operators import snapshots as snap
from pvflow.streaming.stateful import InOrder, ending, in_order, run
from pvflow.streaming.triggers import triggered_stream

RUN = snap.RUN


class WindowEnds(InOrder):
    """Per (run, PV): windows by their ends. Base of operators that say something when the watermark passes the end of a window.

    The last event of every window that is still open waits; of past ones the last value is remembered, with its window
    (``own``) and the next window to end. Events of a window whose end the watermark has passed are late and dropped. After
    the last window of a run all of its state goes.
    """

    keys = [*RUN, "pv_name"]
    waiting = "queue_name string, start_us long, pv_name string, iter_index long, ts_us long, seq long, value double, window_us long, stop_us long"
    kept = f"{waiting}, next_iter long"

    def due(self, rows):
        end = rows["start_us"].to_numpy() + rows["iter_index"].to_numpy() * rows["window_us"].to_numpy()
        return -(-np.minimum(end, rows["stop_us"].to_numpy()) // 1000)

    def arrive(self, rows):
        rows = rows.sort_values(["ts_us", "seq"])
        return rows.drop_duplicates([*self.keys, "iter_index"], keep="last")

    def wake(self, kept):
        return self.due(kept.assign(iter_index=kept["next_iter"]))

    def work(self, ready, kept, passed):
        ready = self.arrive(ready)
        rows = pd.concat([kept, ready.assign(next_iter=ready["iter_index"])], ignore_index=True)
        rows, _, ends = in_order(rows, self.keys, ["iter_index"])
        start, window, stop = (rows[c].to_numpy() for c in ("start_us", "window_us", "stop_us"))
        ended = stop <= passed * 1000
        # the last window that the watermark has passed; each row holds from its window up to the next row's
        newest = np.where(ended, -(-(stop - start) // window), (passed * 1000 - start) // window)
        until = np.append(rows["iter_index"].to_numpy()[1:] - 1, 0)
        until[ends] = newest[ends]
        left = rows.iloc[ends[~ended[ends]]]
        self.left = left.assign(next_iter=np.maximum(left["next_iter"], newest[left.index] + 1))
        count = np.maximum(until - rows["next_iter"].to_numpy() + 1, 0)
        at = np.repeat(np.arange(len(rows)), count)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
        held = rows.iloc[at].reset_index(drop=True)
        yield from self.say(held, held["next_iter"].to_numpy() + nth)

    def say(self, held: pd.DataFrame, window: np.ndarray) -> Iterator[pd.DataFrame]:
        """Output for windows that have ended, each with the last value there is at its end."""
        raise NotImplementedError


class Carried(WindowEnds):
    """A value at the end of every window from the first with an event on; one without repeats the value before it."""

    output = ["queue_name", "start_us", "pv_name", "iter_index", "to_us", "ts_us", "seq", "value"]

    def say(self, held, window):
        end = held["start_us"] + window * held["window_us"]
        yield held.assign(iter_index=window, to_us=np.minimum(end, held["stop_us"]))


def window_rows(routed: DataFrame) -> DataFrame:
    """The columns of ``WindowEnds``; a run without a stop has one far away."""
    return routed.select(
        *RUN, "pv_name", "ts", "ts_us", "seq", "value", F.coalesce("stop_us", F.lit(2**62)).alias("stop_us"),
        snap.iteration().alias("iter_index"), snap.window_us().alias("window_us"),
    )


def normal_stream(routed: DataFrame) -> DataFrame:
    """Repeating NORMAL snapshots of a routed, watermarked stream, window by window."""
    schema = "queue_name STRING, start_us BIGINT, pv_name STRING, iter_index BIGINT, to_us BIGINT, ts_us BIGINT, seq BIGINT, value DOUBLE"
    return run(window_rows(routed), Carried(), schema)


def window_last(routed: DataFrame) -> DataFrame:
    """Last value per (run, PV, window) of a routed, watermarked stream; the windows are those of each run."""
    rows = routed.withColumn("iter_index", snap.iteration()).withColumn("to_us", snap.window_end())
    at = F.struct("ts_us", "seq")
    last = F.max_by(F.struct("ts_us", "seq", "value"), at).alias("last")
    keys = [*RUN, "pv_name", "iter_index", "to_us"]
    return rows.select(*keys, ending(F.col("to_us")), "ts_us", "seq", "value").groupBy(*keys, "ended").agg(last).select(*keys, "last.*")


def triggered(routed: DataFrame, triggers: DataFrame, buffered: bool) -> DataFrame:
    """Triggered snapshots of a routed stream: every event goes to the next trigger of its run only.

    triggers: queue_name, start_us, ts, ts_us, seq, window_us of the run; both streams are watermarked on ts.
    """
    events = routed.select(
        *RUN, "ts", "ts_us", F.lit(0).alias("side"), "seq", "pv_name", "value", snap.window_us().alias("window_us")
    )
    fired = triggers.select(
        *RUN, "ts", "ts_us", F.lit(1).alias("side"), "seq",
        F.lit(None).cast("string").alias("pv_name"), F.lit(None).cast("double").alias("value"), "window_us",
    )
    return triggered_stream(events.unionByName(fired), buffered)
