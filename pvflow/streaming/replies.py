"""Get and put on streams: each command meets the first event of its PV within the time-out, or times out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.functions.names import is_pv_uri, pv_parts
from pvflow.operators import commands as C
from pvflow.streaming.stateful import InOrder, in_order, run

_FAILED = ["Fail", "Cancel"]


class Answers(InOrder):
    """Each command (side 0) with the first event (side 1) of its name from its time up to ``until_us``, once its bound has passed.

    Commands wait until then; of the events that have passed those are remembered that a command may still ask for.
    """

    keys = ["name"]
    kept = "name string, ts_us long, side int, seq long, event_type string, value double"

    def __init__(self, wait_us: int, waiting: str, output: list[str]):
        self.wait_us, self.waiting, self.output = wait_us, waiting, output

    def live(self, rows):
        return (rows["side"] == 0) | super().live(rows)  # a command without a PV is answered too

    def due(self, rows):
        return np.where(rows["side"] == 0, rows["until_us"], rows["ts_us"]) // 1000 + 1

    def wake(self, kept):
        return np.array([int(kept["ts_us"].max() + self.wait_us) // 1000 + 1] if len(kept) else [], "int64")

    def work(self, ready, kept, passed):
        events = pd.concat([kept, ready.loc[ready["side"] == 1, kept.columns]], ignore_index=True)
        self.left = events[events["ts_us"] >= passed * 1000 - self.wait_us]
        asked = ready[ready["side"] == 0].drop(columns=["event_type", "value"]).drop_duplicates()
        if not len(asked):
            return
        rows = pd.concat([asked, events], ignore_index=True)
        rows, first, _ = in_order(rows, self.keys, ["ts_us", "side", "seq"])
        event = rows["side"].to_numpy() == 1
        after = np.minimum.accumulate(np.where(event, np.arange(len(rows)), len(rows))[::-1])[::-1]
        hit = np.minimum(after, len(rows) - 1)
        ts = rows["ts_us"].to_numpy()
        met = (after < len(rows)) & (first[hit] == first) & (ts[hit] <= rows["until_us"].to_numpy())
        answer = rows.iloc[hit].reset_index(drop=True)
        out = rows.rename(columns={"seq": "cmd_seq"}).assign(met=met, event_type=answer["event_type"], value=answer["value"])
        for c in ("ts_us", "seq"):
            out[f"hit_{c}"] = answer[c]
        yield out[~event]


def first_within(commands: DataFrame, events: DataFrame, timeout: str, delay: str, keep: list[str]) -> DataFrame:
    """Each command with ``hit``, the first event of ``name`` from its time up to ``timeout`` later, null if none came.

    commands: name, cmd_seq, ts and the columns ``keep``, not watermarked yet: their event time is the time bound, and
    ``delay`` how late they come. events: pv_name, ts, ts_us, seq, event_type, value, watermarked on ts. Both go as one stream
    through keyed state, where a command waits until the watermark has passed its time bound. It looks up its one answer, so the cost
    is that of commands plus events, however many events a command could see; one row per command leaves.
    """
    until = F.col("ts") + F.expr(f"INTERVAL {timeout}")
    asked = commands.select(
        "name", until.alias("ts"), F.unix_micros("ts").alias("ts_us"), F.lit(0).alias("side"), F.col("cmd_seq").alias("seq"),
        F.unix_micros(until).alias("until_us"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value"), *keep,
    ).withWatermark("ts", delay)
    kinds = {f.name: f.dataType for f in asked.schema if f.name in keep}
    said = events.select(
        F.col("pv_name").alias("name"), "ts", "ts_us", F.lit(1).alias("side"), "seq",
        F.lit(0).cast("bigint").alias("until_us"), "event_type", "value", *[F.lit(None).cast(kinds[c]).alias(c) for c in keep],
    )
    names = {"bigint": "long"}
    extra = [(c, kinds[c].simpleString()) for c in keep]
    waiting = "name string, ts_us long, side int, seq long, until_us long, event_type string, value double"
    waiting = ", ".join([waiting, *[f"{c} {names.get(kind, kind)}" for c, kind in extra]])
    schema = ["name STRING", "cmd_seq BIGINT", *[f"{c} {kind}" for c, kind in extra]]
    schema += ["met BOOLEAN", "hit_ts_us BIGINT", "hit_seq BIGINT", "event_type STRING", "value DOUBLE"]
    wait_us = pd.Timedelta(timeout).value // 1000
    answers = Answers(wait_us, waiting, [field.split()[0] for field in schema])
    met = run(asked.unionByName(said), answers, ", ".join(schema))
    hit = F.struct(F.col("hit_ts_us").alias("ts_us"), F.col("hit_seq").alias("seq"), "event_type", "value")
    return met.select("name", "cmd_seq", *keep, F.when(F.col("met"), hit).alias("hit"))


def _named(commands: DataFrame) -> DataFrame:
    return commands.withColumn("name", F.coalesce(pv_parts(F.col("pv_name"))["name"], F.lit("")))


def get_stream(gets: DataFrame, events: DataFrame, timeout: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Answer of each get with a reply topic: -1 malformed PV, -2 the event says fail or cancel, -3 none in time, else 0 and the value."""
    asked = _named(C.answered(gets))
    met = first_within(asked, events, timeout, delay, ["pv_name", "reply_topic"])
    bad, state = ~is_pv_uri(F.col("pv_name")), F.col("hit.event_type")
    error = F.when(bad, -1).when(state.isNull(), -3).when(state.isin(_FAILED), -2).otherwise(0)
    message = F.when(bad, C.PV_MALFORMED).when(state.isNull(), C.TIMED_OUT).when(state == "Fail", "Operation failed").when(state == "Cancel", C.GET_CANCELLED)
    good = error == 0
    return met.select(
        "cmd_seq",
        "reply_topic",
        error.alias("error"),
        message.alias("message"),
        F.when(good, F.col("hit.value")).alias("value"),
        F.when(good, F.col("hit.seq")).alias("seq"),
    )


def put_stream(puts: DataFrame, events: DataFrame, timeout: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Outcome of each put with a reply topic and id: payload errors first, then what the first event within the time-out says, -3 if none."""
    checked = _named(C.put_errors(C.answered(puts, "reply_id")))
    met = first_within(checked, events, timeout, delay, ["error", "message", "reply_topic", "reply_id"])
    ok, state = F.col("error") == 0, F.col("hit.event_type")
    error = F.when(~ok, F.col("error")).when(state.isNull(), -3).when(state.isin(_FAILED), -2).otherwise(0)
    message = (
        F.when(~ok, F.col("message"))
        .when(state.isNull(), C.TIMED_OUT)
        .when(state == "Fail", "Put operation has failed")
        .when(state == "Cancel", C.PUT_CANCELLED)
        .otherwise(F.col("message"))
    )
    return met.select("cmd_seq", "reply_topic", "reply_id", error.alias("error"), message.alias("message"))
