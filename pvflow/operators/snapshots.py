"""Snapshots over a set of PVs: repeating, buffered, triggered and one-shot.

Input shapes
  events   pv_name, ts_us, seq, value (value may be a struct)
  members  queue_name, snapshot_name, start_us, stop_us, time_window_msec, pv_name
           (+ sub_push_delay_msec), one row per (running snapshot, PV)
  triggers queue_name, trigger_us, trigger_seq

A run is one (queue_name, start_us). Its windows are half open, aligned to
start_us and numbered from 1; the last one ends at stop_us. A run with a null
stop is still running: it takes every event, and per-window results reach up to the last
window that the newest event has passed, as only a stop flushes an unfinished one.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pvflow.functions.names import is_pv_uri, pv_parts
from pvflow.operators.intervals import interval_join, interval_width
from pvflow.operators.joins import lookup_join
from pvflow.operators.ordered import (
    TARGET_ROWS,
    carry,
    entering,
    explode_range,
    running_sum,
    slice_of,
    slice_width,
    slice_window,
)

RUN = ["queue_name", "start_us"]
DEFAULT_PUSH_MSEC = 1000  # fixed value: sub-window push when none is asked for

HEADER, DATA, TAIL = 0, 1, 2


def window_us() -> Column:
    return F.greatest(F.col("time_window_msec"), F.lit(1)) * F.lit(1000).cast("bigint")


def iteration(ts_us: str = "ts_us") -> Column:
    """Window number of a routed event (never before the start)."""
    return F.call_function("div", F.col(ts_us) - F.col("start_us"), window_us()) + 1


def iteration_count() -> Column:
    return F.ceil((F.col("stop_us") - F.col("start_us")) / window_us()).cast("bigint")


def window_start(iter_index: str = "iter_index") -> Column:
    return F.col("start_us") + (F.col(iter_index) - 1) * window_us()


def window_end(iter_index: str = "iter_index") -> Column:
    return F.least(F.col("start_us") + F.col(iter_index) * window_us(), F.col("stop_us"))


def push_delay_msec() -> Column:
    """Delay between sub-window pushes for a window and a requested delay."""
    window, asked = F.col("time_window_msec"), F.col("sub_push_delay_msec")
    return (
        F.when((asked > 0) & (asked < window), asked)
        .when(asked > 0, F.when(window > 0, window).otherwise(asked))
        .otherwise(F.least(window, F.lit(DEFAULT_PUSH_MSEC)))
    )


def runs(members: DataFrame) -> DataFrame:
    """The distinct runs behind a members table."""
    return members.drop("pv_name").dropDuplicates(RUN)


class Span(NamedTuple):
    """What one pass over a members table tells: its size, time range and longest run.

    ``slice_us`` above 0 says that runs of a PV follow one another in time, as those of restarted
    snapshots do; events then find their runs by slices of about that length, not by PV alone.
    """

    rows: int
    from_us: int
    to_us: int | None  # None: some run is still open
    peak: int
    slice_us: int = 0


def span(members: DataFrame, slice_us: int = 0) -> Span:
    row = members.agg(
        F.count(F.lit(1)), F.min("start_us"), F.max("stop_us"), F.max(iteration_count()), F.count_if(F.col("stop_us").isNull())
    ).first()
    return Span(row[0], row[1] or 0, None if row[4] else row[2] or 0, row[3] or 0, slice_us)


def until_newest(events: DataFrame, members: DataFrame, known: Span | None = None) -> tuple[DataFrame, Span]:
    """The members with every open run ended after its last finished window, and their span.

    A window of an open run is finished once an event at or past its end is there.
    """
    known = known or span(members)
    if known.to_us is not None:
        return members, known
    newest = F.lit(events.agg(F.max("ts_us")).first()[0]).cast("bigint")
    finished = F.call_function("div", F.greatest(newest - F.col("start_us"), F.lit(0).cast("bigint")), window_us())
    ended = members.withColumn("stop_us", F.coalesce("stop_us", F.col("start_us") + finished * window_us(), "start_us"))
    return ended, span(ended, known.slice_us)


def route(events: DataFrame, members: DataFrame, known: Span | None = None) -> DataFrame:
    """Copy each event to every running snapshot that holds its PV.

    The time range of all runs reaches the scan of the events as a literal.
    """
    known = known or span(members)
    live = events.where(F.col("ts_us") >= known.from_us)
    if known.to_us is not None:
        live = live.where(F.col("ts_us") <= known.to_us)
    if known.slice_us:
        return interval_join(live, members, ["pv_name"], width=known.slice_us)
    routed = lookup_join(live, members, ["pv_name"], rows=known.rows)
    return routed.where("ts_us >= start_us AND (stop_us IS NULL OR ts_us < stop_us)")


def buffered(events: DataFrame, members: DataFrame, known: Span | None = None, routed: DataFrame | None = None) -> DataFrame:
    """Every event of every window, each once, with its iteration and sub-window push.

    Here and below ``routed`` is the outcome of ``route`` where it is at hand already.
    """
    push_us = F.greatest(push_delay_msec() * 1000, F.lit(1))
    rows = route(events, members, known) if routed is None else routed
    rows = rows.withColumn("iter_index", iteration())
    return rows.withColumn("sub_index", F.call_function("div", F.col("ts_us") - window_start(), push_us))


def _latest(routed: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*payload), F.struct("ts_us", "seq")).alias("latest")
    return routed.groupBy(*keys).agg(best).select(*keys, "latest.*")


def _latest_per_window(events: DataFrame, members: DataFrame, known: Span, routed: DataFrame | None = None) -> DataFrame:
    """Last event per (run, PV, window) with the run's columns, grouped on the short key only."""
    routed = route(events, members, known) if routed is None else routed
    routed = routed.withColumn("iter_index", iteration())
    latest = _latest(routed, [*RUN, "pv_name", "iter_index"], ["ts_us", "seq", "value"])
    about = runs(members).select(*RUN, "snapshot_name", "stop_us", "time_window_msec")
    return lookup_join(latest, about, RUN, rows=known.rows)


def _iteration_slice(known: Span) -> int:
    return TARGET_ROWS if known.peak > TARGET_ROWS else 0


def _fill(latest: DataFrame, keys: list[str], last_iter: Column, width: int) -> DataFrame:
    """Repeat each row until the iteration before the key's next one."""
    following = carry(
        latest, keys, "iter_index", [], F.col("iter_index"), "next_iter", width=width, strict=True, backward=True
    )
    filled = following.withColumnRenamed("iter_index", "from_iter")
    upto = F.coalesce(F.col("next_iter") - 1, last_iter)
    return explode_range(filled, F.col("from_iter"), upto, "iter_index").drop("next_iter")


def normal(events: DataFrame, members: DataFrame, known: Span | None = None, routed: DataFrame | None = None) -> DataFrame:
    """Per iteration the last value of every PV seen so far (carried forward).

    Only the last event per (PV, window) is shuffled; the dense result is
    written from it without a grid join. ``carried`` marks repeated values.
    """
    members, known = until_newest(events, members, known)
    latest = _latest_per_window(events, members, known, routed)
    filled = _fill(latest, [*RUN, "pv_name"], iteration_count(), _iteration_slice(known))
    return filled.withColumn("carried", F.col("iter_index") > F.col("from_iter")).drop("from_iter")


def silent(events: DataFrame, members: DataFrame) -> DataFrame:
    """(run, iteration, PV) without an event, with the value known before, if any.

    ``gap_index`` counts the silent windows since the last event from 1.
    """
    members, known = until_newest(events, members)
    latest = _latest_per_window(events, members, known)
    about = [*RUN, "snapshot_name", "stop_us", "time_window_msec", "pv_name"]
    origin = members.select(*about).distinct().withColumn("iter_index", F.lit(0).cast("bigint"))
    marks = latest.unionByName(origin, allowMissingColumns=True)
    following = carry(
        marks,
        [*RUN, "pv_name"],
        "iter_index",
        [],
        F.col("iter_index"),
        "next_iter",
        width=_iteration_slice(known),
        strict=True,
        backward=True,
    ).withColumnRenamed("iter_index", "from_iter")
    upto = F.coalesce(F.col("next_iter") - 1, iteration_count())
    gaps = explode_range(following, F.col("from_iter") + 1, upto, "iter_index")
    return gaps.withColumn("gap_index", F.col("iter_index") - F.col("from_iter")).drop("next_iter", "from_iter")


def forced(events: DataFrame, members: DataFrame) -> DataFrame:
    """Current values injected for silent PVs, arriving in the next window.

    The injected value counts as an event of that window, so within a gap every
    second window is fed.
    """
    members, _ = until_newest(events, members)
    fed = silent(events, members).where("seq IS NOT NULL AND gap_index % 2 = 1")
    return (
        fed.withColumn("iter_index", F.col("iter_index") + 1)
        .where(F.col("iter_index") <= iteration_count())
        .withColumn("forced", F.lit(True))
        .drop("gap_index")
    )


class Plan(NamedTuple):
    """Sizes measured once for a triggered snapshot."""

    members: Span
    triggers: int
    width: int


def plan_triggers(
    events: DataFrame, members: DataFrame, triggers: DataFrame, target_rows: int = TARGET_ROWS, known: Span | None = None
) -> Plan:
    known = known or span(members)
    times = events.select("ts_us").unionAll(triggers.select(F.col("trigger_us").alias("ts_us")))
    return Plan(known, triggers.count() + known.rows, slice_width(times, "ts_us", target_rows))


def number_triggers(triggers: DataFrame, members: DataFrame, plan: Plan, flush_on_stop: bool) -> DataFrame:
    """Triggers of each run, numbered from 1; a stop counts as a last trigger."""
    live = runs(members).select(*RUN, "stop_us")
    if plan.members.slice_us:
        fired = interval_join(triggers, live, ["queue_name"], at="trigger_us", width=plan.members.slice_us)
    else:
        fired = lookup_join(triggers, live, ["queue_name"], rows=plan.members.rows)
        fired = fired.where("trigger_us >= start_us AND (stop_us IS NULL OR trigger_us < stop_us)")
    fired = fired.select(*RUN, "trigger_us", F.col("trigger_seq").alias("_seq"))
    if flush_on_stop:
        stops = live.where("stop_us IS NOT NULL").select(*RUN, F.col("stop_us").alias("trigger_us"), F.lit(2**62).alias("_seq"))
        fired = fired.unionByName(stops)
    one = F.lit(1).cast("bigint")
    return running_sum(fired, RUN, "trigger_us", ["_seq"], one, "iter_index", width=plan.width)


def assign_triggers(events: DataFrame, members: DataFrame, fired: DataFrame, plan: Plan, routed: DataFrame | None = None) -> DataFrame:
    """Each routed event with the next trigger of its run; events after the last one are left out.

    ``newest_us`` is the time of the last event before that trigger. Events and
    triggers of a (run, time slice) meet in one shuffle and two scans of it: one
    forward for the newest event, one backward for the next trigger.
    """
    routed = route(events, members, plan.members) if routed is None else routed
    routed = routed.select(*RUN, "pv_name", "ts_us", "seq", "value", F.lit(0).alias("_side"))
    marks = fired.select(
        *RUN,
        F.col("trigger_us").alias("ts_us"),
        F.col("_seq").alias("seq"),
        F.col("iter_index").alias("_iter"),
        F.lit(1).alias("_side"),
    )
    rows = routed.unionByName(marks, allowMissingColumns=True)
    order = ["_side", "seq"]
    event_at = F.when(F.col("_side") == 0, F.col("ts_us"))
    trigger = F.when(
        F.col("_side") == 1,
        F.struct(
            F.col("ts_us").alias("trigger_us"),
            F.col("_iter").alias("iter_index"),
            F.col("_newest").alias("newest_us"),
        ),
    )
    if plan.width == 0:
        rows = carry(rows, RUN, "ts_us", order, event_at, "_newest", width=0)
        rows = carry(rows, RUN, "ts_us", order, trigger, "_next", width=0, backward=True)
    else:
        heads = _trigger_heads(routed, marks, plan)
        rows = rows.withColumn("_slice", slice_of("ts_us", plan.width)).withColumn("_head", F.lit(1))
        rows = rows.unionByName(heads, allowMissingColumns=True)
        ahead = slice_window(RUN, "ts_us", order, False).rowsBetween(Window.unboundedPreceding, 0)
        back = slice_window(RUN, "ts_us", order, True).rowsBetween(Window.unboundedPreceding, 0)
        known = F.coalesce("_entry_newest", event_at)
        rows = rows.withColumn("_newest", F.last(known, ignorenulls=True).over(ahead))
        rows = rows.withColumn("_next", F.last(F.coalesce("_entry_next", trigger), ignorenulls=True).over(back))
        rows = rows.where("_head = 1")
    assigned = rows.where("_side = 0 AND _next IS NOT NULL").select(*RUN, "pv_name", "ts_us", "seq", "value", "_next.*")
    about = runs(members).select(*RUN, "snapshot_name", "stop_us", "time_window_msec")
    return lookup_join(assigned, about, RUN, rows=plan.members.rows)


def _trigger_heads(routed: DataFrame, marks: DataFrame, plan: Plan) -> DataFrame:
    """One row per (run, slice): the newest event before the slice and the next trigger after it.

    Needs per slice only its first trigger, its newest event and its newest
    event up to that trigger: a plain aggregation, combined before the shuffle.
    """
    cell = [*RUN, "_slice"]
    part = slice_of("ts_us", plan.width).alias("_slice")
    rank = F.struct("ts_us", "seq")
    firsts = (
        marks.select(*RUN, "ts_us", "seq", "_iter", part)
        .groupBy(*cell)
        .agg(F.min_by(F.struct(F.col("ts_us").alias("at"), F.col("_iter").alias("iter")), rank).alias("_first"))
    )
    newest = (
        lookup_join(routed.select(*RUN, "ts_us", part), firsts, cell, "left", rows=plan.triggers)
        .groupBy(*cell)
        .agg(F.max("ts_us").alias("_all"), F.max(F.when(F.col("ts_us") <= F.col("_first.at"), F.col("ts_us"))).alias("_pre"))
    )
    cells = newest.join(firsts, cell, "full_outer").withColumn("_entry_newest", entering("_all", RUN))
    following = F.when(
        F.col("_first").isNotNull(),
        F.struct(
            F.col("_first.at").alias("trigger_us"),
            F.col("_first.iter").alias("iter_index"),
            F.coalesce("_pre", "_entry_newest").alias("newest_us"),
        ),
    )
    cells = cells.withColumn("_following", following).withColumn("_entry_next", entering("_following", RUN, backward=True))
    return cells.select(*cell, F.lit(0).alias("_head"), "_entry_newest", "_entry_next")


def triggered_buffered(
    events: DataFrame,
    members: DataFrame,
    triggers: DataFrame,
    *,
    plan: Plan | None = None,
    flush_on_stop: bool = True,
    fired: DataFrame | None = None,
    routed: DataFrame | None = None,
) -> DataFrame:
    """Events since the previous trigger, no older than the window before the last of them."""
    plan = plan or plan_triggers(events, members, triggers)
    if fired is None:
        fired = number_triggers(triggers, members, plan, flush_on_stop)
    assigned = assign_triggers(events, members, fired, plan, routed)
    return assigned.where(F.col("ts_us") >= F.col("newest_us") - window_us()).drop("newest_us")


def triggered_normal(
    events: DataFrame,
    members: DataFrame,
    triggers: DataFrame,
    *,
    plan: Plan | None = None,
    flush_on_stop: bool = True,
    fired: DataFrame | None = None,
    routed: DataFrame | None = None,
) -> DataFrame:
    """At each trigger the last value of every PV seen so far."""
    plan = plan or plan_triggers(events, members, triggers)
    if fired is None:
        fired = number_triggers(triggers, members, plan, flush_on_stop)
    assigned = assign_triggers(events, members, fired, plan, routed)
    latest = _latest(assigned, [*RUN, "snapshot_name", "pv_name", "iter_index"], ["ts_us", "seq", "value"])
    counts = fired.groupBy(*RUN).agg(F.max("iter_index").alias("last_iter"))
    latest = lookup_join(latest, counts, RUN, rows=plan.members.rows)
    width = TARGET_ROWS if plan.triggers > TARGET_ROWS else 0
    filled = _fill(latest, [*RUN, "pv_name"], F.col("last_iter"), width)
    stamps = fired.select(*RUN, "iter_index", "trigger_us")
    return lookup_join(filled, stamps, [*RUN, "iter_index"], rows=plan.triggers).drop("from_iter", "last_iter")


def windows(members: DataFrame) -> DataFrame:
    """One row per (run, iteration) with its bounds; ``partial`` marks a window cut by the stop."""
    every = explode_range(runs(members), F.lit(1), iteration_count(), "iter_index")
    return every.select(
        *RUN,
        "snapshot_name",
        "iter_index",
        window_start().alias("from_us"),
        window_end().alias("to_us"),
        (window_end() < F.col("start_us") + F.col("iter_index") * window_us()).alias("partial"),
    )


def frames(data: DataFrame, stamps: DataFrame) -> DataFrame:
    """Header, data and tail messages of every iteration.

    ``data`` holds queue_name, start_us, iter_index, sub_index, pv_name, ts_us,
    seq, value; ``stamps`` one row per (run, iteration) with snapshot_name and
    to_us. Order within a queue: start_us, iter_index, message_type, sub_index,
    ts_us, pv_name, seq.
    """
    stamp = F.floor(F.col("to_us") / 1000).cast("bigint").alias("timestamp")
    base = [*RUN, "iter_index"]
    header = stamps.select(*base, "snapshot_name", stamp, F.lit(HEADER).cast("tinyint").alias("message_type"))
    tail = stamps.select(
        *base,
        "snapshot_name",
        stamp,
        F.lit(TAIL).cast("tinyint").alias("message_type"),
        F.lit(0).alias("error"),
        F.lit("").alias("error_message"),
    )
    body = data.select(
        *base,
        stamp,
        F.lit(DATA).cast("tinyint").alias("message_type"),
        "sub_index",
        "pv_name",
        "ts_us",
        "seq",
        "value",
    )
    return body.unionByName(header, allowMissingColumns=True).unionByName(tail, allowMissingColumns=True)


def normal_frames(events: DataFrame, members: DataFrame, known: Span | None = None, routed: DataFrame | None = None) -> DataFrame:
    members, known = until_newest(events, members, known)
    data = normal(events, members, known, routed).withColumn("sub_index", F.lit(0).cast("bigint")).withColumn("to_us", window_end())
    return frames(data, windows(members))


def buffered_frames(events: DataFrame, members: DataFrame, known: Span | None = None, routed: DataFrame | None = None) -> DataFrame:
    members, known = until_newest(events, members, known)
    return frames(buffered(events, members, known, routed).withColumn("to_us", window_end()), windows(members))


def triggered_frames(
    events: DataFrame, members: DataFrame, fired: DataFrame, buffer: bool, plan: Plan, routed: DataFrame | None = None
) -> DataFrame:
    """One iteration per trigger, stamped with its time; ``fired`` out of ``number_triggers``, whose stops fire a last time."""
    snapshot = triggered_buffered if buffer else triggered_normal
    zero = F.lit(0).cast("bigint")
    data = snapshot(events, members, fired, plan=plan, fired=fired, routed=routed)
    data = data.withColumn("sub_index", zero).withColumn("to_us", F.col("trigger_us"))
    stamps = fired.select(*RUN, "iter_index", F.col("trigger_us").alias("to_us"))
    return frames(data, lookup_join(stamps, runs(members).select(*RUN, "snapshot_name"), RUN, rows=plan.members.rows))


def once(events: DataFrame, requests: DataFrame, *, width: int | None = None) -> DataFrame:
    """One-shot snapshots: per PV the first event of the window, else the value before it.

    requests: request_id, reply_topic, reply_id, request_us, time_window_msec,
    pv_name_list. A malformed PV answers with error -1 and ends the list; every
    request closes with a completion row, error 1. Requests without a reply topic have no answer.
    """
    requests = requests.where("reply_topic != ''")
    ids = ["request_id", "reply_topic", "reply_id"]
    bad_at = F.array_position(F.transform("pv_name_list", lambda u: ~is_pv_uri(u)), True) - 1
    items = (
        requests.withColumn("bad_at", F.when(bad_at >= 0, bad_at))
        .select("*", F.posexplode("pv_name_list").alias("element_number", "uri"))
        .where(F.col("bad_at").isNull() | (F.col("element_number") <= F.col("bad_at")))
    )
    broken = items.where("element_number = bad_at").select(
        *ids,
        F.lit(-1).alias("error"),
        F.concat(F.lit("PV '"), F.col("uri"), F.lit("'name malformed")).alias("message"),
        F.col("element_number").cast("int").alias("element_number"),
    )
    wanted = items.where("bad_at IS NULL OR element_number < bad_at").select(
        pv_parts(F.col("uri")).getField("name").alias("pv_name"),
        F.col("request_us").alias("ts_us"),
        F.lit(0).alias("_side"),
        F.col("request_id").alias("seq"),
        F.col("element_number").cast("bigint").alias("_pos"),
        F.struct(*ids, "element_number", window_us().alias("w")).alias("_req"),
    )
    samples = events.select(
        "pv_name",
        "ts_us",
        F.lit(1).alias("_side"),
        "seq",
        F.lit(0).cast("bigint").alias("_pos"),
        F.struct("ts_us", "seq", "value").alias("_ev"),
    )
    if width is None:
        width = slice_width(samples, "ts_us")
    rows = samples.unionByName(wanted, allowMissingColumns=True)
    order = ["_side", "seq", "_pos"]
    rows = carry(rows, ["pv_name"], "ts_us", order, F.col("_ev"), "_after", width=width, backward=True)
    rows = carry(rows, ["pv_name"], "ts_us", order, F.col("_ev"), "_before", width=width)
    inside = F.col("_after.ts_us") <= F.col("ts_us") + F.col("_req.w")
    answers = (
        rows.where("_side = 0")
        .withColumn("_pick", F.when(inside, F.col("_after")).otherwise(F.col("_before")))
        .where("_pick IS NOT NULL")
        .select(
            *[f"_req.{c}" for c in ids],
            F.lit(0).alias("error"),
            F.col("_req.element_number").cast("int").alias("element_number"),
            "pv_name",
            F.col("_pick.ts_us").alias("ts_us"),
            F.col("_pick.seq").alias("seq"),
            F.col("_pick.value").alias("value"),
        )
    )
    done = requests.select(*ids, F.lit(1).alias("error"))
    return answers.unionByName(broken, allowMissingColumns=True).unionByName(done, allowMissingColumns=True)


def lifecycle(commands: DataFrame, *, width: int | None = None) -> DataFrame:
    """Reply of every start, stop and trigger command against the set of running snapshots.

    commands: queue_name, snapshot_name, ts_us, seq, kind ('start', 'stop',
    'trigger'), start_error (non-zero for starts that fail validation).
    """
    opens = (F.col("kind") == "start") & (F.col("start_error") == 0)
    closes = (F.col("kind") == "stop") & (F.col("snapshot_name") != "")
    state = F.when(opens, True).when(closes, False)
    if width is None:
        width = slice_width(commands, "ts_us")
    seen = carry(commands, ["queue_name"], "ts_us", ["seq"], state, "_state", width=width, strict=True)
    running = F.coalesce(F.col("_state"), F.lit(False))
    start, stop = F.col("kind") == "start", F.col("kind") == "stop"
    unknown_type = start & (F.col("start_error") == -1)
    unnamed = F.col("snapshot_name") == ""
    error = (
        F.when(unknown_type, -1)
        .when(start & running, 0)
        .when(start, F.col("start_error"))
        .when(unnamed, -1)
        .when(stop, 0)
        .when(running, 0)
        .otherwise(-2)
    )
    outcome = (
        F.when(unknown_type, "rejected")
        .when(start & running, "already running")
        .when(start & (F.col("start_error") != 0), "rejected")
        .when(start, "started")
        .when(unnamed, "rejected")
        .when(stop & running, "stopped")
        .when(stop, "already stopped")
        .when(running, "armed")
        .otherwise("not found")
    )
    return seen.withColumn("error", error.cast("int")).withColumn("outcome", outcome).drop("_state")


# The texts around the snapshot's name in the reply to each outcome.
OUTCOME_TEXTS = {
    "already running": ("Snapshot ", " is already running"),
    "stopped": ("Snapshot '", "' has been stopped"),
    "already stopped": ("Snapshot '", "' is already stopped"),
    "armed": ("Snapshot '", "' has been armed"),
    "not found": ("Snapshot '", "' has not been found"),
}
UNNAMED_TEXT = "The snapshot name is empty"


def lifecycle_replies(replies: DataFrame) -> DataFrame:
    """What each command is told: ``message``, and for a started snapshot the ``publishing_topic``.

    replies: out of ``lifecycle``, with ``start_message`` (what the checks of a start say).
    """
    name, outcome, start = F.col("snapshot_name"), F.col("outcome"), F.col("kind") == "start"
    message = F.when(start, F.col("start_message")).otherwise(UNNAMED_TEXT)
    for word, (head, tail) in OUTCOME_TEXTS.items():
        message = F.when(outcome == word, F.concat(F.lit(head), name, F.lit(tail))).otherwise(message)
    topic = F.when(outcome == "started", F.col("queue_name")).otherwise("")
    return replies.withColumn("message", message).withColumn("publishing_topic", topic)


def run_intervals(replies: DataFrame, *, width: int | None = None) -> DataFrame:
    """``[start_us, stop_us)`` of every run out of ``lifecycle``; a run still open has no stop."""
    edges = replies.where("outcome IN ('started', 'stopped')")
    stop_at = F.when(F.col("outcome") == "stopped", F.col("ts_us"))
    if width is None:
        width = slice_width(edges, "ts_us")
    paired = carry(edges, ["queue_name"], "ts_us", ["seq"], stop_at, "stop_us", width=width, strict=True, backward=True)
    return paired.where("outcome = 'started'").withColumnRenamed("ts_us", "start_us").drop("outcome", "error", "kind")


def members_of(runs_: DataFrame) -> DataFrame:
    """One row per (run, PV) of runs that carry ``pv_name_list``; a PV named twice counts once."""
    names = F.array_distinct(F.transform("pv_name_list", lambda u: pv_parts(u)["name"]))
    return runs_.withColumn("pv_name", F.explode(names)).drop("pv_name_list")


def command_frames(events: DataFrame, replies: DataFrame, *, save: Callable[[DataFrame, str], DataFrame], width: int | None = None) -> DataFrame:
    """Frames of all snapshots that a history of commands starts, stops and triggers.

    replies: out of ``lifecycle``, with the columns of the definitions (``pv_name_list``, ``time_window_msec``,
    ``sub_push_delay_msec``, ``triggered``, ``snapshot_type``, ``serialization``); a written table, as it is read several times. The
    frames of timed and triggered, last-value and buffered runs come as one table, with the run's ``serialization``.
    Events meet the runs of all kinds in one interval join; ``save`` writes a table and reads it back.
    """
    kept = ["snapshot_name", *RUN, "stop_us", "time_window_msec", "sub_push_delay_msec", "triggered", "snapshot_type", "serialization", "pv_name_list"]
    started = save(run_intervals(replies, width=width).select(*kept), "runs")
    slice_us = interval_width(started, "start_us", "stop_us")
    timed, _ = until_newest(events, started.where("NOT triggered"))
    members = save(members_of(timed.unionByName(started.where("triggered"))), "members")
    known = span(members, slice_us)
    routed = save(route(events, members, known), "routed")
    armed = replies.where("outcome = 'armed'").select("queue_name", F.col("ts_us").alias("trigger_us"), F.col("seq").alias("trigger_seq"))
    fired = members.where("triggered")
    plan = plan_triggers(events, fired, armed, known=known)
    numbered = save(number_triggers(armed, fired, plan, True), "triggers")
    parts = []
    for kind, make in (("Normal", normal_frames), ("TimedBuffered", buffered_frames)):
        of = F.col("snapshot_type") == kind
        own = members.where(of & ~F.col("triggered"))
        parts.append(make(events, own, known._replace(to_us=known.to_us or known.from_us), routed.where(of & ~F.col("triggered"))))
        own = fired.where(of)
        shots = numbered.join(runs(own).select(*RUN), RUN, "left_semi")
        parts.append(triggered_frames(events, own, shots, kind == "TimedBuffered", plan, routed.where(of & F.col("triggered"))))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return lookup_join(out, started.select(*RUN, "serialization"), RUN, rows=known.rows)
