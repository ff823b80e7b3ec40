"""Snapshot queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvflow.operators import snapshots as snap
from pvflow.plans import sql as S
from pvflow.plans.catalogue import query, with_ctes
from pvflow.sources import tables as T


def _dense(spark, sf):
    return T.dense_events(spark, sf), T.members(T.dense_definitions(spark, sf))


def _sparse(spark, sf):
    events = T.data_events(spark, sf).drop("event_type", "source")
    return events, T.sparse_members(spark, sf)


def _triggers(spark, sf):
    names = T.dense_definitions(spark, sf).select("def_id", "queue_name")
    return T.dense_triggers(spark, sf).join(names, "def_id").drop("def_id")


@query("snapshot_route", with_ctes(*S.DENSE_SNAP, body="""
SELECT queue_name, pv_name, ts_us, seq, value FROM routed"""))
def snapshot_route(spark, sf):
    return snap.route(*_dense(spark, sf)).select("queue_name", "pv_name", "ts_us", "seq", "value")


@query("snap_normal", with_ctes(*S.SPARSE_SNAP, S.ITERS, S.LAST, S.GRID, body="""
SELECT queue_name, iter_index, to_us, pv_name, ts_us, seq, value, own_seq IS NULL AS carried
FROM grid WHERE seq IS NOT NULL"""))
def snap_normal(spark, sf):
    rows = snap.normal(*_sparse(spark, sf)).withColumn("to_us", snap.window_end())
    return rows.select("queue_name", "iter_index", "to_us", "pv_name", "ts_us", "seq", "value", "carried")


_OPEN = S.definitions("Site").replace(
    f"{S.STOP_US} AS stop_us",
    f"""CASE WHEN r_regionkey % 2 = 0 THEN {S.START_US} + (r_regionkey + 1) * 86400000000 * (
    ((SELECT max(epoch_us(ts)) FROM events WHERE event_type NOT IN ('error', 'signup')) - {S.START_US}) // ((r_regionkey + 1) * 86400000000))
  ELSE {S.STOP_US} END AS stop_us""",
)


@query("snap_open_runs", with_ctes(S.SPARSE_DATA, _OPEN, *S.SPARSE_SNAP[2:], S.ITERS, S.LAST, S.GRID, body="""
SELECT queue_name, iter_index, to_us, pv_name, ts_us, seq, value FROM grid WHERE seq IS NOT NULL"""))
def snap_open_runs(spark, sf):
    """Half of the runs have no stop yet; their unfinished window is not published."""
    events, members = _sparse(spark, sf)
    still = F.when(F.col("def_id") % 2 != 0, F.col("stop_us"))
    rows = snap.normal(events, members.withColumn("stop_us", still)).withColumn("to_us", snap.window_end())
    return rows.select("queue_name", "iter_index", "to_us", "pv_name", "ts_us", "seq", "value")


@query("snap_buffered", with_ctes(*S.DENSE_SNAP, body="""
SELECT queue_name, iter_index, pv_name, ts_us, seq, value FROM routed"""))
def snap_buffered(spark, sf):
    return snap.buffered(*_dense(spark, sf)).select("queue_name", "iter_index", "pv_name", "ts_us", "seq", "value")


_SUBPUSH = """pushed AS (SELECT *, CASE WHEN push_ms > 0 AND push_ms < w_ms THEN push_ms
    WHEN push_ms > 0 THEN w_ms ELSE least(w_ms, 1000) END AS delay_ms,
  start_us + (iter_index - 1) * w_ms * 1000 AS from_us FROM routed),
sub AS (SELECT *, CAST((ts_us - from_us) // (delay_ms * 1000) AS BIGINT) AS sub_index FROM pushed)"""


@query("snap_subpush", with_ctes(*S.DENSE_SNAP, _SUBPUSH, body="""
SELECT queue_name, iter_index, sub_index, count(*) AS n_events, min(seq) AS first_seq, max(seq) AS last_seq
FROM sub GROUP BY ALL"""))
def snap_subpush(spark, sf):
    return snap.buffered(*_dense(spark, sf)).groupBy("queue_name", "iter_index", "sub_index").agg(
        F.count(F.lit(1)).alias("n_events"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")
    )


_FRAMES = """frame AS (
  SELECT queue_name, iter_index, to_us // 1000 AS timestamp, 0 AS message_type, snapshot_name, NULL AS error,
    NULL AS error_message, NULL AS sub_index, NULL AS pv_name, NULL AS ts_us, NULL AS seq, NULL AS value FROM iters
  UNION ALL SELECT queue_name, iter_index, to_us // 1000, 2, snapshot_name, 0, '', NULL, NULL, NULL, NULL, NULL FROM iters
  UNION ALL SELECT queue_name, iter_index, to_us // 1000, 1, NULL, NULL, NULL, 0, pv_name, ts_us, seq, value
    FROM grid WHERE seq IS NOT NULL)"""

FRAME_COLUMNS = [
    "queue_name", "iter_index", "timestamp", "message_type", "sub_index", "snapshot_name",
    "pv_name", "ts_us", "seq", "value", "error", "error_message",
]


@query("snap_frames", with_ctes(*S.DENSE_SNAP, S.ITERS, S.LAST, S.GRID, _FRAMES, body="""
SELECT queue_name, CAST(iter_index AS BIGINT) AS iter_index, CAST(timestamp AS BIGINT) AS timestamp,
  CAST(message_type AS INTEGER) AS message_type, CAST(coalesce(sub_index, -1) AS BIGINT) AS sub_index, snapshot_name,
  pv_name, CAST(coalesce(ts_us, -1) AS BIGINT) AS ts_us, CAST(coalesce(seq, -1) AS BIGINT) AS seq,
  CAST(value AS DOUBLE) AS value, CAST(coalesce(error, 0) AS INTEGER) AS error, error_message FROM frame"""))
def snap_frames(spark, sf):
    out = snap.normal_frames(*_dense(spark, sf))
    absent = {"sub_index": -1, "ts_us": -1, "seq": -1, "error": 0}  # no nulls in checked integer columns
    return out.withColumn("message_type", F.col("message_type").cast("int")).select(*FRAME_COLUMNS).fillna(absent)


@query("snap_stop_flush", with_ctes(*S.DENSE_SNAP, S.ITERS, body="""
SELECT iters.queue_name, iters.iter_index, start_us + (iters.iter_index - 1) * w_ms * 1000 AS from_us, to_us,
  to_us < start_us + iters.iter_index * w_ms * 1000 AS partial, coalesce(n, 0) AS n_events
FROM iters LEFT JOIN (SELECT queue_name, iter_index, count(*) AS n FROM routed GROUP BY ALL) c
  ON c.queue_name = iters.queue_name AND c.iter_index = iters.iter_index"""))
def snap_stop_flush(spark, sf):
    events, members = _dense(spark, sf)
    counts = snap.buffered(events, members).groupBy("queue_name", "iter_index").agg(F.count(F.lit(1)).alias("n"))
    return (
        snap.windows(members)
        .join(counts, ["queue_name", "iter_index"], "left")
        .select("queue_name", "iter_index", "from_us", "to_us", "partial", F.coalesce("n", F.lit(0)).alias("n_events"))
    )


@query("events_per_pv", with_ctes(*S.SPARSE_SNAP, body="""
SELECT queue_name, iter_index, pv_name, count(*) AS n_events FROM routed GROUP BY ALL"""))
def events_per_pv(spark, sf):
    return snap.buffered(*_sparse(spark, sf)).groupBy("queue_name", "iter_index", "pv_name").agg(
        F.count(F.lit(1)).alias("n_events")
    )


@query("events_per_iter", with_ctes(*S.DENSE_SNAP, body="""
SELECT snapshot_name, iter_index, count(*) AS n_events FROM routed GROUP BY ALL"""))
def events_per_iter(spark, sf):
    return snap.buffered(*_dense(spark, sf)).groupBy("snapshot_name", "iter_index").agg(
        F.count(F.lit(1)).alias("n_events")
    )


@query("silent_pvs", with_ctes(*S.SPARSE_SNAP, S.ITERS, body="""
SELECT i.queue_name, i.iter_index, mem.pv_name FROM iters i JOIN mem USING (queue_name)
WHERE NOT EXISTS (SELECT 1 FROM routed r WHERE r.queue_name = i.queue_name AND r.iter_index = i.iter_index
                  AND r.pv_name = mem.pv_name)"""))
def silent_pvs(spark, sf):
    return snap.silent(*_sparse(spark, sf)).select("queue_name", "iter_index", "pv_name")


@query("snap_forced", with_ctes(*S.SPARSE_SNAP, S.ITERS, S.LAST, S.GRID, """
gap AS (SELECT *, iter_index - max(CASE WHEN own_seq IS NOT NULL THEN iter_index END)
    OVER (PARTITION BY queue_name, pv_name ORDER BY iter_index ROWS UNBOUNDED PRECEDING) AS gap_index,
  max(iter_index) OVER (PARTITION BY queue_name) AS n_iter FROM grid)""", body="""
SELECT queue_name, iter_index + 1 AS iter_index, pv_name, ts_us, seq, value, true AS forced
FROM gap WHERE seq IS NOT NULL AND gap_index % 2 = 1 AND iter_index < n_iter"""))
def snap_forced(spark, sf):
    return snap.forced(*_sparse(spark, sf)).select(
        "queue_name", "iter_index", "pv_name", "ts_us", "seq", "value", "forced"
    )


@query("snap_trigger_buffered", with_ctes(*S.DENSE_SNAP, S.TRIGGERS, S.ASSIGNED, body="""
SELECT queue_name, iter_index, trigger_us, pv_name, ts_us, seq, value FROM assigned
QUALIFY ts_us >= max(ts_us) OVER (PARTITION BY queue_name, iter_index) - (w_ms // 72) * 1000"""))
def snap_trigger_buffered(spark, sf):
    events, members = _dense(spark, sf)
    # windows of 20 minutes and up, so that the trim has something to drop
    members = members.withColumn("time_window_msec", F.expr("time_window_msec div 72"))
    out = snap.triggered_buffered(events, members, _triggers(spark, sf))
    return out.select("queue_name", "iter_index", "trigger_us", "pv_name", "ts_us", "seq", "value")


@query("snap_trigger_normal", with_ctes(*S.DENSE_SNAP, S.TRIGGERS, """
probe AS (SELECT trg.queue_name, trg.iter_index, trg.trigger_us, mem.pv_name
  FROM trg JOIN mem USING (queue_name))""", body="""
SELECT p.queue_name, p.iter_index, p.trigger_us, p.pv_name, r.ts_us, r.seq, r.value FROM probe p ASOF JOIN routed r
  ON p.queue_name = r.queue_name AND p.pv_name = r.pv_name AND p.trigger_us >= r.ts_us"""))
def snap_trigger_normal(spark, sf):
    out = snap.triggered_normal(*_dense(spark, sf), _triggers(spark, sf))
    return out.select("queue_name", "iter_index", "trigger_us", "pv_name", "ts_us", "seq", "value")
