"""Queries that run a user's code over windows and registry rows."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from pvflow.operators import handlers as H
from pvflow.plans import snapshots as PS
from pvflow.plans import sql as S
from pvflow.plans.catalogue import query, with_ctes
from pvflow.sources import tables as T


def _swings(key, batches):
    """How often the value of a window turns from falling to rising or back: a walk over its events in order."""
    turns, last, way, n = 0, None, 0, 0
    for batch in batches:
        for value in batch.column("value").to_pylist():
            n += 1
            now = 0 if last is None else (value > last) - (value < last)
            turns += bool(now and way and now != way)
            way, last = now or way, value
    yield pa.RecordBatch.from_pylist([{"queue_name": key[0], "iter_index": key[2], "n_events": n, "turns": turns}])


@query("window_code", with_ctes(*S.DENSE_SNAP, """
step AS (SELECT queue_name, iter_index, ts_us, seq, pv_name, sign(value - lag(value) OVER w) AS way FROM routed
  WINDOW w AS (PARTITION BY queue_name, iter_index ORDER BY ts_us, seq, pv_name)),
moved AS (SELECT *, lag(way) OVER (PARTITION BY queue_name, iter_index ORDER BY ts_us, seq, pv_name) AS before FROM step WHERE way <> 0)""", body="""
SELECT r.queue_name, r.iter_index, r.n_events, coalesce(m.turns, 0) AS turns
FROM (SELECT queue_name, iter_index, count(*) AS n_events FROM routed GROUP BY ALL) r
LEFT JOIN (SELECT queue_name, iter_index, count(*) FILTER (WHERE way <> before) AS turns FROM moved GROUP BY ALL) m
  ON m.queue_name = r.queue_name AND m.iter_index = r.iter_index"""))
def window_code(spark, sf):
    """A user's function over the events of each window, in order of time."""
    return H.over_windows(*PS._dense(spark, sf), _swings, "queue_name string, iter_index bigint, n_events bigint, turns bigint")


def _label(page: pa.RecordBatch) -> pa.RecordBatch:
    label = pc.binary_join_element_wise(pc.utf8_lower(page.column("channel_destination")), page.column("pv_name"), "/")
    return pa.RecordBatch.from_arrays([label, pc.greater(page.column("id"), 10)], names=["label", "ok"])


@query("process_code", with_ctes(S.SUBS, body="""
SELECT id, lower(channel_destination) || '/' || pv_name AS label, id > 10 AS ok, processed OR id > 10 AS processed FROM sub"""))
def process_code(spark, sf):
    """A user's function over all rows of the registry, page by page."""
    out = H.process_rows(T.subscriptions(spark, sf), _label, "label string, ok boolean")
    return out.select("id", "label", "ok", "processed")


@query("process_unprocessed_code", with_ctes(S.SUBS, body="""
SELECT id, lower(channel_destination) || '/' || pv_name AS label, id > 10 AS processed FROM sub WHERE NOT processed"""))
def process_unprocessed_code(spark, sf):
    """The same over the rows that are not marked; those it accepts are."""
    out = H.process_rows(T.subscriptions(spark, sf), _label, "label string, ok boolean", only_unprocessed=True)
    return out.select("id", "label", F.col("processed"))
