"""State and as-of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvflow.operators import latest as L
from pvflow.plans import sql as S
from pvflow.plans.catalogue import query, with_ctes
from pvflow.sources import tables as T


@query("last_value", with_ctes(S.SPARSE, body="""
SELECT pv_name, ts_us, seq, value FROM pv WHERE event_type = 'Data'
QUALIFY row_number() OVER (PARTITION BY pv_name ORDER BY ts_us DESC, seq DESC) = 1"""))
def last_value(spark, sf):
    return L.last_value(T.data_events(spark, sf))


@query("pv_active", with_ctes(S.SPARSE, body="""
SELECT pv_name, event_type = 'Data' AS active, event_type, seq FROM pv
QUALIFY row_number() OVER (PARTITION BY pv_name ORDER BY ts_us DESC, seq DESC) = 1"""))
def pv_active(spark, sf):
    return L.liveness(T.sparse_events(spark, sf))


@query("active_total", with_ctes(S.SPARSE, body="""
SELECT count(*) FILTER (WHERE t = 'Data') AS active_pv, count(*) AS total_pv
FROM (SELECT pv_name, arg_max(event_type, (ts_us, seq)) AS t FROM pv GROUP BY pv_name)"""))
def active_total(spark, sf):
    return L.active_total(T.sparse_events(spark, sf))


_HALVES = """a AS (SELECT * FROM pv WHERE source = 'click'), b AS (SELECT * FROM pv WHERE source = 'view')"""


def _side(spark, sf, source):
    return T.sparse_events(spark, sf).where(F.col("source") == source).select("pv_name", "ts_us", "seq", "value")


@query("asof_merge", with_ctes(S.SPARSE, _HALVES, body="""
SELECT a.pv_name, a.ts_us, a.seq, a.value, b.ts_us AS additional_ts_us, b.seq AS additional_seq, b.value AS additional
FROM a ASOF JOIN b ON a.pv_name = b.pv_name AND a.ts_us >= b.ts_us"""))
def asof_merge(spark, sf):
    out = L.merge_additional(_side(spark, sf, "click"), _side(spark, sf, "view"))
    return out.select(
        "pv_name",
        "ts_us",
        "seq",
        "value",
        F.col("matched.ts_us").alias("additional_ts_us"),
        F.col("matched.seq").alias("additional_seq"),
        F.col("matched.value").alias("additional"),
    )


@query("subscribe_initial", with_ctes(S.SUBS, S.SPARSE, "d AS (SELECT * FROM pv WHERE event_type = 'Data')", body="""
SELECT sub.id, sub.pv_name, channel_destination, sub.ts_us AS asked_us, d.ts_us, d.seq, d.value
FROM sub ASOF JOIN d ON sub.pv_name = d.pv_name AND sub.ts_us >= d.ts_us"""))
def subscribe_initial(spark, sf):
    subs = T.subscriptions(spark, sf).withColumn("seq", F.col("id"))
    events = T.data_events(spark, sf)
    out = L.subscribe_initial(subs, events)
    return out.select(
        "id", "pv_name", "channel_destination", F.col("ts_us").alias("asked_us"), "matched.ts_us", "matched.seq",
        "matched.value",
    )


_GETS = """h AS (SELECT pv_name, source, arg_max(event_id % 7, (ts_us, seq)) AS m, arg_max(value, (ts_us, seq)) AS value
  FROM (SELECT *, seq AS event_id FROM pv WHERE source IN ('click', 'error')) GROUP BY ALL),
s AS (SELECT *, CASE m WHEN 0 THEN 'Fail' WHEN 1 THEN 'Cancel' ELSE 'Success' END AS state FROM h),
a AS (SELECT * FROM s WHERE source = 'click'), b AS (SELECT * FROM s WHERE source = 'error'),
j AS (SELECT coalesce(a.pv_name, b.pv_name) AS pv_name, a.value AS va, b.value AS vb,
  CASE WHEN a.state IS NULL OR b.state IS NULL THEN 'Pending'
    WHEN a.state = b.state OR a.state IN ('Fail', 'Cancel') THEN a.state ELSE b.state END AS state
  FROM a FULL JOIN b USING (pv_name))"""


@query("combined_get", with_ctes(S.SPARSE, _GETS, body="""
SELECT pv_name, state, CASE WHEN state = 'Success' THEN va END AS principal,
  CASE WHEN state = 'Success' THEN vb END AS additional FROM j"""))
def combined_get(spark, sf):
    def half(source):
        last = L.last_value(_side(spark, sf, source))
        state = F.when(F.col("seq") % 7 == 0, "Fail").when(F.col("seq") % 7 == 1, "Cancel").otherwise("Success")
        return last.withColumn("state", state)

    return L.combined_get(half("click"), half("error"))
