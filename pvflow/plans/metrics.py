"""Metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvflow.operators import metrics as M
from pvflow.plans import sql as S
from pvflow.plans.catalogue import query, with_ctes
from pvflow.sources import tables as T


@query("events_by_type", with_ctes(S.SPARSE, body="SELECT event_type, count(*) AS n_events FROM pv GROUP BY ALL"))
def events_by_type(spark, sf):
    return M.events_by_type(T.sparse_events(spark, sf))


@query("event_rate", with_ctes(S.SPARSE, body="""
SELECT ts_us // 21600000000 * 21600000000 AS window_us, count(*) AS n_events, count(*) * 3600 // 21600 AS rate
FROM pv WHERE event_type = 'Data' GROUP BY ALL"""))
def event_rate(spark, sf):
    return M.event_rate(T.data_events(spark, sf), 21_600, 3600)


@query("pv_mean_duration", with_ctes(S.SPARSE, body="""
SELECT pv_name, CAST(sum(CAST(round(value * 100) AS BIGINT) * 1000) AS DOUBLE) / count(*) / 1000.0 AS mean_us, count(*) AS invocations
FROM pv GROUP BY pv_name"""))
def pv_mean_duration(spark, sf):
    calls = T.sparse_events(spark, sf).withColumn("duration_ns", F.round(F.col("value") * 100).cast("bigint") * 1000)
    return M.mean_duration(calls)


@query("backlog", with_ctes(S.SPARSE, body="""
SELECT pv_name, ts_us // 86400000000 * 86400000000 AS window_us, CAST(sum(seq % 4) AS BIGINT) AS drained FROM pv
GROUP BY ALL HAVING sum(seq % 4) > 0"""))
def backlog(spark, sf):
    return M.backlog(T.sparse_events(spark, sf).withColumn("drained", F.col("seq") % 4), 86_400)


_CENTS = "cent AS (SELECT *, CAST(round(value * 100) AS BIGINT) AS v FROM pv)"


def _cents(spark, sf):
    return T.sparse_events(spark, sf).withColumn("value", F.round(F.col("value") * 100).cast("bigint"))


@query("counter_delta", with_ctes(S.SPARSE, _CENTS, """
d AS (SELECT pv_name, source, CASE WHEN lag(v) OVER w IS NULL THEN v ELSE greatest(v - lag(v) OVER w, 0) END AS delta
  FROM cent WINDOW w AS (PARTITION BY pv_name, source ORDER BY ts_us, seq))""", body="""
SELECT pv_name, source, CAST(sum(delta) AS BIGINT) AS total FROM d GROUP BY ALL"""))
def counter_delta(spark, sf):
    return M.counter_totals(_cents(spark, sf), ["pv_name", "source"])


@query("metric_rollup", with_ctes(S.SPARSE, _CENTS, body="""
SELECT CASE WHEN source IN ('click', 'view') THEN 'ops_total' ELSE 'ops_gauge' END AS name,
  CASE WHEN source IN ('click', 'view') THEN 'counter' ELSE 'gauge' END AS kind, pv_name, source,
  CAST(CASE WHEN source IN ('click', 'view') THEN sum(v) ELSE arg_max(v, (ts_us, seq)) END AS BIGINT) AS value
FROM cent GROUP BY pv_name, source"""))
def metric_rollup(spark, sf):
    counts = F.col("source").isin("click", "view")
    samples = _cents(spark, sf).withColumns(
        {
            "name": F.when(counts, "ops_total").otherwise("ops_gauge"),
            "kind": F.when(counts, "counter").otherwise("gauge"),
        }
    )
    return M.rollup(samples, ["pv_name", "source"])


_LINES = """CASE event_id % 8 WHEN 0 THEN '# HELP ops_total operations' WHEN 1 THEN '' WHEN 2 THEN 'up ' || CAST(event_id AS STRING) || 'e3'
  WHEN 3 THEN 'ops_total{} 5' WHEN 4 THEN 'broken line' ELSE 'ops_total{pv="user:' || CAST(user_id AS STRING) || '", op="' || event_type
  || '",raw=x} ' || CAST(event_id AS STRING) END"""
_PARSED = """line AS (SELECT event_id, user_id, event_type, event_id % 8 AS k FROM events),
m AS (SELECT event_id, CASE k WHEN 2 THEN 'up' ELSE 'ops_total' END AS name,
  CASE WHEN k >= 5 THEN 'user:' || user_id END AS pv, CASE WHEN k >= 5 THEN event_type END AS op,
  CASE WHEN k >= 5 THEN 'x' END AS raw, CASE k WHEN 2 THEN event_id || 'e3' WHEN 3 THEN '5' ELSE CAST(event_id AS VARCHAR) END AS value
  FROM line WHERE k NOT IN (0, 1, 4))"""


def _samples(spark, sf):
    lines = T.table(spark, sf, "events").select("event_id", F.expr(_LINES).alias("line"))
    return M.parse_text(lines)


@query("metrics_text", with_ctes(_PARSED, body="SELECT * FROM m"))
def metrics_text(spark, sf):
    label = lambda k: F.try_element_at("labels", F.lit(k)).alias(k)
    return _samples(spark, sf).select("event_id", "name", label("pv"), label("op"), label("raw"), "value")


@query("metrics_filter", with_ctes(_PARSED, body="""
SELECT event_id, pv, value FROM m WHERE name = 'ops_total' AND op = 'click' AND raw = 'x'"""))
def metrics_filter(spark, sf):
    kept = M.with_labels(_samples(spark, sf), "ops_total", {"op": "click", "raw": "x"})
    return kept.select("event_id", F.try_element_at("labels", F.lit("pv")).alias("pv"), "value")


@query("retention_prune", """WITH m AS (SELECT event_type AS topic, epoch_us(ts) AS ts_us, event_id AS seq, 500 + length(props) * (1 + event_id % 3) AS size FROM events),
y AS (SELECT *, sum(size) OVER (PARTITION BY topic ORDER BY ts_us DESC, seq DESC) AS kept FROM m
  QUALIFY ts_us >= max(ts_us) OVER (PARTITION BY topic) - 864000000000)
SELECT topic, ts_us, seq, CAST(size AS BIGINT) AS size, CAST(kept AS BIGINT) AS kept_bytes FROM y WHERE kept <= 262144""")
def retention_prune(spark, sf):
    size = (500 + F.length("props") * (1 + F.col("event_id") % 3)).cast("bigint")
    messages = T.table(spark, sf, "events").select(
        F.col("event_type").alias("topic"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("event_id").alias("seq"),
        size.alias("size"),
    )
    return M.retain(messages, 10 * T.DAY_US, 262_144)
