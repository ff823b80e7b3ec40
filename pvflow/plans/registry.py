"""Subscription and fan-out queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvflow.operators import fanout as O
from pvflow.operators import registry as R
from pvflow.plans import sql as S
from pvflow.plans.catalogue import query, with_ctes
from pvflow.sources import tables as T

_DISTINCT = "d AS (SELECT DISTINCT pv_name, channel_destination, event_serialization FROM sub)"


@query("monitor_fanout", with_ctes(S.SUBS, _DISTINCT, S.SPARSE, body="""
SELECT channel_destination, pv_name, event_serialization, ts_us, seq, value
FROM pv JOIN d USING (pv_name) WHERE event_type = 'Data'"""))
def monitor_fanout(spark, sf):
    out = O.monitor_fanout(T.data_events(spark, sf), T.subscriptions(spark, sf))
    return out.select("channel_destination", "pv_name", "event_serialization", "ts_us", "seq", "value")


@query("encode_once", with_ctes(S.SUBS, _DISTINCT, S.SPARSE, body="""
SELECT channel_destination AS topic, pv_name AS key, event_serialization, ts_us, seq,
  CASE event_serialization WHEN 1 THEN '{"' || pv_name || '":{"seq":' || seq || ',"ts_us":' || ts_us || '}}'
    ELSE pv_name || '|' || seq || '|' || ts_us END AS value
FROM pv JOIN d USING (pv_name) WHERE event_type = 'Data'"""))
def encode_once(spark, sf):
    as_json = F.to_json(F.create_map(F.col("pv_name"), F.struct("seq", "ts_us")))
    as_row = F.concat_ws("|", "pv_name", "seq", "ts_us")
    return O.encode_once(T.data_events(spark, sf), T.subscriptions(spark, sf), {1: as_json, 3: as_row})


_DOCS = """SELECT n_regionkey AS node, '{"pv_monitor_map":[{"key":"' || n_name || '","dest":"topic_' || n_nationkey
  || '","ser":' || (1 + n_nationkey % 3) || '},{"key":"' || n_name || ':2","dest":"all","ser":1}]}' AS document FROM nation"""


@query("registry_load", """SELECT node, k AS pv_name, d AS channel_destination, s AS event_serialization FROM (
  SELECT n_regionkey AS node, n_name AS k, 'topic_' || n_nationkey AS d, CAST(1 + n_nationkey % 3 AS INTEGER) AS s FROM nation
  UNION ALL SELECT n_regionkey, n_name || ':2', 'all', 1 FROM nation)""")
def registry_load(spark, sf):
    documents = T.select_from(_DOCS, "nation", T.table(spark, sf, "nation"))
    return R.load_documents(documents)


@query("registry_dump", with_ctes(S.SUBS, body="""
SELECT channel_destination AS node, '{"pv_monitor_map":[' || string_agg('{"key":"' || pv_name || '","dest":"' ||
  channel_destination || '","ser":' || event_serialization || '}', ',' ORDER BY pv_name, event_serialization) || ']}' AS document
FROM (SELECT DISTINCT pv_name, channel_destination, event_serialization FROM sub) GROUP BY channel_destination"""))
def registry_dump(spark, sf):
    rows = T.subscriptions(spark, sf).select(*R.ENTRY).distinct().withColumn("node", F.col("channel_destination"))
    return R.dump_documents(rows, ["node"])


@query("registry_add", with_ctes(S.SUBS, body="""
SELECT DISTINCT pv_name, channel_destination, event_serialization FROM sub s WHERE id % 3 <> 0 AND NOT EXISTS (
  SELECT 1 FROM sub r WHERE r.id % 3 = 0 AND r.pv_name = s.pv_name AND r.channel_destination = s.channel_destination
  AND r.event_serialization = s.event_serialization)"""))
def registry_add(spark, sf):
    subs = T.subscriptions(spark, sf)
    return R.add_entries(subs.where("id % 3 = 0"), subs.where("id % 3 <> 0"))


@query("registry_remove", with_ctes(S.SUBS, _DISTINCT, body="""
SELECT * FROM d WHERE (pv_name, channel_destination, event_serialization) NOT IN (
  SELECT (pv_name, channel_destination, event_serialization) FROM sub WHERE id % 4 = 0)"""))
def registry_remove(spark, sf):
    subs = T.subscriptions(spark, sf)
    return R.remove_entries(subs.select(*R.ENTRY).distinct(), subs.where("id % 4 = 0"))


@query("consumer_count", with_ctes(S.SUBS, S.CONSUMERS, body="""
SELECT id, pv_name, channel_destination, coalesce(n, 0) AS consumers FROM sub LEFT JOIN (
  SELECT topic, count(DISTINCT group_name) AS n FROM member WHERE member_id IS NOT NULL
    AND NOT regexp_full_match(group_name, 'group-1.*|group-.4') GROUP BY topic) g ON g.topic = channel_destination"""))
def consumer_count(spark, sf):
    counted = R.consumer_counts(T.subscriptions(spark, sf), T.consumer_members(spark, sf), ["group-1.*", "group-.4"])
    return counted.select("id", "pv_name", "channel_destination", "consumers")


@query("group_exclude", with_ctes(S.CONSUMERS, body="""
SELECT DISTINCT group_name, regexp_full_match(group_name, 'group-1.*|group-.4') AS excluded FROM member"""))
def group_exclude(spark, sf):
    groups = T.consumer_members(spark, sf).select("group_name").distinct()
    return groups.withColumn("excluded", R.group_excluded(F.col("group_name"), ["group-1.*", "group-.4"]))


@query("distinct_pv", with_ctes(S.SUBS, body="SELECT DISTINCT pv_name FROM sub"))
def distinct_pv(spark, sf):
    return R.distinct_pvs(T.subscriptions(spark, sf))


@query("sub_upsert", with_ctes(S.SUBS, body="""
SELECT pv_name, channel_destination, arg_min(event_serialization, id) AS event_serialization, count(*) AS counter,
  false AS processed, CAST(-1 AS BIGINT) AS start_purge_ts FROM sub GROUP BY pv_name, channel_destination"""))
def sub_upsert(spark, sf):
    return R.upsert(T.subscriptions(spark, sf))


@query("refcount", with_ctes(S.SPARSE, """
c AS (SELECT pv_name, ts_us, seq, CASE source WHEN 'click' THEN 1 ELSE -1 END AS delta FROM pv WHERE source IN ('click', 'view')),
s AS (SELECT *, sum(delta) OVER w AS t FROM c WINDOW w AS (PARTITION BY pv_name ORDER BY ts_us, seq)),
m AS (SELECT *, t - least(min(t) OVER (PARTITION BY pv_name ORDER BY ts_us, seq), 0) AS users FROM s)""", body="""
SELECT pv_name, ts_us, seq, CAST(users AS BIGINT) AS users, users > 0 AS monitored FROM m"""))
def refcount(spark, sf):
    changes = (
        T.sparse_events(spark, sf)
        .where("source IN ('click', 'view')")
        .withColumn("delta", F.when(F.col("source") == "click", 1).otherwise(-1).cast("bigint"))
    )
    return R.reference_counts(changes).select("pv_name", "ts_us", "seq", "users", "monitored")


@query("sub_actions", with_ctes(S.SUBS, body="""
SELECT id, pv_name, channel_destination, CASE row_number() OVER (PARTITION BY pv_name, channel_destination ORDER BY ts_us, id)
  WHEN 1 THEN 'start' ELSE 'force_update' END AS action FROM sub"""))
def sub_actions(spark, sf):
    requests = T.subscriptions(spark, sf).withColumn("seq", F.col("id"))
    return R.start_actions(requests).select("id", "pv_name", "channel_destination", "action")


_DAY = 86_400_000_000
_SCANS = f"""scan AS (SELECT u.pv_name, {S.START_US} + d * {_DAY} AS ts_us, d AS seq, coalesce(n, 0) AS consumers
  FROM (SELECT DISTINCT pv_name FROM pv) u CROSS JOIN (SELECT unnest(range(0, (SELECT max((ts_us - {S.START_US}) // {_DAY}) + 1 FROM pv))) AS d) g
  LEFT JOIN (SELECT pv_name, (ts_us - {S.START_US}) // {_DAY} AS day, count(*) AS n FROM pv WHERE source = 'view' GROUP BY ALL) c
    ON c.pv_name = u.pv_name AND c.day = g.d)"""


def scans(spark, sf):
    """Per PV and day the consumers: its 'view' events."""
    events = T.sparse_events(spark, sf)
    day = F.floor((F.col("ts_us") - T.START_US) / _DAY).cast("int")
    last = events.agg(F.max(day)).scalar()
    days = events.select("pv_name").distinct().withColumn("seq", F.explode(F.sequence(F.lit(0), last)))
    seen = (
        events.where("source = 'view'")
        .groupBy("pv_name", day.alias("seq"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return days.join(seen, ["pv_name", "seq"], "left").select(
        "pv_name",
        F.col("seq").cast("bigint").alias("seq"),
        (F.lit(T.START_US) + F.col("seq") * F.lit(_DAY)).alias("ts_us"),
        F.coalesce("n", F.lit(0)).alias("consumers"),
    )


@query("sub_purge", with_ctes(S.SPARSE, _SCANS, f"""
run AS (SELECT *, count(*) FILTER (WHERE consumers > 0) OVER (PARTITION BY pv_name ORDER BY seq) AS island FROM scan),
mk AS (SELECT *, min(CASE WHEN consumers = 0 THEN ts_us END) OVER (PARTITION BY pv_name, island) AS mark_us FROM run),
late AS (SELECT *, consumers = 0 AND ts_us - mark_us > 2 * {_DAY} AS is_late FROM mk),
st AS (SELECT *, min(CASE WHEN is_late THEN ts_us END) OVER (PARTITION BY pv_name, island) AS stop_us FROM late)""", body="""
SELECT pv_name, ts_us, consumers, CASE WHEN consumers > 0 THEN 'clear' WHEN ts_us = mark_us THEN 'mark' WHEN ts_us = stop_us THEN 'stop'
  WHEN ts_us > stop_us THEN 'gone' ELSE 'wait' END AS action FROM st"""))
def sub_purge(spark, sf):
    out = R.purge(scans(spark, sf), ["pv_name"], 2 * _DAY)
    return out.select("pv_name", "ts_us", "consumers", "action")


@query("process_n", with_ctes(S.SUBS, body="""
SELECT pv_name, id, CAST(idx AS BIGINT) AS idx FROM (
  SELECT *, row_number() OVER (PARTITION BY pv_name ORDER BY id) - 1 AS idx FROM sub WHERE NOT processed) WHERE idx < 3"""))
def process_n(spark, sf):
    batch = R.process_batch(T.subscriptions(spark, sf), 3)
    return batch.select("pv_name", "id", F.col("idx").cast("bigint").alias("idx"))


@query("process_all", with_ctes(S.SUBS, body="""
SELECT pv_name, id, row_number() OVER (PARTITION BY pv_name ORDER BY id) - 1 AS idx FROM sub WHERE NOT processed"""))
def process_all(spark, sf):
    return R.process_batch(T.subscriptions(spark, sf)).select("pv_name", "id", "idx")


@query("sub_merge", with_ctes(S.SUBS, """
base AS (SELECT pv_name, channel_destination, arg_min(event_serialization, id) AS event_serialization, count(*) AS counter
  FROM sub GROUP BY ALL),
ask AS (SELECT pv_name, channel_destination, id, id % 5 AS k, id % 35 = 0 AS gone FROM sub WHERE id % 2 = 0),
flag AS (SELECT pv_name, channel_destination, id % 3 = 0 AS processed FROM sub WHERE id % 2 = 0 AND id % 5 IN (1, 2)
  QUALIFY row_number() OVER (PARTITION BY pv_name, channel_destination ORDER BY id DESC) = 1),
mark AS (SELECT pv_name, channel_destination, max(id) AS ts FROM ask WHERE k IN (2, 3) GROUP BY ALL)""", body="""
SELECT pv_name, channel_destination, event_serialization, counter, coalesce(processed, false) AS processed,
  coalesce(ts, -1) AS start_purge_ts FROM base LEFT JOIN flag USING (pv_name, channel_destination)
  LEFT JOIN mark USING (pv_name, channel_destination) ANTI JOIN (SELECT * FROM ask WHERE gone) g USING (pv_name, channel_destination)"""))
def sub_merge(spark, sf):
    subs = T.subscriptions(spark, sf)
    kind = F.col("id") % 5
    changes = subs.where("id % 2 = 0").select(
        "pv_name",
        "channel_destination",
        F.col("id").alias("change_seq"),
        (F.col("id") % 35 == 0).alias("deleted"),
        F.when(kind.isin(1, 2), F.col("id") % 3 == 0).alias("processed"),
        F.when(kind.isin(2, 3), F.col("id")).alias("start_purge_ts"),
    )
    return R.merge_changes(R.upsert(subs), changes)
