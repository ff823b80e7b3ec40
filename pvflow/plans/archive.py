"""Source, sink, archive and replay queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvflow.operators import fanout as O
from pvflow.operators import replay as A
from pvflow.operators import snapshots as snap
from pvflow.plans import sql as S
from pvflow.plans.catalogue import query, with_ctes
from pvflow.session import work_dir
from pvflow.sources import readers, sinks
from pvflow.sources import tables as T


def _messages(spark, sf):
    """Commands as Kafka-shaped rows: some without key, headers or payload."""
    seq = F.col("cmd_seq")
    header = F.struct(F.lit("ser-type").alias("key"), F.lit("json").cast("binary").alias("value"))
    return T.commands(spark, sf).select(
        F.lit("cmd-in").alias("topic"),
        "cmd_seq",
        F.when(seq % 4 != 0, F.concat(F.lit("key-"), seq % 10)).cast("binary").alias("key"),
        F.when(seq % 5 == 0, F.lit("")).otherwise(F.col("value")).cast("binary").alias("value"),
        F.when(seq % 3 == 0, F.array(header)).alias("headers"),
    )


@query("msg_normalize", with_ctes(f"cmd AS ({T.COMMAND_SQL})", body="""
SELECT cmd_seq, 'cmd-in' AS topic, CASE WHEN cmd_seq % 4 <> 0 THEN 'key-' || (cmd_seq % 10) ELSE 'default-key' END AS key, value,
  CASE WHEN cmd_seq % 3 = 0 THEN 'json' END AS ser_type FROM cmd WHERE cmd_seq % 5 <> 0 AND value <> ''"""))
def msg_normalize(spark, sf):
    out = readers.normalize(_messages(spark, sf))
    return out.select("cmd_seq", "topic", "key", "value", F.try_element_at("headers", F.lit("ser-type")).alias("ser_type"))


@query("topic_sink", with_ctes(S.SUBS, S.SPARSE, """
d AS (SELECT DISTINCT pv_name, channel_destination, event_serialization FROM sub)""", body="""
SELECT channel_destination AS topic, pv_name AS key, event_serialization AS ser, count(*) AS n_messages
FROM pv JOIN d USING (pv_name) WHERE event_type = 'Data' GROUP BY ALL"""))
def topic_sink(spark, sf):
    payload = {1: F.to_json(F.struct("seq", "value")), 3: F.to_json(F.struct("seq"))}
    sent = O.encode_once(T.data_events(spark, sf), T.subscriptions(spark, sf), payload)
    rows = sinks.out_messages(sent, F.col("topic"), F.col("key"), F.col("value"), F.col("event_serialization"))
    path = work_dir(spark, "topics")
    sinks.write_topics(rows, path)
    ser = F.col("headers")[0]["value"].cast("string").cast("int").alias("ser")
    stored = spark.read.schema("key string, value binary, headers array<struct<key:string,value:binary>>, topic string").parquet(path)
    return stored.groupBy("topic", "key", ser).agg(F.count(F.lit(1)).alias("n_messages"))


@query("archive_pv_values", with_ctes(S.SPARSE, body="""
SELECT pv_name AS pv, value, 'double' AS type, ts_us, seq, 'monitor' AS source, CAST(CAST(make_timestamp(ts_us) AS DATE) AS VARCHAR) AS date
FROM pv WHERE event_type = 'Data'"""))
def archive_pv_values(spark, sf):
    values = A.pv_values(T.data_events(spark, sf), "monitor")
    path = work_dir(spark, "pv_values")
    sinks.write_pv_values(values, path)
    stored = spark.read.schema(values.schema).parquet(path)
    return stored.select("pv", "value", "type", "ts_us", "seq", "source", F.col("date").cast("string").alias("date"))


def _blobs(spark, sf):
    events = T.data_events(spark, sf).drop("event_type", "source")
    rows = snap.normal(events, T.sparse_members(spark, sf)).withColumn("snapshot_us", snap.window_end())
    return rows.select(
        A.snapshot_id(F.col("queue_name"), F.col("start_us"), F.col("iter_index")).alias("snapshot_id"),
        "snapshot_us", "pv_name", "ts_us", "seq", "value",
    )


_BLOBS = (*S.SPARSE_SNAP, S.ITERS, S.LAST, S.GRID, """
blob AS (SELECT queue_name || '-' || start_us || '-' || iter_index AS snapshot_id, to_us AS snapshot_us, pv_name, ts_us, seq, value FROM grid WHERE seq IS NOT NULL)""")


@query("archive_blobs", with_ctes(*_BLOBS, body="""
SELECT CAST(year(make_timestamp(snapshot_us)) AS INTEGER) AS year, CAST(month(make_timestamp(snapshot_us)) AS INTEGER) AS month,
  CAST(day(make_timestamp(snapshot_us)) AS INTEGER) AS day, snapshot_id, count(*) AS n_rows FROM blob GROUP BY ALL"""))
def archive_blobs(spark, sf):
    path = work_dir(spark, "blobs")
    sinks.write_blobs(_blobs(spark, sf), path)
    stored = spark.read.parquet(path)
    return stored.groupBy("year", "month", "day", "snapshot_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query("snapshot_index", with_ctes(*_BLOBS, body="""
SELECT snapshot_id, snapshot_us, count(DISTINCT pv_name) AS pv_count,
  strftime(make_timestamp(snapshot_us), 'year=%Y/month=%-m/day=%-d') AS blob_key FROM blob GROUP BY ALL"""))
def snapshot_index(spark, sf):
    return A.snapshot_index(_blobs(spark, sf))


_FROM, _TO = T.START_US + 5 * T.DAY_US, T.START_US + 12 * T.DAY_US


@query("replay_range", with_ctes(*_BLOBS, body=f"""
SELECT snapshot_id, snapshot_us, pv_name, ts_us, seq, value FROM blob WHERE snapshot_us BETWEEN {_FROM} AND {_TO}"""))
def replay_range(spark, sf):
    path = work_dir(spark, "replay")
    rows = _blobs(spark, sf)
    sinks.write_blobs(rows, f"{path}/blobs")
    sinks.write_index(A.snapshot_index(rows), f"{path}/index")
    out = A.replay(spark.read.parquet(f"{path}/index"), spark.read.parquet(f"{path}/blobs"), _FROM, _TO)
    return out.select("snapshot_id", "snapshot_us", "pv_name", "ts_us", "seq", "value")


_CHOSEN = ["user:3", "user:17", "user:42", "user:17000000"]


@query("replay_pvs", with_ctes(S.SPARSE, body=f"""
SELECT pv_name AS pv, ts_us, seq, value FROM pv WHERE event_type = 'Data' AND pv_name IN ({", ".join(f"'{n}'" for n in _CHOSEN)}) AND ts_us BETWEEN {_FROM} AND {_TO}"""))
def replay_pvs(spark, sf):
    """A few PVs out of the value archive, by an index of its files."""
    path = work_dir(spark, "pv_replay")
    values = A.pv_values(T.data_events(spark, sf), "monitor")
    sinks.write_pv_values(values, f"{path}/values")
    schema = values.schema.toDDL()
    A.file_index(spark.read.schema(schema).parquet(f"{path}/values")).write.parquet(f"{path}/files")
    out = A.replay_pvs(spark, f"{path}/values", schema, spark.read.parquet(f"{path}/files"), _CHOSEN, _FROM, _TO)
    return out.select("pv", "ts_us", "seq", "value")
