"""The sample tables, seen as PV events, snapshot definitions, commands and subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pvflow.functions.names import snapshot_topic
from pvflow.sources.readers import file_stream

DAY_US = 86_400_000_000
START_US = 1_704_067_200_000_000  # 2024-01-01
STOP_US = START_US + 30 * DAY_US


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The same table as a file stream, with ``ts`` as an instant."""
    schema = table(spark, sf_dir, name).schema
    return file_stream(spark, sf_dir, schema, f"{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(table(spark, sf_dir, "events"))


def timed(events: DataFrame) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return events.withColumn("ts", ts).withColumn("ts_us", F.unix_micros(ts))


def sparse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_sparse(_events(spark, sf_dir)).drop("ts")


def data_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data events of the sparse PVs; the filter reaches the scan."""
    raw = _events(spark, sf_dir).where(~F.col("event_type").isin("error", "signup"))
    return as_sparse(raw).drop("ts", "event_type").withColumn("event_type", F.lit("Data"))


def as_sparse(events: DataFrame) -> DataFrame:
    """Many PVs (one per user) with data, fail and disconnect events."""
    kind = (
        F.when(F.col("event_type") == "error", "Fail")
        .when(F.col("event_type") == "signup", "Disconnec")
        .otherwise("Data")
    )
    return events.select(
        F.concat(F.lit("user:"), F.col("user_id")).alias("pv_name"),
        kind.alias("event_type"),
        F.col("event_type").alias("source"),
        "ts",
        "ts_us",
        F.col("event_id").alias("seq"),
        "value",
    )


def dense_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_dense(_events(spark, sf_dir)).drop("ts")


def as_dense(events: DataFrame) -> DataFrame:
    """Five busy PVs, data only."""
    return events.select(
        F.concat(F.lit("ev:"), F.col("event_type")).alias("pv_name"),
        "ts",
        "ts_us",
        F.col("event_id").alias("seq"),
        "value",
    )


def _definitions(spark: SparkSession, sf_dir: str, prefix: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    name = F.concat(F.lit(f"{prefix} "), F.col("r_name"))
    return region.select(
        F.col("r_regionkey").cast("bigint").alias("def_id"),
        name.alias("snapshot_name"),
        snapshot_topic(name).alias("queue_name"),
        ((F.col("r_regionkey") + 1).cast("bigint") * (DAY_US // 1000)).alias("time_window_msec"),
        F.when(F.col("r_regionkey") == 0, 0)
        .when(F.col("r_regionkey") == 1, 3_600_000)
        .otherwise(86_400_000 * 3)
        .cast("bigint")
        .alias("sub_push_delay_msec"),
        F.lit(START_US).alias("start_us"),
        F.lit(STOP_US).alias("stop_us"),
    )


def dense_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five snapshots over the five busy PVs and one that never sends."""
    pvs = F.array(*[F.lit(f"ev:{t}") for t in ("click", "error", "none", "purchase", "signup", "view")])
    return _definitions(spark, sf_dir, "Snap").withColumn("pv_name_list", pvs)


def members(definitions: DataFrame) -> DataFrame:
    """One row per (snapshot, PV) of definitions that carry a PV list."""
    return definitions.withColumn("pv_name", F.explode(F.array_distinct("pv_name_list"))).drop("pv_name_list")


def sparse_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _definitions(spark, sf_dir, "Site")


def sparse_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per region holding the PVs of its customers."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("bigint").alias("def_id"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    return (
        customer.join(nation, "n_nationkey")
        .join(sparse_definitions(spark, sf_dir), "def_id")
        .withColumn("pv_name", F.concat(F.lit("user:"), F.col("c_custkey")))
        .drop("n_nationkey", "c_custkey")
    )


def dense_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error events fire the snapshots over the other PVs; every definition gets a fifth of them."""
    return (
        _events(spark, sf_dir)
        .where("event_type = 'error'")
        .select(
            (F.col("event_id") % 5).alias("def_id"),
            F.col("ts_us").alias("trigger_us"),
            F.col("event_id").alias("trigger_seq"),
        )
    )


# The commands of the sample: one JSON text per order. Plain SQL that Spark and the checks share;
# k picks the kind, m the defect.
COMMAND_SQL = """SELECT cmd_seq, ts_us, CASE WHEN k = 10 THEN
  CASE m % 3 WHEN 0 THEN 'plain text' WHEN 1 THEN '[1, 2]' ELSE '{"command":' END
ELSE '{"command":' || CASE WHEN m = 9 AND c % 5 = 0 THEN '12' ELSE '"' || CASE k
    WHEN 0 THEN 'monitor' WHEN 1 THEN 'multi-monitor' WHEN 2 THEN 'get' WHEN 3 THEN 'put' WHEN 4 THEN 'info'
    WHEN 5 THEN 'snapshot' WHEN 6 THEN 'repeating_snapshot' WHEN 7 THEN 'repeating_snapshot_stop'
    WHEN 8 THEN 'repeating_snapshot_trigger' ELSE 'strange' END || '"' END
  || CASE m % 4 WHEN 0 THEN ',"serialization":"JSON"' WHEN 1 THEN ',"serialization":"msgpack"'
       WHEN 2 THEN ',"serialization":7' ELSE '' END
  || CASE m WHEN 3 THEN '' ELSE ',"reply_topic":"topic_' || CAST(c % 7 AS STRING) || '"' END
  || CASE m WHEN 4 THEN '' WHEN 5 THEN ',"reply_id":12' ELSE ',"reply_id":"rep_' || CAST(cmd_seq AS STRING) || '"' END
  || CASE m WHEN 6 THEN ',"pv_name":["pva://user:1"]' WHEN 7 THEN ',"pv_name":"pva://channel::a"' WHEN 8 THEN ''
       ELSE ',"pv_name":"pva://user:' || CAST(c % 200 AS STRING) || '"' END
  || CASE m WHEN 6 THEN ',"pv_name_list":[]' WHEN 8 THEN ',"pv_name_list":"pva://user:1"'
       WHEN 7 THEN ',"pv_name_list":["pva://user:1",5,"pva://user:2","pva://user:1","bad uri"]'
       ELSE ',"pv_name_list":["pva://user:' || CAST(c % 150 AS STRING) || '","ca://user:' || CAST((c + 1) % 150 AS STRING) || '.HIHI"]' END
  || CASE m WHEN 0 THEN '' WHEN 1 THEN ',"time_window_msec":"500"' WHEN 2 THEN ',"time_window_msec":1500.5'
       WHEN 4 THEN ',"time_window_msec":-5' ELSE ',"time_window_msec":' || CAST(1000 * (c % 9) AS STRING) END
  || CASE WHEN c % 13 = 0 THEN ',"repeat_delay_msec":-1' ELSE ',"repeat_delay_msec":20' END
  || CASE WHEN c % 17 = 0 THEN '' WHEN c % 17 = 1 THEN ',"snapshot_name":""'
       ELSE ',"snapshot_name":"Snap ' || CAST(c % 23 AS STRING) || '"' END
  || CASE WHEN c % 3 = 0 THEN ',"triggered":true' WHEN c % 3 = 1 THEN ',"triggered":"yes"' ELSE '' END
  || CASE c % 5 WHEN 0 THEN ',"type":"TimedBuffered"' WHEN 1 THEN ',"type":"NORMAL"' WHEN 2 THEN ',"type":"odd"' ELSE '' END
  || CASE c % 4 WHEN 0 THEN ',"sub_push_delay_msec":250' ELSE '' END
  || CASE c % 6 WHEN 0 THEN ',"pv_field_filter_list":["value","alarm",3,"value"]' WHEN 1 THEN ',"pv_field_filter_list":"value"' ELSE '' END
  || CASE c % 7 WHEN 0 THEN ',"tags":{"shot":"' || CAST(c AS STRING) || '","n":4}' WHEN 1 THEN ',"tags":[1]' ELSE '' END
  || CASE c % 8 WHEN 0 THEN ',"monitor_dest_topic":"dest_' || CAST(c % 5 AS STRING) || '"' WHEN 1 THEN ',"monitor_dest_topic":""' ELSE '' END
  || CASE c % 9 WHEN 0 THEN ',"value":"not base64!"' WHEN 1 THEN ',"value":"gQ=="' WHEN 2 THEN ',"value":"aGVsbG8="'
       WHEN 3 THEN ',"value":5' WHEN 4 THEN ',"value":""' ELSE ',"value":"gaV2YWx1ZQw="' END
  || '}' END AS value
FROM (SELECT o_orderkey AS cmd_seq, o_custkey AS c, o_orderkey % 11 AS k,
  CAST(FLOOR(o_orderkey / 11) AS BIGINT) % 10 AS m,
  1704067200000000 + (o_orderkey * 7919 % 2592000) * 1000000 AS ts_us FROM orders)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control messages: cmd_seq, ts_us, value (JSON text)."""
    return as_commands(table(spark, sf_dir, "orders"))


def as_commands(orders: DataFrame) -> DataFrame:
    return select_from(COMMAND_SQL, "orders", orders)


def select_from(text: str, name: str, frame: DataFrame) -> DataFrame:
    """Run SQL over a frame that the text calls ``name``; braces stand for themselves."""
    text = text.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}")
    return frame.sparkSession.sql(text, **{name: frame})


def subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One subscription request per customer, in customer order."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("user:"), F.col("c_custkey") % 150).alias("pv_name"),
        F.col("c_mktsegment").alias("channel_destination"),
        (1 + 2 * (F.col("c_nationkey") % 2)).cast("int").alias("event_serialization"),
        (F.col("c_custkey") % 3 == 0).alias("processed"),
        F.lit(-1).cast("bigint").alias("start_purge_ts"),
        (START_US + (F.col("c_custkey") * 1009 % 2_592_000) * 1_000_000).alias("ts_us"),
    )


def consumer_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of consumer groups per topic out of the suppliers; some groups have none."""
    topics = F.array(*[F.lit(t) for t in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")])
    return table(spark, sf_dir, "supplier").select(
        F.get(topics, (F.col("s_suppkey") % 4).cast("int")).alias("topic"),
        F.concat(F.lit("group-"), F.col("s_nationkey")).alias("group_name"),
        F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).alias("member_id"),
    )


def nt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse data events with the full standard record as ``data``."""
    from pvflow.functions.nested import alarm_severity

    ev = data_events(spark, sf_dir)
    value, seq = F.col("value"), F.col("seq")
    limits = [F.lit(x) for x in (2.0, 10.0, 60.0, 90.0)]
    severity = alarm_severity(value, *limits)
    i = lambda c: c.cast("int")
    data = F.struct(
        value.alias("value"),
        F.struct(
            severity.alias("severity"),
            i(seq % 3).alias("status"),
            F.when(severity == 2, "MAJOR").when(severity == 1, "MINOR").otherwise("").alias("message"),
        ).alias("alarm"),
        F.struct(
            F.expr("ts_us div 1000000").alias("secondsPastEpoch"),
            i(F.col("ts_us") % 1_000_000 * 1000).alias("nanoseconds"),
            i(seq % 5).alias("userTag"),
        ).alias("timeStamp"),
        F.struct(
            F.lit(0.0).alias("limitLow"),
            F.lit(100.0).alias("limitHigh"),
            F.col("source").alias("description"),
            F.lit("mm").alias("units"),
            F.lit(2).alias("precision"),
            F.struct(i(seq % 4).alias("index")).alias("form"),
        ).alias("display"),
        F.struct(F.lit(0.0).alias("limitLow"), F.lit(100.0).alias("limitHigh"), F.lit(0.5).alias("minStep")).alias("control"),
        F.struct(
            F.lit(1).alias("active"),
            *[x.alias(n) for x, n in zip(limits, ("lowAlarmLimit", "lowWarningLimit", "highWarningLimit", "highAlarmLimit"))],
            *[
                F.lit(s).alias(n)
                for s, n in zip(
                    (2, 1, 1, 2),
                    ("lowAlarmSeverity", "lowWarningSeverity", "highWarningSeverity", "highAlarmSeverity"),
                )
            ],
            F.lit(0.0).alias("hysteresis"),
        ).alias("valueAlarm"),
    )
    return ev.select("pv_name", "ts_us", "seq", "source", data.alias("data"))
