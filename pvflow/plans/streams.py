"""Streaming queries: each runs its stream to the end and returns the table it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvflow.operators import commands as C
from pvflow.operators import fanout as O
from pvflow.operators import registry as R
from pvflow.operators import snapshots as snap
from pvflow.plans import sql as S
from pvflow.plans import commands as PC
from pvflow.plans.catalogue import ORACLE, query, with_ctes
from pvflow.plans.commands import DECODED
from pvflow.plans.registry import _DAY, scans
from pvflow.session import work_dir
from pvflow.sources import readers, topics
from pvflow.sources import tables as T
from pvflow.streaming import forced as XD
from pvflow.streaming import replies as XR
from pvflow.streaming import runs as X
from pvflow.streaming import snapshots as XS
from pvflow.streaming import stateful as XF
from pvflow.streaming import topics as XT


def _sparse_stream(spark, sf):
    return T.as_sparse(T.timed(T.table_stream(spark, sf, "events")))


def _dense_stream(spark, sf):
    return T.as_dense(T.timed(T.table_stream(spark, sf, "events")))


#: How far out of order the sample streams are, in how many parts they come, and the delay of their watermarks: a part
#: takes 62 hours and may itself be several files in any order.
JITTER_US = 12 * 3_600_000_000
PARTS = 12
DELAY = "75 hours"


#: Rows of a file of a part.
FILE_ROWS = 125_000


def _scattered(spark, rows, name, files=PARTS, delay=DELAY, beat=()):
    """The rows as a stream in a jittered order, a part a batch; a heartbeat past the last stop ends it.

    Watermarked on ts, but for a ``delay`` of None. ``beat`` are text columns of the heartbeat that let it through filters.
    A part takes more files where it has more rows, and a batch as many of them: batches grow with the rows, their number does not.

    rows: ts, ts_us, seq, pv_name and more. A row goes to the part of its time plus up to twelve hours.
    """
    path = work_dir(spark, name)
    late = F.col("ts_us") + F.pmod(F.xxhash64("pv_name", "seq"), F.lit(JITTER_US))
    span = 31 * T.DAY_US
    part = F.least(F.greatest(F.floor((late - T.START_US) * files / span), F.lit(0)), F.lit(files - 1))
    rows.withColumn("_part", part).write.partitionBy("_part").parquet(f"{path}-parts")  # the input is read once
    cut = rows.sparkSession.read.schema(f"{rows.schema.toDDL()}, _part INT").parquet(f"{path}-parts")
    most = cut.groupBy("_part").count().agg(F.max("count")).first()[0] or 1
    each = -(-most // FILE_ROWS)
    for i in range(files):
        cut.where(F.col("_part") == i).drop("_part").repartition(each).write.mode("append").parquet(f"{path}/{i}")
    # only ts is past the stop: filters on ts_us run before the watermark is taken
    end = F.timestamp_micros(F.lit(T.STOP_US + 6 * T.DAY_US))
    last = spark.range(1).select(end.alias("ts"), F.lit(T.START_US).alias("ts_us"), F.lit("").alias("pv_name"), *[F.lit("beat").alias(c) for c in beat])
    beat = rows.limit(0).unionByName(last, allowMissingColumns=True).coalesce(1)
    beat.write.mode("append").parquet(f"{path}/{files}")
    stream = readers.file_stream(spark, f"{path}/*", rows.schema, max_files=each)
    return X.watched(stream, delay) if delay else stream


@query("cmd_source", with_ctes(*DECODED, body="""
SELECT cmd_seq, kind, status, reply_topic FROM dec WHERE status <> 'corrupt'"""))
def cmd_source(spark, sf):
    orders = T.table_stream(spark, sf, "orders")

    def decode(batch):
        messages = T.as_commands(batch).where(F.length("value") > 0)
        return C.decode(messages).where("status != 'corrupt'").select("cmd_seq", "kind", "status", "reply_topic")

    return X.drain_batches(orders, work_dir(spark, "cmd_source"), decode)


@query("event_source", with_ctes(S.SPARSE, body="SELECT pv_name, event_type, ts_us, seq, value FROM pv"))
def event_source(spark, sf):
    events = X.watched(_sparse_stream(spark, sf), "1 hour", unique="seq")
    kept = events.select("pv_name", "event_type", "ts_us", "seq", "value")
    return X.drain(kept, work_dir(spark, "event_source"))


@query("stream_fanout", ORACLE["monitor_fanout"])
def stream_fanout(spark, sf):
    """Stream-static join; the subscriptions are read again for every batch."""
    plan = lambda batch: O.monitor_fanout(batch, T.subscriptions(spark, sf)).select(
        "channel_destination", "pv_name", "event_serialization", "ts_us", "seq", "value"
    )
    return X.drain_batches(_sparse_stream(spark, sf), work_dir(spark, "stream_fanout"), plan)


@query("stream_buffered", ORACLE["snap_buffered"])
def stream_buffered(spark, sf):
    members = T.members(T.dense_definitions(spark, sf))
    rows = snap.buffered(X.watched(_dense_stream(spark, sf), "1 hour"), members)
    rows = rows.select("queue_name", "iter_index", "pv_name", "ts_us", "seq", "value")
    return X.drain(rows, work_dir(spark, "stream_buffered"))


def _sparse_rows(spark, sf):
    return T.as_sparse(T.timed(T.table(spark, sf, "events")))


def _dense_rows(spark, sf):
    return T.as_dense(T.timed(T.table(spark, sf, "events")))


@query("stream_window_last", with_ctes(*S.DENSE_SNAP, body="""
SELECT queue_name, iter_index, pv_name, least(start_us + iter_index * w_ms * 1000, stop_us) AS to_us, ts_us, seq, value FROM routed
QUALIFY row_number() OVER (PARTITION BY queue_name, pv_name, iter_index ORDER BY ts_us DESC, seq DESC) = 1"""))
def stream_window_last(spark, sf):
    X.use_rocksdb(spark)
    members = T.members(T.dense_definitions(spark, sf))
    routed = snap.route(_scattered(spark, _dense_rows(spark, sf), "dense"), members)
    out = XS.window_last(routed).select("queue_name", "iter_index", "pv_name", "to_us", "ts_us", "seq", "value")
    return X.drain(out, work_dir(spark, "stream_window_last"))


@query("stream_normal", with_ctes(*S.SPARSE_SNAP, S.ITERS, S.LAST, S.GRID, body="""
SELECT queue_name, iter_index, to_us, pv_name, ts_us, seq, value FROM grid WHERE seq IS NOT NULL"""))
def stream_normal(spark, sf):
    X.use_rocksdb(spark)
    data = _sparse_rows(spark, sf).where("event_type = 'Data'")
    routed = snap.route(_scattered(spark, data, "sparse"), T.sparse_members(spark, sf))
    out = XS.normal_stream(routed).select("queue_name", "iter_index", "to_us", "pv_name", "ts_us", "seq", "value")
    return X.drain(out, work_dir(spark, "stream_normal"))


@query("stream_asof", ORACLE["asof_merge"])
def stream_asof(spark, sf):
    X.use_rocksdb(spark)
    side = F.when(F.col("source") == "click", 1).otherwise(0).alias("side")
    sides = _sparse_rows(spark, sf).where("source IN ('click', 'view')").select("pv_name", "ts", "ts_us", "seq", "value", side)
    return X.drain(XF.asof_stream(_scattered(spark, sides, "sides")), work_dir(spark, "stream_asof"))


@query("stream_refcount", ORACLE["refcount"])
def stream_refcount(spark, sf):
    X.use_rocksdb(spark)
    delta = F.when(F.col("source") == "click", 1).otherwise(-1).cast("bigint").alias("delta")
    changes = _sparse_rows(spark, sf).where("source IN ('click', 'view')").select("pv_name", "ts", "ts_us", "seq", delta)
    return X.drain(XF.refcount_stream(_scattered(spark, changes, "changes")), work_dir(spark, "stream_refcount"))


@query("stream_purge", ORACLE["sub_purge"])
def stream_purge(spark, sf):
    X.use_rocksdb(spark)
    table = scans(spark, sf).withColumn("ts", F.timestamp_micros("ts_us"))
    return X.drain(XF.purge_stream(_scattered(spark, table, "scans"), 2 * _DAY), work_dir(spark, "stream_purge"))


def _triggered(spark, sf, buffered):
    """The dense events and the triggers of the runs, each a stream out of order; the stop of a run fires a last time."""
    X.use_rocksdb(spark)
    definitions = T.dense_definitions(spark, sf)
    if buffered:  # the shorter windows of the batch query
        definitions = definitions.withColumn("time_window_msec", F.expr("time_window_msec div 72"))
    routed = snap.route(_scattered(spark, _dense_rows(spark, sf), "dense"), T.members(definitions))
    runs = definitions.select("def_id", "queue_name", "start_us", "stop_us", snap.window_us().alias("window_us"))
    stamp = lambda us: F.timestamp_micros(us).alias("ts")
    fired = T.dense_triggers(spark, sf).join(runs, "def_id").where("trigger_us >= start_us AND trigger_us < stop_us")
    fired = fired.select("queue_name", "start_us", stamp("trigger_us"), F.col("trigger_us").alias("ts_us"), F.col("trigger_seq").alias("seq"), "window_us")
    stops = runs.select("queue_name", "start_us", stamp("stop_us"), F.col("stop_us").alias("ts_us"), F.lit(2**62).alias("seq"), "window_us")
    marks = fired.unionByName(stops).withColumn("pv_name", F.col("queue_name"))
    triggers = _scattered(spark, marks, "triggers")
    return XS.triggered(routed, triggers, buffered)


@query("stream_trigger_buffered", ORACLE["snap_trigger_buffered"])
def stream_trigger_buffered(spark, sf):
    out = _triggered(spark, sf, True).select("queue_name", "iter_index", "trigger_us", "pv_name", "ts_us", "seq", "value")
    return X.drain(out, work_dir(spark, "stream_trigger_buffered"))


@query("stream_trigger_normal", ORACLE["snap_trigger_normal"])
def stream_trigger_normal(spark, sf):
    out = _triggered(spark, sf, False).select("queue_name", "iter_index", "trigger_us", "pv_name", "ts_us", "seq", "value")
    return X.drain(out, work_dir(spark, "stream_trigger_normal"))


@query("stream_forced", ORACLE["snap_forced"])
def stream_forced(spark, sf):
    """Silent windows feed the next one, out of keyed state."""
    X.use_rocksdb(spark)
    data = _sparse_rows(spark, sf).where("event_type = 'Data'")
    routed = snap.route(_scattered(spark, data, "silent"), T.sparse_members(spark, sf))
    out = XD.forced_stream(routed).select("queue_name", "iter_index", "pv_name", "ts_us", "seq", "value", "forced")
    return X.drain(out, work_dir(spark, "stream_forced"))


_PUSHES = """pushed AS (SELECT *, CASE WHEN push_ms > 0 AND push_ms < w_ms THEN push_ms WHEN push_ms > 0 THEN w_ms ELSE least(w_ms, 1000) END AS delay_ms,
  start_us + (iter_index - 1) * w_ms * 1000 AS from_us FROM routed)"""


@query("stream_push", with_ctes(*S.DENSE_SNAP, _PUSHES, body="""
SELECT queue_name, pv_name, iter_index, CAST((ts_us - from_us) // (delay_ms * 1000) AS BIGINT) AS sub_index, count(*) AS n_events,
  min(seq) AS first_seq, max(seq) AS last_seq FROM pushed GROUP BY ALL"""))
def stream_push(spark, sf):
    """Pushes within windows, each as soon as it has ended."""
    X.use_rocksdb(spark)
    routed = snap.route(_scattered(spark, _dense_rows(spark, sf), "pushes"), T.members(T.dense_definitions(spark, sf)))
    out = XD.push_stream(routed).drop("start_us")
    return X.drain(out, work_dir(spark, "stream_push"))


#: The sample's PVs say something every few hours, so commands wait that long.
_WAIT, _WAIT_US = "6 hours", 6 * 3_600_000_000
_FIRST = f"""ASOF LEFT JOIN pv ON c.name = pv.pv_name AND c.ts_us <= pv.ts_us"""
_IN_TIME = f"coalesce(pv.ts_us <= c.ts_us + {_WAIT_US}, false)"


def _command_stream(spark, sf, kind, *columns):
    rows = PC._valid(spark, sf, kind).select("cmd_seq", "ts_us", "pv_name", "reply_topic", *columns)
    rows = rows.withColumns({"ts": F.timestamp_micros("ts_us"), "seq": F.col("cmd_seq")})
    return _scattered(spark, rows, kind, delay=None, beat=["reply_topic", *[c for c in columns if c == "reply_id"]])


def _state_stream(spark, sf):
    events = _sparse_rows(spark, sf).select("pv_name", "ts", "ts_us", "seq", "event_type", "value")
    return _scattered(spark, events, "states")


@query("stream_get", with_ctes(*DECODED, S.SPARSE, """
c AS (SELECT *, regexp_full_match(pv_name, '(pva?|ca)://[a-zA-Z0-9_-]+(:[a-zA-Z0-9_-]+)*([.][a-zA-Z0-9_-]+([.][a-zA-Z0-9_]+)*)?') AS good,
  regexp_extract(pv_name, '://([a-zA-Z0-9_:-]+)', 1) AS name FROM dec WHERE status = 'valid' AND kind = 'get' AND reply_topic <> '')""", f"""
got AS (SELECT cmd_seq, CASE WHEN NOT good THEN -1 WHEN NOT {_IN_TIME} THEN -3 WHEN pv.event_type = 'Fail' THEN -2 ELSE 0 END AS error, pv.value, pv.seq
  FROM c {_FIRST})""", body="""
SELECT cmd_seq, error, CASE error WHEN -1 THEN 'PV name malformed' WHEN -2 THEN 'Operation failed' WHEN -3 THEN 'Timeout operation' END AS message,
  CASE WHEN error = 0 THEN value END AS value, CASE WHEN error = 0 THEN seq ELSE -1 END AS seq FROM got"""))
def stream_get(spark, sf):
    """Commands and events as one keyed stream: the first event in time answers, else the time-out."""
    X.use_rocksdb(spark)
    out = XR.get_stream(_command_stream(spark, sf, "get"), _state_stream(spark, sf), _WAIT, DELAY)
    done = X.drain(out.drop("reply_topic"), work_dir(spark, "stream_get")).where("cmd_seq IS NOT NULL")  # but the heartbeat
    return done.select("cmd_seq", "error", "message", "value", F.coalesce("seq", F.lit(-1)).alias("seq"))


@query("stream_put", with_ctes(*DECODED, PC._PUT, S.SPARSE, """
c AS (SELECT * FROM put WHERE reply_topic <> '' AND reply_id <> '')""", body=f"""
SELECT cmd_seq, CASE WHEN error <> 0 THEN error WHEN NOT {_IN_TIME} THEN -3 WHEN pv.event_type = 'Fail' THEN -2 ELSE 0 END AS error FROM c {_FIRST}"""))
def stream_put(spark, sf):
    X.use_rocksdb(spark)
    out = XR.put_stream(_command_stream(spark, sf, "put", "put_value", "reply_id"), _state_stream(spark, sf), _WAIT, DELAY)
    return X.drain(out.select("cmd_seq", "error"), work_dir(spark, "stream_put")).where("cmd_seq IS NOT NULL")


@query("stream_topics", with_ctes(S.SUBS, S.SPARSE, """
d AS (SELECT DISTINCT pv_name, channel_destination, event_serialization FROM sub)""", body="""
SELECT channel_destination AS topic, count(*) AS n_messages, count(*) AS n_positions, count(*) - 1 AS last_position, sum(seq)::BIGINT AS seqs
FROM pv JOIN d USING (pv_name) WHERE event_type = 'Data' GROUP BY ALL"""))
def stream_topics(spark, sf):
    """The fan-out of a stream of several batches into ordered topics: every message once, positions without gaps."""
    path = work_dir(spark, "stream-topics")
    payload = F.to_json(F.struct("seq", "value")).cast("binary")
    plan = lambda batch: O.encode_once(batch, T.subscriptions(spark, sf), {1: payload, 3: payload})
    XT.publish(_scattered(spark, _sparse_rows(spark, sf), "fan-out", 4), path, plan, ["ts_us", "key", "seq", "event_serialization"], f"{path}-checkpoint").awaitTermination()
    rows = topics.read(spark, path, "key string, event_serialization int, ts_us bigint, seq bigint, value binary")
    return rows.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.countDistinct("ord").alias("n_positions"),
        F.max("ord").alias("last_position"),
        F.sum("seq").alias("seqs"),
    )
