"""Whole pipelines: command text to replies, frames and subscriber messages, and the ordered topics they end in."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvflow.operators import commands as C
from pvflow.operators import encode as E
from pvflow.operators import fanout as O
from pvflow.operators import snapshots as snap
from pvflow.operators.ordered import slice_width
from pvflow.plans import commands as PC
from pvflow.plans import nested as PN
from pvflow.plans import snapshots as PS
from pvflow.plans import sql as S
from pvflow.plans.catalogue import query, with_ctes
from pvflow.session import work_dir
from pvflow.sources import sinks, topics
from pvflow.sources import tables as T

_DEFINITION = ["pv_name_list", "time_window_msec", "sub_push_delay_msec", "triggered", "snapshot_type", "serialization"]
_OF_COMMAND = ["cmd_seq", "reply_topic", "reply_id"]


def _replies(spark, sf):
    """The life cycle of all commanded snapshots, written once; windows are taken as hours, as the sample runs for a month."""
    width = slice_width(T.commands(spark, sf), "ts_us")
    commands = C.snapshot_commands(PC.decoded(spark, sf), *_OF_COMMAND, *_DEFINITION)
    hours = F.greatest(F.col("time_window_msec"), F.lit(1000)).cast("bigint") * 3600
    return sinks.saved(snap.lifecycle(commands, width=width).withColumn("time_window_msec", hours), "life-cycle"), width


_TOLD = """told AS (SELECT val.cmd_seq, reply_topic, reply_id, serialization, life.error, outcome, CASE
    WHEN outcome = 'already running' THEN 'Snapshot ' || life.snapshot_name || ' is already running'
    WHEN outcome = 'started' THEN 'The snapshot ''' || life.snapshot_name || ''' has been started'
    WHEN outcome = 'stopped' THEN 'Snapshot ''' || life.snapshot_name || ''' has been stopped'
    WHEN outcome = 'already stopped' THEN 'Snapshot ''' || life.snapshot_name || ''' is already stopped'
    WHEN outcome = 'armed' THEN 'Snapshot ''' || life.snapshot_name || ''' has been armed'
    WHEN outcome = 'not found' THEN 'Snapshot ''' || life.snapshot_name || ''' has not been found'
    WHEN op <> 'start' THEN 'The snapshot name is empty' WHEN life.error = -1 THEN 'The snapshot type Unknown is not supported'
    WHEN life.error = -3 THEN 'The repeat delay is not valid ' || life.snapshot_name
    WHEN life.error = -4 THEN 'The time window is not valid ' || life.snapshot_name
    WHEN life.error = -5 THEN 'The snapshot name is not valid ' || life.snapshot_name
    ELSE 'The pv uri ' || bad[1] || ' is not parsable' END AS msg, CASE WHEN outcome = 'started' THEN life.queue_name ELSE '' END AS topic
  FROM (SELECT life.*, st.snapshot_name FROM life JOIN st USING (queue_name, ts_us, seq)) life JOIN val ON val.cmd_seq = life.seq)"""
_TOLD_JSON = """'{"error":' || error || ',"reply_id":"' || reply_id || '","message":"' || msg || '"' || CASE WHEN topic <> '' THEN ',"publishing_topic":"' || topic || '"' ELSE '' END || '}'"""
_TOLD_PACK = S.mp_map(error=S.mp_int("error"), reply_id=S.mp_text("reply_id"), message=S.mp_text("msg"))
_TOLD_MORE = S.mp_map(error=S.mp_int("error"), reply_id=S.mp_text("reply_id"), message=S.mp_text("msg"), publishing_topic=S.mp_text("topic"))


@query("pipeline_replies", with_ctes(*PC.DECODED, PC._VALIDATED, PC._LIFE, _TOLD, body=f"""
SELECT cmd_seq, reply_topic, outcome, CASE WHEN serialization = 'json' THEN {_TOLD_JSON}
  ELSE {(f"CASE WHEN topic <> '' THEN {_TOLD_MORE} ELSE {_TOLD_PACK} END")} END AS reply FROM told"""))
def pipeline_replies(spark, sf):
    """What every start, stop and trigger command is told, in the serialization it asked for."""
    told = snap.lifecycle_replies(_replies(spark, sf)[0])
    extra = ("message", "publishing_topic")
    reply = F.when(F.col("serialization") == "json", E.reply_json(*extra)).otherwise(F.hex(E.reply_msgpack(*extra)))
    return told.select("cmd_seq", "reply_topic", "outcome", reply.alias("reply"))


_RUNS = """edge AS (SELECT *, lead(ts_us) OVER (PARTITION BY queue_name ORDER BY ts_us, seq) AS next_us FROM life
  WHERE outcome IN ('started', 'stopped')),
begun AS (SELECT edge.queue_name, edge.ts_us AS start_us, edge.next_us, val.snapshot_name, serialization, triggered, snapshot_type, pvs,
  greatest(CAST(time_window_msec AS BIGINT), 1000) * 3600 AS w_ms, CAST(sub_push_delay_msec AS BIGINT) AS push_ms
  FROM edge JOIN val ON val.cmd_seq = edge.seq WHERE outcome = 'started'),
def AS (SELECT *, coalesce(next_us, CASE WHEN NOT triggered THEN
    start_us + greatest((SELECT max(ts_us) FROM pv) - start_us, 0) // (w_ms * 1000) * w_ms * 1000 END) AS stop_us FROM begun),
mem AS (SELECT * EXCLUDE (pvs), unnest(list_distinct(list_transform(pvs, lambda u: regexp_extract(u, '://([a-zA-Z0-9_:-]+)', 1)))) AS pv_name FROM def),
routed AS (SELECT mem.*, pv.ts_us, pv.seq, pv.value, CAST((pv.ts_us - start_us) // (w_ms * 1000) + 1 AS BIGINT) AS iter_index
  FROM pv JOIN mem USING (pv_name) WHERE pv.ts_us >= start_us AND (stop_us IS NULL OR pv.ts_us < stop_us)),
timed AS (SELECT queue_name, snapshot_name, serialization, snapshot_type, start_us, stop_us, w_ms, i AS iter_index, least(start_us + i * w_ms * 1000, stop_us) AS to_us
  FROM def, LATERAL (SELECT unnest(range(1, CAST(ceil((stop_us - start_us) / (w_ms * 1000)) AS BIGINT) + 1)) AS i) WHERE NOT triggered),
iters AS (SELECT * FROM timed WHERE snapshot_type = 'Normal')"""
_LAST = S.LAST.replace("queue_name, pv_name", "queue_name, start_us, pv_name")
_GRID = (
    S.GRID.replace("USING (queue_name)", "USING (queue_name, start_us)")
    .replace("last.queue_name = iters.queue_name AND", "last.queue_name = iters.queue_name AND last.start_us = iters.start_us AND")
    .replace("PARTITION BY iters.queue_name,", "PARTITION BY iters.queue_name, iters.start_us,")
)
_FIRED = """shot AS (SELECT def.queue_name, start_us, stop_us, snapshot_name, serialization, snapshot_type, life.ts_us AS to_us, life.seq AS t_seq
  FROM def JOIN life ON life.queue_name = def.queue_name AND outcome = 'armed' AND life.ts_us >= start_us AND (stop_us IS NULL OR life.ts_us < stop_us)
  WHERE triggered UNION ALL
  SELECT queue_name, start_us, stop_us, snapshot_name, serialization, snapshot_type, stop_us, 9223372036854775807 FROM def WHERE triggered AND stop_us IS NOT NULL),
trg AS (SELECT *, row_number() OVER (PARTITION BY queue_name, start_us ORDER BY to_us, t_seq) AS iter_index FROM shot),
held AS (SELECT r.* EXCLUDE (iter_index), trg.iter_index, trg.to_us FROM routed r ASOF JOIN trg
  ON r.queue_name = trg.queue_name AND r.start_us = trg.start_us AND r.ts_us <= trg.to_us WHERE r.triggered),
probe AS (SELECT trg.*, mem.pv_name FROM trg JOIN mem USING (queue_name, start_us) WHERE trg.snapshot_type = 'Normal'),
seen AS (SELECT probe.queue_name, probe.start_us, probe.iter_index, probe.to_us, probe.pv_name, r.ts_us, r.seq, r.value, probe.serialization FROM probe
  ASOF JOIN (SELECT * FROM routed WHERE triggered) r ON probe.queue_name = r.queue_name AND probe.start_us = r.start_us AND probe.pv_name = r.pv_name AND probe.to_us >= r.ts_us),
frame AS (
  SELECT queue_name, start_us, iter_index, to_us, 1 AS message_type, 0 AS sub_index, pv_name, ts_us, seq, value, '' AS snapshot_name, serialization FROM grid WHERE seq IS NOT NULL
  UNION ALL SELECT queue_name, start_us, iter_index, least(start_us + iter_index * w_ms * 1000, stop_us), 1,
    (ts_us - start_us - (iter_index - 1) * w_ms * 1000) // ((CASE WHEN push_ms > 0 AND push_ms < w_ms THEN push_ms WHEN push_ms > 0 THEN w_ms
      ELSE least(w_ms, 1000) END) * 1000), pv_name, ts_us, seq, value, '', serialization FROM routed WHERE NOT triggered AND snapshot_type = 'TimedBuffered'
  UNION ALL SELECT queue_name, start_us, iter_index, to_us, 1, 0, pv_name, ts_us, seq, value, '', serialization FROM seen
  UNION ALL SELECT queue_name, start_us, iter_index, to_us, 1, 0, pv_name, ts_us, seq, value, '', serialization FROM held WHERE snapshot_type = 'TimedBuffered'
    QUALIFY ts_us >= max(ts_us) OVER (PARTITION BY queue_name, start_us, iter_index) - w_ms * 1000
  UNION ALL SELECT queue_name, start_us, iter_index, to_us, m, NULL, NULL, NULL, NULL, NULL, snapshot_name, serialization
    FROM (SELECT queue_name, start_us, iter_index, to_us, snapshot_name, serialization FROM timed
      UNION ALL SELECT queue_name, start_us, iter_index, to_us, snapshot_name, serialization FROM trg), (SELECT unnest([0, 2]) AS m)),
told AS (SELECT *, row_number() OVER (PARTITION BY queue_name ORDER BY start_us, iter_index, message_type, sub_index NULLS FIRST, ts_us NULLS FIRST,
  pv_name NULLS FIRST, seq NULLS FIRST) - 1 AS ord FROM frame)"""
_JSON = """CASE message_type WHEN 0 THEN '{"message_type":0,"iter_index":' || iter_index || ',"snapshot_name":"' || snapshot_name || '","timestamp":' || to_us // 1000 || '}'
  WHEN 2 THEN '{"message_type":2,"error":0,"error_message":"","iter_index":' || iter_index || ',"timestamp":' || to_us // 1000 || ',"snapshot_name":"' || snapshot_name || '"}'
  ELSE '{"message_type":1,"iter_index":' || iter_index || ',"timestamp":' || to_us // 1000 || ',"' || pv_name || '":' || value || '}' END"""
_MAPS = PN.frame_maps()
_PACK = (f"CASE message_type WHEN 0 THEN {_MAPS['header']} WHEN 2 THEN {_MAPS['tail']} ELSE {_MAPS['data']} END")
_ORDER = ["start_us", "iter_index", "message_type", "sub_index", "ts_us", "pv_name", "seq"]


def _published(frames, spark, name, payload):
    """Frames through the ordered topics and back, with their positions."""
    path = work_dir(spark, name)
    narrow = frames.select(F.col("queue_name").alias("topic"), F.col("message_type").cast("int").alias("message_type"), *[c for c in _ORDER if c != "message_type"], *payload)
    topics.append(narrow, path, _ORDER)
    return topics.read(spark, path, narrow.drop("topic").schema.toDDL())


@query("pipeline_snapshot", with_ctes(S.SPARSE_DATA, *PC.DECODED, PC._VALIDATED, PC._LIFE, _RUNS, _LAST, _GRID, _FIRED, body=f"""
SELECT queue_name AS topic, CAST(ord AS BIGINT) AS ord, start_us, CAST(iter_index AS BIGINT) AS iter_index, CAST(message_type AS INTEGER) AS message_type,
  CASE WHEN serialization = 'json' THEN {_JSON} ELSE {_PACK} END AS payload FROM told"""))
def pipeline_snapshot(spark, sf):
    """Command text -> runs -> windows and triggers -> frames in the runs' serialization -> ordered topics."""
    replies, width = _replies(spark, sf)
    events = T.data_events(spark, sf).drop("event_type", "source")
    frames = snap.command_frames(events, replies, save=sinks.saved, width=width)
    payload = E.frame_payload(F.col("value"), frames.schema["value"].dataType)
    rows = _published(frames, spark, "frames", [payload.alias("payload"), "serialization"])
    text = F.when(F.col("serialization") == "json", F.col("payload").cast("string")).otherwise(F.hex("payload"))
    return rows.select("topic", "ord", "start_us", "iter_index", "message_type", text.alias("payload"))


@query("frame_sink", with_ctes(*S.DENSE_SNAP, S.ITERS, S.LAST, S.GRID, PS._FRAMES, body="""
SELECT queue_name AS topic, CAST(iter_index AS BIGINT) AS iter_index, CAST(message_type AS INTEGER) AS message_type, pv_name,
  CAST(coalesce(seq, -1) AS BIGINT) AS seq, CAST(row_number() OVER (PARTITION BY queue_name ORDER BY iter_index, message_type,
    ts_us NULLS FIRST, pv_name NULLS FIRST, seq NULLS FIRST) - 1 AS BIGINT) AS ord FROM frame"""))
def frame_sink(spark, sf):
    """The frames of five snapshots, read back with their positions: gapless, header before data before tail."""
    rows = _published(snap.normal_frames(*PS._dense(spark, sf)), spark, "frame-sink", [])
    return rows.select("topic", "iter_index", "message_type", "pv_name", F.coalesce("seq", F.lit(-1)).alias("seq"), "ord")


_PAYLOAD = f"CASE {{ser}} WHEN 1 THEN {PN.NT_JSON} WHEN 2 THEN {(PN.NT_FULL)} ELSE {(PN.NT_COMPACT)} END"


def _payload(ser: str) -> str:
    return _PAYLOAD.replace("{ser}", ser)


def _sent(messages):
    text = F.when(F.col("event_serialization") == E.SER_JSON, F.col("value").cast("string")).otherwise(F.hex("value"))
    return messages.select("topic", "key", "event_serialization", "seq", text.alias("value"))


def _nt_events(spark, sf):
    return PN.principal(spark, sf).withColumn("event_type", F.lit("Data"))


@query("fanout_msgpack", with_ctes(S.SUBS, S.SPARSE, PN.NT, """
d AS (SELECT DISTINCT pv_name, channel_destination, CAST(1 + id % 3 AS INTEGER) AS event_serialization FROM sub)""", body=f"""
SELECT channel_destination AS topic, pv_name AS key, event_serialization, seq, {_payload('event_serialization')} AS value FROM nt JOIN d USING (pv_name)"""))
def fanout_msgpack(spark, sf):
    """The real encodings in the fan-out: JSON, MsgPack and compact MsgPack, each built once per event."""
    subs = T.subscriptions(spark, sf).withColumn("event_serialization", (1 + F.col("id") % 3).cast("int"))
    events = _nt_events(spark, sf)
    return _sent(O.encode_once(events, subs, E.encoders(events.schema["data"].dataType)))


@query("pipeline_monitor", with_ctes(*PC.DECODED, S.SPARSE, PN.NT, """
ask AS (SELECT ts_us, pv_name AS uri, monitor_dest_topic AS dest, serialization FROM dec WHERE status = 'valid' AND kind = 'monitor'
  UNION ALL SELECT ts_us, unnest(pvs), NULL, serialization FROM dec WHERE status = 'valid' AND kind = 'multi-monitor'),
good AS (SELECT ts_us, regexp_extract(uri, '://([a-zA-Z0-9_:-]+)', 1) AS pv_name, dest, CASE serialization WHEN 'json' THEN 1 ELSE 2 END AS ser FROM ask
  WHERE regexp_full_match(uri, '(pva?|ca)://[a-zA-Z0-9_-]+(:[a-zA-Z0-9_-]+)*([.][a-zA-Z0-9_-]+([.][a-zA-Z0-9_]+)*)?')),
subs AS (SELECT pv_name, coalesce(dest, replace(pv_name, ':', '_')) AS dest, ser, min(ts_us) AS since FROM good GROUP BY ALL)""", body=f"""
SELECT dest AS topic, pv_name AS key, CAST(ser AS INTEGER) AS event_serialization, seq, {_payload('ser')} AS value
FROM nt JOIN subs USING (pv_name) WHERE ts_us >= since"""))
def pipeline_monitor(spark, sf):
    """Command text -> subscriptions -> each event to their topics from then on, encoded once per serialization."""
    asked = sinks.saved(C.monitor_requests(PC.decoded(spark, sf)), "monitors")
    code = F.when(F.col("serialization") == "json", E.SER_JSON).otherwise(E.SER_MSGPACK)
    subs = asked.withColumn("event_serialization", code).withColumnRenamed("ts_us", "since_us")
    events = _nt_events(spark, sf)
    return _sent(O.encode_once(events, subs, E.encoders(events.schema["data"].dataType), since="since_us"))
