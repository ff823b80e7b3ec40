"""Control-message queries on the synthesized commands."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvflow.functions import names as N
from pvflow.functions import variants as V
from pvflow.operators import commands as C
from pvflow.operators import snapshots as snap
from pvflow.operators.ordered import slice_width
from pvflow.plans import sql as S
from pvflow.plans.catalogue import query, with_ctes
from pvflow.sources import tables as T

CMD = f"cmd AS ({T.COMMAND_SQL})"
JS = """js AS (SELECT cmd_seq, ts_us, value, CASE WHEN json_valid(value) THEN CAST(value AS JSON) END AS j FROM cmd)"""


def _text(key: str, default: str = "''") -> str:
    return f"CASE WHEN json_type(j, '$.{key}') = 'VARCHAR' THEN json_extract_string(j, '$.{key}') ELSE {default} END"


def _int(key: str, default: int) -> str:
    return f"""CAST(CASE WHEN json_type(j, '$.{key}') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      AND CAST(json_extract(j, '$.{key}') AS DOUBLE) = floor(CAST(json_extract(j, '$.{key}') AS DOUBLE))
      THEN CAST(json_extract(j, '$.{key}') AS DOUBLE) ELSE {default} END AS INTEGER)"""


def _list(key: str) -> str:
    return f"""CASE WHEN json_type(j, '$.{key}') = 'ARRAY' THEN list_sort(list_distinct(list_transform(
      list_filter(json_extract(j, '$.{key}[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: x ->> '$')))
      ELSE [] END"""


_KINDS = ", ".join(f"'{k}'" for k in C.KINDS)
FLD = f"""fld AS (SELECT cmd_seq, ts_us, value, j, json_type(j) = 'OBJECT' AS is_obj, json_type(j, '$.command') AS ct,
  CASE WHEN {_text('command')} IN ({_KINDS}) THEN {_text('command')} ELSE 'unknown' END AS kind,
  CASE WHEN lower({_text('serialization')}) = 'json' THEN 'json' ELSE 'msgpack' END AS serialization,
  {_text('reply_topic')} AS reply_topic, {_text('reply_id')} AS reply_id, {_text('pv_name')} AS pv_name,
  {_text('value')} AS put_value, {_text('monitor_dest_topic', _text('reply_topic'))} AS monitor_dest_topic,
  {_list('pv_name_list')} AS pvs, {_list('pv_field_filter_list')} AS fields, {_text('snapshot_name')} AS snapshot_name,
  {_int('repeat_delay_msec', 0)} AS repeat_delay_msec, {_int('time_window_msec', 1000)} AS time_window_msec,
  {_int('sub_push_delay_msec', 0)} AS sub_push_delay_msec,
  CASE WHEN json_type(j, '$.triggered') = 'BOOLEAN' THEN CAST(json_extract(j, '$.triggered') AS BOOLEAN) ELSE false END AS triggered,
  CASE lower({_text('type', "'normal'")}) WHEN 'normal' THEN 'Normal' WHEN 'timedbuffered' THEN 'TimedBuffered' ELSE 'Unknown' END AS snapshot_type,
  CASE WHEN json_type(j, '$.tags.shot') = 'VARCHAR' THEN json_extract_string(j, '$.tags.shot') END AS shot
  FROM js)"""
REQ = """req AS (SELECT *, coalesce(CASE
    WHEN kind = 'monitor' THEN json_type(j, '$.pv_name') = 'VARCHAR'
    WHEN kind = 'multi-monitor' THEN json_type(j, '$.pv_name_list') = 'ARRAY'
    WHEN kind IN ('get', 'info') THEN json_type(j, '$.pv_name') = 'VARCHAR' AND json_type(j, '$.reply_topic') = 'VARCHAR'
    WHEN kind = 'put' THEN json_type(j, '$.pv_name') = 'VARCHAR' AND json_type(j, '$.value') = 'VARCHAR'
    WHEN kind IN ('snapshot', 'repeating_snapshot') THEN json_type(j, '$.pv_name_list') = 'ARRAY'
      AND json_type(j, '$.reply_topic') = 'VARCHAR' AND json_type(j, '$.reply_id') = 'VARCHAR'
    WHEN kind LIKE 'repeating%' THEN json_type(j, '$.reply_topic') = 'VARCHAR' AND json_type(j, '$.reply_id') = 'VARCHAR'
    END, false) AS required FROM fld)"""
DEC = """dec AS (SELECT *, CASE WHEN is_obj IS NOT TRUE THEN 'corrupt' WHEN ct <> 'VARCHAR' THEN 'fault'
    WHEN required AND (kind NOT IN ('multi-monitor', 'snapshot', 'repeating_snapshot') OR len(pvs) > 0)
      AND (kind <> 'monitor' OR monitor_dest_topic <> '') THEN 'valid' ELSE 'invalid' END AS status FROM req)"""
DECODED = (CMD, JS, FLD, REQ, DEC)


def decoded(spark, sf):
    return C.decode(T.commands(spark, sf))


def _joined(column: str):
    return F.array_join(F.array_sort(column), ",")


def _asof_width(spark, sf):
    times = T.commands(spark, sf).select("ts_us").unionAll(T.sparse_events(spark, sf).select("ts_us"))
    return slice_width(times, "ts_us")


def _valid(spark, sf, kind):
    return decoded(spark, sf).where((F.col("status") == "valid") & (F.col("kind") == kind))


def _opened(spark, sf):
    return C.opened(T.commands(spark, sf))


@query("cmd_kind", with_ctes(CMD, JS, FLD, body="SELECT cmd_seq, kind FROM fld"))
def cmd_kind(spark, sf):
    return _opened(spark, sf).select("cmd_seq", "kind")


@query("cmd_required", with_ctes(CMD, JS, FLD, REQ, body="SELECT cmd_seq, kind, required FROM req"))
def cmd_required(spark, sf):
    return _opened(spark, sf).select("cmd_seq", "kind", C.required_present().alias("required"))


@query("cmd_defaults", with_ctes(CMD, JS, FLD, body="""
SELECT cmd_seq, repeat_delay_msec, time_window_msec, sub_push_delay_msec, triggered, snapshot_name FROM fld"""))
def cmd_defaults(spark, sf):
    return _opened(spark, sf).select(
        "cmd_seq",
        V.integer("repeat_delay_msec", 0).alias("repeat_delay_msec"),
        V.integer("time_window_msec", 1000).alias("time_window_msec"),
        V.integer("sub_push_delay_msec", 0).alias("sub_push_delay_msec"),
        V.boolean("triggered", False).alias("triggered"),
        V.text("snapshot_name").alias("snapshot_name"),
    )


@query("cmd_tags", with_ctes(CMD, JS, FLD, body="""
SELECT cmd_seq, shot, CASE WHEN shot IS NULL THEN 0 ELSE 1 END AS n_tags FROM fld"""))
def cmd_tags(spark, sf):
    df = _opened(spark, sf).withColumn("tags", V.string_map("tags"))
    return df.select("cmd_seq", F.try_element_at("tags", F.lit("shot")).alias("shot"), F.size("tags").alias("n_tags"))


@query("cmd_serialization", with_ctes(CMD, JS, FLD, body="SELECT cmd_seq, serialization FROM fld"))
def cmd_serialization(spark, sf):
    return _opened(spark, sf).select("cmd_seq", C.serialization().alias("serialization"))


@query("snap_type", with_ctes(CMD, JS, FLD, body="SELECT snapshot_type, count(*) AS n FROM fld GROUP BY ALL"))
def snap_type(spark, sf):
    named = _opened(spark, sf).select(C.snapshot_type(V.text("type", "normal")).alias("snapshot_type"))
    return named.groupBy("snapshot_type").agg(F.count(F.lit(1)).alias("n"))


def _register_kind(name, kind, columns, sql_columns):
    where = f"SELECT {sql_columns} FROM dec WHERE status = 'valid' AND kind = '{kind}'"

    @query(name, with_ctes(*DECODED, body=where))
    def run(spark, sf):
        return _valid(spark, sf, kind).select(*columns)

    return run


_BASE = ["cmd_seq", "serialization", "reply_topic", "reply_id"]
_B = "cmd_seq, serialization, reply_topic, reply_id, "
_PVS = "array_to_string(pvs, ',') AS pv_list"
_register_kind("cmd_monitor", "monitor", [*_BASE, "pv_name", "monitor_dest_topic"], _B + "pv_name, monitor_dest_topic")


@query("cmd_multi_monitor", with_ctes(*DECODED, body=f"""
SELECT {_B} {_PVS} FROM dec WHERE status = 'valid' AND kind = 'multi-monitor'"""))
def cmd_multi_monitor(spark, sf):
    return _valid(spark, sf, "multi-monitor").select(*_BASE, _joined("pv_name_list").alias("pv_list"))


_register_kind("cmd_get", "get", [*_BASE, "pv_name"], _B + "pv_name")
_register_kind("cmd_put", "put", [*_BASE, "pv_name", "put_value"], _B + "pv_name, put_value")
_register_kind("cmd_info", "info", [*_BASE, "pv_name"], _B + "pv_name")


@query("cmd_snapshot", with_ctes(*DECODED, body=f"""
SELECT {_B} {_PVS}, time_window_msec FROM dec WHERE status = 'valid' AND kind = 'snapshot'"""))
def cmd_snapshot(spark, sf):
    return _valid(spark, sf, "snapshot").select(*_BASE, _joined("pv_name_list").alias("pv_list"), "time_window_msec")


_REP = ["snapshot_name", "repeat_delay_msec", "time_window_msec", "sub_push_delay_msec", "triggered", "snapshot_type"]


@query("cmd_repeating", with_ctes(*DECODED, body=f"""
SELECT {_B} {_PVS}, {', '.join(_REP)}, array_to_string(fields, ',') AS field_list
FROM dec WHERE status = 'valid' AND kind = 'repeating_snapshot'"""))
def cmd_repeating(spark, sf):
    return _valid(spark, sf, "repeating_snapshot").select(
        *_BASE, *_REP, _joined("pv_name_list").alias("pv_list"), _joined("pv_field_filter_list").alias("field_list")
    )


@query("cmd_stop_trigger", with_ctes(*DECODED, body=f"""
SELECT {_B} kind, snapshot_name, CASE WHEN kind LIKE '%trigger' THEN shot END AS shot FROM dec
WHERE status = 'valid' AND kind IN ('repeating_snapshot_stop', 'repeating_snapshot_trigger')"""))
def cmd_stop_trigger(spark, sf):
    df = decoded(spark, sf).where(
        "status = 'valid' AND kind IN ('repeating_snapshot_stop', 'repeating_snapshot_trigger')"
    )
    shot = F.when(F.col("kind") == "repeating_snapshot_trigger", F.try_element_at("tags", F.lit("shot")))
    return df.select(*_BASE, "kind", "snapshot_name", shot.alias("shot"))


@query("cmd_dead_letter", with_ctes(*DECODED, body="""
SELECT cmd_seq, reply_topic, 'comand-parse-error-reply' AS reply_key, -1 AS error, reply_id, serialization
FROM dec WHERE status = 'invalid' AND reply_id <> '' AND reply_topic <> ''"""))
def cmd_dead_letter(spark, sf):
    return C.dead_letters(decoded(spark, sf))


@query("cmd_corrupt", with_ctes(*DECODED, body="""
SELECT cmd_seq, value, status FROM dec WHERE status IN ('corrupt', 'fault')"""))
def cmd_corrupt(spark, sf):
    return decoded(spark, sf).where("status IN ('corrupt', 'fault')").select("cmd_seq", "value", "status")


@query("cmd_dispatch", with_ctes(*DECODED, body="""
SELECT coalesce(CASE WHEN kind LIKE '%monitor' THEN 'monitor' WHEN kind LIKE '%snapshot%' THEN 'snapshot'
  WHEN kind IN ('get', 'put') THEN kind END, 'no_worker_found') AS worker, kind, count(*) AS n
FROM dec WHERE status = 'valid' GROUP BY ALL"""))
def cmd_dispatch(spark, sf):
    worker = F.coalesce("worker", F.lit("no_worker_found")).alias("worker")
    return C.dispatch(decoded(spark, sf)).groupBy(worker, "kind").agg(F.count(F.lit(1)).alias("n"))


@query("monitor_reply", with_ctes(*DECODED, body="""
SELECT cmd_seq, reply_topic, reply_id, CASE WHEN serialization <> 'msgpack' THEN -3 ELSE 0 END AS error,
  CASE WHEN serialization <> 'msgpack' THEN 'No serializer found'
    WHEN kind = 'monitor' THEN 'Monitor activated for ' || pv_name ELSE 'Monitor activated' END AS message
FROM dec WHERE status = 'valid' AND kind IN ('monitor', 'multi-monitor') AND reply_topic <> '' AND reply_id <> ''"""))
def monitor_reply(spark, sf):
    return C.monitor_replies(decoded(spark, sf), ["msgpack"])


_VALIDATED = """chk AS (SELECT *, list_filter(pvs, lambda u: NOT regexp_full_match(u,
  '(pva?|ca)://[a-zA-Z0-9_-]+(:[a-zA-Z0-9_-]+)*([.][a-zA-Z0-9_-]+([.][a-zA-Z0-9_]+)*)?')) AS bad FROM dec),
val AS (SELECT *, CASE WHEN snapshot_type = 'Unknown' THEN -1 WHEN len(pvs) = 0 THEN -2 WHEN repeat_delay_msec < 0 THEN -3
  WHEN time_window_msec < 0 THEN -4 WHEN snapshot_name = '' THEN -5 WHEN len(bad) > 0 THEN -6 ELSE 0 END AS error FROM chk)"""


@query("snap_validate", with_ctes(*DECODED, _VALIDATED, body="""
SELECT cmd_seq, error, CASE error WHEN -1 THEN 'The snapshot type Unknown is not supported'
  WHEN -2 THEN 'PV name list is empty for snapshot ' || snapshot_name
  WHEN -3 THEN 'The repeat delay is not valid ' || snapshot_name WHEN -4 THEN 'The time window is not valid ' || snapshot_name
  WHEN -5 THEN 'The snapshot name is not valid ' || snapshot_name WHEN -6 THEN 'The pv uri ' || bad[1] || ' is not parsable'
  ELSE 'The snapshot ''' || snapshot_name || ''' has been started' END AS message
FROM val WHERE status = 'valid' AND kind = 'repeating_snapshot'"""))
def snap_validate(spark, sf):
    return C.validate_snapshot(_valid(spark, sf, "repeating_snapshot")).select("cmd_seq", "error", "message")


_LIFE = """ops AS (SELECT lower(regexp_replace(snapshot_name, '[^A-Za-z0-9-]', '_', 'g')) AS queue_name, snapshot_name,
  ts_us, cmd_seq AS seq, CASE kind WHEN 'repeating_snapshot' THEN 'start' WHEN 'repeating_snapshot_stop' THEN 'stop' ELSE 'trigger' END AS op,
  CASE WHEN kind = 'repeating_snapshot' THEN error ELSE 0 END AS e
  FROM val WHERE status = 'valid' AND kind LIKE 'repeating%'),
st AS (SELECT *, coalesce(last_value(CASE WHEN op = 'start' AND e = 0 THEN 1 WHEN op = 'stop' AND snapshot_name <> '' THEN 0 END IGNORE NULLS)
  OVER (PARTITION BY queue_name ORDER BY ts_us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS running FROM ops),
life AS (SELECT queue_name, ts_us, seq, op,
  CASE WHEN op = 'start' THEN CASE WHEN e = -1 THEN -1 WHEN running THEN 0 ELSE e END
    WHEN snapshot_name = '' THEN -1 WHEN op = 'stop' OR running THEN 0 ELSE -2 END AS error,
  CASE WHEN op = 'start' THEN CASE WHEN e = -1 THEN 'rejected' WHEN running THEN 'already running' WHEN e <> 0 THEN 'rejected' ELSE 'started' END
    WHEN snapshot_name = '' THEN 'rejected'
    WHEN op = 'stop' THEN CASE WHEN running THEN 'stopped' ELSE 'already stopped' END
    WHEN running THEN 'armed' ELSE 'not found' END AS outcome FROM st)"""


def _life(spark, sf):
    # measured on the raw messages: fewer columns, and no second decoding
    width = slice_width(T.commands(spark, sf), "ts_us")
    return snap.lifecycle(C.snapshot_commands(decoded(spark, sf)), width=width), width


@query("snap_lifecycle", with_ctes(*DECODED, _VALIDATED, _LIFE, body="""
SELECT queue_name, ts_us, seq, op AS kind, error, outcome FROM life"""))
def snap_lifecycle(spark, sf):
    replies, _ = _life(spark, sf)
    return replies.select("queue_name", "ts_us", "seq", "kind", "error", "outcome")


@query("snap_runs", with_ctes(*DECODED, _VALIDATED, _LIFE, """
edge AS (SELECT *, lead(ts_us) OVER (PARTITION BY queue_name ORDER BY ts_us, seq) AS stop_us FROM life
  WHERE outcome IN ('started', 'stopped'))""", body="""
SELECT queue_name, ts_us AS start_us, seq, coalesce(stop_us, -1) AS stop_us FROM edge WHERE outcome = 'started'"""))
def snap_runs(spark, sf):
    replies, width = _life(spark, sf)
    runs = snap.run_intervals(replies, width=width)
    return runs.select("queue_name", "start_us", "seq", F.coalesce("stop_us", F.lit(-1)).alias("stop_us"))


_PUT = """put AS (SELECT *, CASE WHEN put_value IN ('not base64!', '') THEN -1 WHEN put_value = 'gQ==' THEN -2
  WHEN substr(hex(from_base64(put_value)), 1, 1) <> '8' THEN -3
  WHEN NOT regexp_full_match(pv_name, '(pva?|ca)://[a-zA-Z0-9_-]+(:[a-zA-Z0-9_-]+)*([.][a-zA-Z0-9_-]+([.][a-zA-Z0-9_]+)*)?') THEN -4
  ELSE 0 END AS error, regexp_extract(pv_name, '://([a-zA-Z0-9_:-]+)', 1) AS name
  FROM dec WHERE status = 'valid' AND kind = 'put')"""


@query("put_validate", with_ctes(*DECODED, _PUT, body="""
SELECT cmd_seq, error, CASE error WHEN -1 THEN 'Base64 decode error during put command processing'
  WHEN -2 THEN 'Unpack msgpack object error during put command processing' WHEN -3 THEN 'Msgpack object need to be a map'
  WHEN -4 THEN 'PV name malformed' ELSE 'Successfull operation' END AS message FROM put"""))
def put_validate(spark, sf):
    return C.put_errors(_valid(spark, sf, "put")).select("cmd_seq", "error", "message")


@query("put_reply", with_ctes(*DECODED, _PUT, S.SPARSE, body="""
SELECT put.cmd_seq, CASE WHEN error <> 0 THEN error WHEN pv.event_type IS NULL THEN -3
  WHEN pv.event_type = 'Fail' THEN -2 ELSE 0 END AS error
FROM (SELECT * FROM put WHERE reply_topic <> '' AND reply_id <> '') put ASOF LEFT JOIN pv ON put.name = pv.pv_name AND put.ts_us >= pv.ts_us"""))
def put_reply(spark, sf):
    puts = _valid(spark, sf, "put").select("cmd_seq", "ts_us", "pv_name", "put_value", "reply_topic", "reply_id")
    out = C.put_replies(puts, T.sparse_events(spark, sf), width=_asof_width(spark, sf))
    return out.select("cmd_seq", "error")


@query("get_reply", with_ctes(*DECODED, S.SPARSE, """
ask AS (SELECT *, ts_us + 10000000 AS until_us, regexp_full_match(pv_name,
  '(pva?|ca)://[a-zA-Z0-9_-]+(:[a-zA-Z0-9_-]+)*([.][a-zA-Z0-9_-]+([.][a-zA-Z0-9_]+)*)?') AS good,
  regexp_extract(pv_name, '://([a-zA-Z0-9_:-]+)', 1) AS name FROM dec WHERE status = 'valid' AND kind = 'get' AND reply_topic <> '')""", """
got AS (SELECT ask.cmd_seq, CASE WHEN NOT good THEN -1 WHEN pv.event_type IS NULL THEN -3
  WHEN pv.event_type = 'Fail' THEN -2 ELSE 0 END AS error, pv.value, pv.seq
FROM ask ASOF LEFT JOIN pv ON ask.name = pv.pv_name AND ask.until_us >= pv.ts_us)""", body="""
SELECT cmd_seq, error, CASE error WHEN -1 THEN 'PV name malformed' WHEN -2 THEN 'Operation failed'
  WHEN -3 THEN 'Timeout operation' END AS message,
  CASE WHEN error = 0 THEN value END AS value, CASE WHEN error = 0 THEN seq ELSE -1 END AS seq FROM got"""))
def get_reply(spark, sf):
    gets = _valid(spark, sf, "get").select("cmd_seq", "ts_us", "pv_name", "reply_topic")
    out = C.get_replies(gets, T.sparse_events(spark, sf), width=_asof_width(spark, sf))
    return out.select("cmd_seq", "error", "message", "value", F.coalesce("seq", F.lit(-1)).alias("seq"))


@query("cmd_counters", with_ctes(*DECODED, body="""
SELECT count(*) FILTER (WHERE status <> 'corrupt') AS received, count(*) FILTER (WHERE status = 'invalid') AS bad,
  count(*) FILTER (WHERE status = 'fault') AS faulty, count(*) FILTER (WHERE status = 'valid') AS submitted,
  count(*) FILTER (WHERE status = 'valid' AND kind = 'info') AS no_worker_found FROM dec"""))
def cmd_counters(spark, sf):
    df = decoded(spark, sf)
    worker = F.try_element_at(
        F.create_map(*[F.lit(x) for pair in C.HANDLERS.items() for x in pair]), F.col("kind")
    )
    valid = F.col("status") == "valid"
    return df.agg(
        F.count_if(F.col("status") != "corrupt").alias("received"),
        F.count_if(F.col("status") == "invalid").alias("bad"),
        F.count_if(F.col("status") == "fault").alias("faulty"),
        F.count_if(valid).alias("submitted"),
        F.count_if(valid & worker.isNull()).alias("no_worker_found"),
    )


_URIS = """CASE c_custkey % 9 WHEN 0 THEN c_name WHEN 1 THEN 'pva://' || c_name WHEN 2 THEN 'ca://variable:' || CAST(c_custkey AS STRING) || '.HIHI'
 WHEN 3 THEN '' WHEN 4 THEN 'pva://variable:a.root.field' WHEN 5 THEN 'pva://channel::' || CAST(c_custkey AS STRING) WHEN 6 THEN 'pv://a'
 WHEN 7 THEN 'ca://' || c_mktsegment || ':x_1.' ELSE 'pva://' || CAST(c_custkey AS STRING) || '.' || c_mktsegment END"""


@query("pv_sanitize", f"""WITH u AS (SELECT c_custkey, {_URIS} AS uri FROM customer),
m AS (SELECT *, regexp_extract(uri, '^(pva?|ca)://([a-zA-Z0-9_-]+(:[a-zA-Z0-9_-]+)*)([.]([a-zA-Z0-9_-]+([.][a-zA-Z0-9_]+)*))?$',
  ['protocol', 'name', 'r1', 'r2', 'field']) AS g FROM u)
SELECT c_custkey, uri, nullif(g.protocol, '') AS protocol, nullif(g.name, '') AS name,
  CASE WHEN g.protocol = '' THEN NULL WHEN g.field = '' THEN 'value' ELSE g.field END AS field,
  CASE WHEN g.protocol = '' THEN NULL WHEN g.protocol = 'pva' THEN 'pva' ELSE 'ca' END AS provider FROM m""")
def pv_sanitize(spark, sf):
    df = T.table(spark, sf, "customer").select("c_custkey", F.expr(_URIS).alias("uri"))
    return df.withColumn("p", N.pv_parts(F.col("uri"))).select("c_custkey", "uri", "p.*")


@query("topic_snapshot", """SELECT p_partkey, lower(regexp_replace(p_name || ' #' || p_brand, '[^A-Za-z0-9-]', '_', 'g')) AS topic FROM part""")
def topic_snapshot(spark, sf):
    named = F.concat("p_name", F.lit(" #"), "p_brand")
    return T.table(spark, sf, "part").select("p_partkey", N.snapshot_topic(named).alias("topic"))


@query("topic_pv", """SELECT replace('ev:' || event_type || ':' || user_id, ':', '_') AS topic, count(*) AS n FROM events GROUP BY ALL""")
def topic_pv(spark, sf):
    name = F.concat(F.lit("ev:"), "event_type", F.lit(":"), "user_id")
    return T.table(spark, sf, "events").groupBy(N.pv_topic(name).alias("topic")).agg(F.count(F.lit(1)).alias("n"))


_REQUESTS = """CASE p_partkey % 4 WHEN 0 THEN 'field(value, alarm,timeStamp)' WHEN 1 THEN 'record[x=1]field( ' || p_brand || ' ,,' || p_type || ')'
 WHEN 2 THEN 'field()' ELSE 'value,alarm' END"""


@query("field_request", f"""WITH r AS (SELECT p_partkey, {_REQUESTS} AS request FROM part)
SELECT p_partkey, array_to_string(list_filter(string_split(regexp_replace(regexp_extract(request, 'field\\(([^)]*)\\)', 1), '\\s', '', 'g'), ','),
  lambda f: f <> ''), '|') AS fields FROM r""")
def field_request(spark, sf):
    df = T.table(spark, sf, "part").select("p_partkey", F.expr(_REQUESTS).alias("request"))
    return df.select("p_partkey", F.array_join(N.requested_fields(F.col("request")), "|").alias("fields"))


_ONCE = """ask AS (SELECT cmd_seq AS request_id, reply_topic, reply_id, ts_us AS t0,
  greatest(CAST(time_window_msec AS BIGINT) * 3600, 1) * 1000 AS w, list_reverse_sort(pvs) AS l FROM dec
  WHERE status = 'valid' AND kind = 'snapshot' AND reply_topic <> ''),
item AS (SELECT * EXCLUDE (l), unnest(l) AS uri, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM ask),
chk AS (SELECT *, regexp_full_match(uri, '(pva?|ca)://[a-zA-Z0-9_-]+(:[a-zA-Z0-9_-]+)*([.][a-zA-Z0-9_-]+([.][a-zA-Z0-9_]+)*)?') AS good FROM item),
cut AS (SELECT *, min(CASE WHEN NOT good THEN pos END) OVER (PARTITION BY request_id) AS bad_at FROM chk),
want AS (SELECT *, regexp_extract(uri, '://([a-zA-Z0-9_:-]+)', 1) AS pv_name FROM cut WHERE bad_at IS NULL OR pos < bad_at),
d AS (SELECT * FROM pv WHERE event_type = 'Data'),
aft AS (SELECT want.*, d.ts_us AS a_ts, d.seq AS a_seq, d.value AS a_value FROM want ASOF LEFT JOIN d ON want.pv_name = d.pv_name AND want.t0 <= d.ts_us),
two AS (SELECT aft.*, d.ts_us AS b_ts, d.seq AS b_seq, d.value AS b_value FROM aft ASOF LEFT JOIN d ON aft.pv_name = d.pv_name AND aft.t0 > d.ts_us),
pick AS (SELECT *, coalesce(a_ts <= t0 + w, false) AS inside FROM two),
answer AS (SELECT request_id, reply_id, pos, pv_name, CASE WHEN inside THEN a_ts ELSE b_ts END AS ts_us,
  CASE WHEN inside THEN a_seq ELSE b_seq END AS seq, CASE WHEN inside THEN a_value ELSE b_value END AS value FROM pick
  WHERE inside OR b_ts IS NOT NULL)"""


def _once(spark, sf):
    requests = _valid(spark, sf, "snapshot").select(
        F.col("cmd_seq").alias("request_id"),
        "reply_topic",
        "reply_id",
        F.col("ts_us").alias("request_us"),
        (F.col("time_window_msec").cast("bigint") * 3600).alias("time_window_msec"),
        F.reverse(F.array_sort("pv_name_list")).alias("pv_name_list"),
    )
    events = T.data_events(spark, sf)
    return snap.once(events, requests, width=_asof_width(spark, sf))


@query("snap_once", with_ctes(*DECODED, S.SPARSE, _ONCE, body="""
SELECT request_id, reply_id, 0 AS error, pos AS element_number, pv_name, ts_us, seq, value FROM answer
UNION ALL SELECT request_id, reply_id, 1, -1, NULL, -1, -1, NULL FROM ask"""))
def snap_once(spark, sf):
    out = _once(spark, sf).where("error >= 0").fillna(-1, ["element_number", "ts_us", "seq"])
    return out.select("request_id", "reply_id", "error", "element_number", "pv_name", "ts_us", "seq", "value")


@query("snap_once_bad", with_ctes(*DECODED, S.SPARSE, _ONCE, body="""
SELECT request_id, CAST(bad_at AS INTEGER) AS element_number, 'PV ''' || uri || '''name malformed' AS message,
  (SELECT count(*) FROM answer a WHERE a.request_id = cut.request_id) AS n_answers FROM cut WHERE pos = bad_at"""))
def snap_once_bad(spark, sf):
    out = _once(spark, sf)
    return (
        out.groupBy("request_id")
        .agg(
            F.max(F.when(F.col("error") == -1, F.col("element_number"))).alias("element_number"),
            F.max("message").alias("message"),
            F.count_if(F.col("error") == 0).alias("n_answers"),
        )
        .where("message IS NOT NULL")
    )
