"""Nested-value and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pvflow.functions import nested as N
from pvflow.functions import packing as PK
from pvflow.operators import commands as C
from pvflow.operators import encode as E
from pvflow.operators import latest as L
from pvflow.operators import puts as P
from pvflow.operators import snapshots as snap
from pvflow.plans import commands as PC
from pvflow.plans import sql as S
from pvflow.plans.catalogue import query, with_ctes
from pvflow.sources import tables as T

_SEV = "CASE WHEN value >= 90 OR value <= 2 THEN 2 WHEN value >= 60 OR value <= 10 THEN 1 ELSE 0 END"
NT = f"""nt AS (SELECT pv_name, ts_us, seq, source, value, {_SEV} AS severity, CAST(seq % 3 AS INTEGER) AS status,
  CASE {_SEV} WHEN 2 THEN 'MAJOR' WHEN 1 THEN 'MINOR' ELSE '' END AS message, ts_us // 1000000 AS sec,
  CAST(ts_us % 1000000 * 1000 AS INTEGER) AS nanos, CAST(seq % 5 AS INTEGER) AS tag, CAST(seq % 4 AS INTEGER) AS form
  FROM pv WHERE event_type = 'Data')"""


@query("alarm_severity", with_ctes(S.SPARSE, NT, body="SELECT pv_name, seq, severity FROM nt"))
def alarm_severity(spark, sf):
    limits = [F.col(f"data.valueAlarm.{n}") for n in ("lowAlarmLimit", "lowWarningLimit", "highWarningLimit", "highAlarmLimit")]
    severity = N.alarm_severity(F.col("data.value"), *limits)
    return T.nt_events(spark, sf).select("pv_name", "seq", severity.alias("severity"))


@query("field_groups", with_ctes(S.SPARSE, NT, body="""
SELECT pv_name, seq, value, severity, sec, 100.0::DOUBLE AS limit_high, 'mm' AS units FROM nt"""))
def field_groups(spark, sf):
    df = T.nt_events(spark, sf)
    df = df.select(
        "pv_name",
        "seq",
        N.pick_fields(df, "data", N.PRINCIPAL).alias("principal"),
        N.pick_fields(df, "data", N.ADDITIONAL).alias("additional"),
    )
    return df.select(
        "pv_name",
        "seq",
        "principal.value",
        F.col("principal.alarm.severity").alias("severity"),
        F.col("principal.timeStamp.secondsPastEpoch").alias("sec"),
        F.col("additional.control.limitHigh").alias("limit_high"),
        F.col("additional.display.units").alias("units"),
    )


@query("field_filter", with_ctes(S.SPARSE, NT, body="""
SELECT pv_name, seq, CASE WHEN seq % 3 IN (0, 1, 2) THEN value END AS value,
  CASE WHEN seq % 3 <> 0 THEN message END AS message, CASE WHEN seq % 3 = 2 THEN 'mm' END AS units FROM nt"""))
def field_filter(spark, sf):
    df = T.nt_events(spark, sf)
    wanted = (
        F.when(F.col("seq") % 3 == 0, F.array(F.lit("value"), F.lit("missing")))
        .when(F.col("seq") % 3 == 1, F.array(F.lit("alarm"), F.lit("value")))
        .otherwise(F.array().cast("array<string>"))
    )
    df = df.withColumn("data", N.keep_fields(df, "data", wanted))
    return df.select(
        "pv_name", "seq", "data.value", F.col("data.alarm.message").alias("message"), F.col("data.display.units").alias("units")
    )


@query("snap_fields", with_ctes(*S.DENSE_SNAP, body="""
SELECT queue_name, iter_index, pv_name, seq, value, CASE WHEN def_id <> 1 THEN ts_us // 1000000 ELSE -1 END AS sec FROM routed"""))
def snap_fields(spark, sf):
    members = T.members(T.dense_definitions(spark, sf))
    members = members.withColumn(
        "fields",
        F.when(F.col("def_id") == 0, F.array().cast("array<string>"))
        .when(F.col("def_id") == 1, F.array(F.lit("value")))
        .otherwise(F.array(F.lit("value"), F.lit("timeStamp"))),
    )
    stamp = F.struct(F.expr("ts_us div 1000000").alias("secondsPastEpoch"))
    events = T.dense_events(spark, sf).withColumn("value", F.struct("value", stamp.alias("timeStamp")))
    rows = snap.buffered(events, members)
    rows = rows.withColumn("value", N.keep_fields(rows, "value", F.col("fields")))
    return rows.select(
        "queue_name",
        "iter_index",
        "pv_name",
        "seq",
        F.col("value.value").alias("value"),
        F.coalesce("value.timeStamp.secondsPastEpoch", F.lit(-1)).alias("sec"),
    )


@query("struct_merge", with_ctes(S.SPARSE, NT, """
a AS (SELECT * FROM nt WHERE source = 'click'), b AS (SELECT * FROM nt WHERE source = 'view')""", body="""
SELECT a.pv_name, a.seq, a.value, a.sec, b.severity, b.message, 'mm' AS units, b.source AS description
FROM a ASOF JOIN b ON a.pv_name = b.pv_name AND a.ts_us >= b.ts_us"""))
def struct_merge(spark, sf):
    events = T.nt_events(spark, sf)
    sides = [events.where(F.col("source") == s).drop("source") for s in ("click", "view")]
    both = L.merge_additional(*sides).withColumn("extra", F.col("matched.data"))
    merged = N.merge_fields(both, [("data", ["value", "timeStamp", "alarm"]), ("extra", ["display", "control", "alarm"])])
    return both.select("pv_name", "seq", merged.alias("m")).select(
        "pv_name",
        "seq",
        "m.value",
        F.col("m.timeStamp.secondsPastEpoch").alias("sec"),
        F.col("m.alarm.severity").alias("severity"),
        F.col("m.alarm.message").alias("message"),
        F.col("m.display.units").alias("units"),
        F.col("m.display.description").alias("description"),
    )


@query("schema_union", with_ctes(S.SPARSE, NT, body="""
SELECT pv_name, seq, value, severity, coalesce(CASE WHEN seq % 2 = 0 THEN 'b' || seq END, message) AS message, status, tag AS extra FROM nt"""))
def schema_union(spark, sf):
    seq = F.col("seq")
    df = T.nt_events(spark, sf).select(
        "pv_name",
        "seq",
        F.struct("data.value", F.struct("data.alarm.severity", "data.alarm.message").alias("alarm")).alias("a"),
        F.struct(
            F.struct(
                F.when(seq % 2 == 0, F.concat(F.lit("b"), seq)).alias("message"), "data.alarm.status"
            ).alias("alarm"),
            F.col("data.timeStamp.userTag").alias("extra"),
        ).alias("b"),
    )
    merged = N.append_structs(F.col("a"), N.struct_type(df, "a"), F.col("b"), N.struct_type(df, "b"))
    return df.withColumn("m", merged).select("pv_name", "seq", "m.value", "m.alarm.*", "m.extra")


_PATHS = ["value", "alarm.message", "display.units", "unknown.path", "control.minStep", "timeStamp.userTag"]
_CHANGES = """chg AS (SELECT pv_name, seq, ['value', 'alarm.message', 'display.units', 'unknown.path', 'control.minStep', 'timeStamp.userTag'][1 + seq % 6] AS path,
  CAST(seq AS VARCHAR) AS v FROM pv WHERE source = 'error')"""


def _changes(spark, sf):
    paths = F.array(*[F.lit(p) for p in _PATHS])
    return T.sparse_events(spark, sf).where("source = 'error'").select(
        "pv_name",
        F.col("seq").alias("change_seq"),
        F.get(paths, (F.col("seq") % 6).cast("int")).alias("path"),
        F.col("seq").cast("string").alias("value"),
    )


@query("put_apply", with_ctes(S.SPARSE, NT, _CHANGES, """
st AS (SELECT * FROM nt QUALIFY row_number() OVER (PARTITION BY pv_name ORDER BY ts_us DESC, seq DESC) = 1),
w AS (SELECT pv_name, arg_max(v, seq) FILTER (WHERE path = 'value') AS w_value, arg_max(v, seq) FILTER (WHERE path = 'alarm.message') AS w_msg,
  arg_max(v, seq) FILTER (WHERE path = 'display.units') AS w_units, arg_max(v, seq) FILTER (WHERE path = 'timeStamp.userTag') AS w_tag
  FROM chg GROUP BY pv_name)""", body="""
SELECT pv_name, coalesce(CAST(w_value AS DOUBLE), value) AS value, coalesce(w_msg, message) AS message,
  coalesce(w_units, 'mm') AS units, coalesce(CAST(w_tag AS INTEGER), tag) AS tag, 0.5::DOUBLE AS min_step, severity
FROM st LEFT JOIN w USING (pv_name)"""))
def put_apply(spark, sf):
    states = L.last_value(T.nt_events(spark, sf), ["data"])
    out = P.put_apply(states, _changes(spark, sf), immutable=["control.minStep"])
    return out.select(
        "pv_name",
        "data.value",
        F.col("data.alarm.message").alias("message"),
        F.col("data.display.units").alias("units"),
        F.col("data.timeStamp.userTag").alias("tag"),
        F.col("data.control.minStep").alias("min_step"),
        F.col("data.alarm.severity").alias("severity"),
    )


@query("put_outcome", with_ctes(S.SPARSE, _CHANGES, body="""
SELECT pv_name, seq AS change_seq, CASE path WHEN 'control.minStep' THEN 'immutable' WHEN 'unknown.path' THEN 'nothing to update' ELSE 'ok' END AS outcome FROM chg"""))
def put_outcome(spark, sf):
    kind = N.struct_type(T.nt_events(spark, sf), "data")
    return P.put_outcome(_changes(spark, sf), kind, immutable=["control.minStep"])


@query("flatten_leaves", with_ctes(S.SPARSE, NT, body="""
SELECT pv_name, seq, unnest([{'path': 'value', 'value': CAST(value AS VARCHAR)}, {'path': 'alarm.severity', 'value': CAST(severity AS VARCHAR)},
  {'path': 'alarm.message', 'value': message}, {'path': 'dims', 'value': '[' || tag || ',' || form || ']'},
  {'path': 'parts[0].k', 'value': CAST(tag AS VARCHAR)}, {'path': 'parts[1].k', 'value': CAST(form AS VARCHAR)}], recursive := true) FROM nt"""))
def flatten_leaves(spark, sf):
    tag, form = F.col("data.timeStamp.userTag"), F.col("data.display.form.index")
    df = T.nt_events(spark, sf).select(
        "pv_name",
        "seq",
        F.struct(
            "data.value",
            F.struct("data.alarm.severity", "data.alarm.message").alias("alarm"),
            F.array(tag, form).alias("dims"),
            F.array(F.struct(tag.alias("k")), F.struct(form.alias("k"))).alias("parts"),
        ).alias("data"),
    )
    return df.select("pv_name", "seq", F.inline(N.leaves(F.col("data"), N.struct_type(df, "data"))))


@query("table_explode", """SELECT 'vec:' || vec_id AS pv_name, CAST(i AS INTEGER) AS "row", 'e' || i AS element, embedding[i + 1] AS x
FROM embeddings, LATERAL (SELECT unnest(range(0, len(embedding))) AS i)""")
def table_explode(spark, sf):
    vectors = T.table(spark, sf, "embeddings")
    last = F.size("embedding") - 1
    element = F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(F.lit("e"), i))
    df = vectors.select(
        F.concat(F.lit("vec:"), "vec_id").alias("pv_name"),
        F.struct(element.alias("element"), F.col("embedding").alias("x")).alias("table"),
    )
    return N.table_rows(df, "table")


_NT_JSON = """'{"value":' || CASE WHEN seq % 50 = 0 THEN '"NaN"' ELSE CAST(value AS VARCHAR) END || ',"alarm":{"severity":' || severity
  || ',"status":' || status || ',"message":"' || message || '"},"timeStamp":{"secondsPastEpoch":' || sec || ',"nanoseconds":' || nanos
  || ',"userTag":' || tag || '}}'"""


def principal(spark, sf):
    df = T.nt_events(spark, sf)
    return df.withColumn("data", N.pick_fields(df, "data", ["value", "alarm", "timeStamp"]))


@query("encode_json", with_ctes(S.SPARSE, NT, body=f"""
SELECT seq, CASE WHEN seq % 2 = 0 THEN '{{"reply_id":"r' || seq || '",' ELSE '{{' END || '"' || pv_name || '":' || {_NT_JSON} || '}}' AS payload FROM nt"""))
def encode_json(spark, sf):
    df = principal(spark, sf)
    nan = F.when(F.col("seq") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("data.value"))
    df = df.withColumn("data", F.col("data").withField("value", nan))
    pv, data = F.col("pv_name"), F.col("data")
    with_id = E.encode_json(pv, data, F.concat(F.lit("r"), "seq"))
    return df.select("seq", F.when(F.col("seq") % 2 == 0, with_id).otherwise(E.encode_json(pv, data)).alias("payload"))


_LEAVES = [S.mp_double("value"), S.mp_int("severity"), S.mp_int("status"), S.mp_text("message"), S.mp_int("sec"), S.mp_int("nanos"), S.mp_int("tag")]
_NT_PACK = S.mp_map(
    value=_LEAVES[0],
    alarm=S.mp_map(severity=_LEAVES[1], status=_LEAVES[2], message=_LEAVES[3]),
    timeStamp=S.mp_map(secondsPastEpoch=_LEAVES[4], nanoseconds=_LEAVES[5], userTag=_LEAVES[6]),
)
NT_FULL = f"'81' || {S.mp_text('pv_name')} || {_NT_PACK}"
NT_COMPACT = f"'98' || {S.mp_text('pv_name')} || " + " || ".join(_LEAVES)
NT_JSON = """'{"' || pv_name || '":{"value":' || value || ',"alarm":{"severity":' || severity || ',"status":' || status || ',"message":"' || message
  || '"},"timeStamp":{"secondsPastEpoch":' || sec || ',"nanoseconds":' || nanos || ',"userTag":' || tag || '}}}'"""


@query("encode_msgpack", with_ctes(S.SPARSE, NT, body=f"SELECT pv_name, seq, {(NT_FULL)} AS payload FROM nt"))
def encode_msgpack(spark, sf):
    return E.encode_msgpack(principal(spark, sf)).select("pv_name", "seq", F.hex("value").alias("payload"))


@query("encode_compact", with_ctes(S.SPARSE, NT, body=f"SELECT pv_name, seq, {(NT_COMPACT)} AS payload FROM nt"))
def encode_compact(spark, sf):
    out = E.encode_msgpack(principal(spark, sf), compact=True)
    return out.select("pv_name", "seq", F.hex("value").alias("payload"))


_SOME = S.mp_map(value=_LEAVES[0], alarm=S.mp_map(severity=_LEAVES[1], status=_LEAVES[2], message=_LEAVES[3]))


@query("field_filter_msgpack", with_ctes(S.SPARSE, NT, body=f"""
SELECT seq, '81' || {S.mp_text('pv_name')} || CASE seq % 3 WHEN 0 THEN {S.mp_map(value=_LEAVES[0])} WHEN 1 THEN {_SOME} ELSE {_NT_PACK} END AS payload FROM nt"""))
def field_filter_msgpack(spark, sf):
    """Fields outside a row's filter are not in its payload at all."""
    df = principal(spark, sf)
    names = lambda *n: F.array(*[F.lit(x) for x in n])
    wanted = F.when(F.col("seq") % 3 == 0, names("value", "missing")).when(F.col("seq") % 3 == 1, names("alarm", "value"))
    wanted = wanted.otherwise(F.array().cast("array<string>"))
    message = E.msgpack_message(F.col("pv_name"), F.col("data"), df.schema["data"].dataType, wanted=wanted)
    return df.select("seq", F.hex(message).alias("payload"))


_CHOSEN = "CASE WHEN seq % 5 = 4 THEN NULL WHEN seq % 2 = 0 THEN 'num' ELSE 'text' END"
_UNION_SQL = f"(CASE WHEN seq % 5 = 4 THEN '81A0C0' WHEN seq % 2 = 0 THEN {S.mp_map(num=S.mp_int('status'))} ELSE {S.mp_map(text=S.mp_text('message'))} END)"
_UNION_BODY = S.mp_map(value=_UNION_SQL, list=f"'92' || {_UNION_SQL} || {S.mp_map(num=S.mp_int('tag'))}", id=S.mp_int("seq"))


def union_events(spark, sf):
    """Events whose value is a union of a number and a text, and that carry a list of two such unions."""
    kind = PK.union_type(num="INT", text="STRING")
    chosen, absent = F.expr(_CHOSEN), F.lit(None).cast("string")
    number = F.when(chosen == "num", F.col("data.alarm.status"))
    text = F.when(chosen == "text", F.col("data.alarm.message"))
    union = F.struct(chosen.alias(PK.TAG), number.alias("num"), text.alias("text")).cast(kind)
    other = F.struct(F.lit("num").alias(PK.TAG), F.col("data.timeStamp.userTag").alias("num"), absent.alias("text")).cast(kind)
    data = F.struct(union.alias("value"), F.array(union, other).alias("list"), F.col("seq").alias("id"))
    return T.nt_events(spark, sf).select("pv_name", "seq", data.alias("data"))


@query("encode_union", with_ctes(S.SPARSE, NT, body=f"""
SELECT seq, {(f"'81' || {S.mp_text('pv_name')} || {_UNION_BODY}")} AS packed,
  {(f"'92' || {S.mp_text('pv_name')} || {S.mp_int('seq')}")} AS compact,
  '{{"' || pv_name || '":{{' || CASE WHEN seq % 5 = 4 THEN '' WHEN seq % 2 = 0 THEN '"value":"' || status || '",' ELSE '"value":"' || message || '",' END
    || '"id":' || seq || '}}}}' AS json FROM nt"""))
def encode_union(spark, sf):
    """Unions as one-entry maps in MsgPack; JSON shows the selected value, the compact form leaves them out."""
    df = union_events(spark, sf)
    pv, data, kind = F.col("pv_name"), F.col("data"), df.schema["data"].dataType
    return df.select(
        "seq",
        F.hex(E.msgpack_message(pv, data, kind)).alias("packed"),
        F.hex(E.msgpack_message(pv, data, kind, compact=True)).alias("compact"),
        E.encode_json(pv, E.encode_union(data, kind)).alias("json"),
    )


_KIND = "value DOUBLE, alarm STRUCT<severity: INT, message: STRING>, timeStamp STRUCT<secondsPastEpoch: BIGINT>, missing STRING"


@query("decode_job", with_ctes(S.SPARSE, NT, body="""
SELECT seq, pv_name, value, severity, message, sec, CAST(NULL AS VARCHAR) AS missing FROM nt"""))
def decode_job(spark, sf):
    packed = E.encode_msgpack(principal(spark, sf)).select("seq", "value")
    return E.decode_msgpack(packed, _KIND).select(
        "seq",
        "pv_name",
        "data.value",
        "data.alarm.severity",
        "data.alarm.message",
        F.col("data.timeStamp.secondsPastEpoch").alias("sec"),
        "data.missing",
    )


@query("decode_union", with_ctes(S.SPARSE, NT, body=f"""
SELECT seq, pv_name, {_CHOSEN} AS tag, CASE WHEN {_CHOSEN} = 'num' THEN status END AS num, CASE WHEN {_CHOSEN} = 'text' THEN message END AS text,
  CAST(2 AS INTEGER) AS n_list, tag AS last_num, seq AS id FROM nt"""))
def decode_union(spark, sf):
    """Unions through MsgPack and back by their schema."""
    df = union_events(spark, sf)
    packed = E.encode_msgpack(df).select("value")
    back = E.decode_msgpack(packed, df.schema["data"].dataType)
    value, last = F.col("data.value"), F.element_at("data.list", -1)
    return back.select(
        F.col("data.id").alias("seq"),
        "pv_name",
        value[PK.TAG].alias("tag"),
        value["num"].alias("num"),
        value["text"].alias("text"),
        F.size("data.list").alias("n_list"),
        last["num"].alias("last_num"),
        F.col("data.id").alias("id"),
    )


@query("reply_json", with_ctes(*PC.DECODED, PC._VALIDATED, body="""
SELECT cmd_seq, '{"error":' || error || ',"reply_id":"' || reply_id || '","message":"' || CASE error
  WHEN -1 THEN 'The snapshot type Unknown is not supported' WHEN -3 THEN 'The repeat delay is not valid ' || snapshot_name
  WHEN -4 THEN 'The time window is not valid ' || snapshot_name WHEN -5 THEN 'The snapshot name is not valid ' || snapshot_name
  WHEN -6 THEN 'The pv uri ' || bad[1] || ' is not parsable' ELSE 'The snapshot ''' || snapshot_name || ''' has been started' END || '"'
  || CASE WHEN error = 0 THEN ',"publishing_topic":"' || lower(replace(snapshot_name, ' ', '_')) || '"' ELSE '' END || '}' AS reply
FROM val WHERE status = 'valid' AND kind = 'repeating_snapshot'"""))
def reply_json(spark, sf):
    checked = C.validate_snapshot(PC._valid(spark, sf, "repeating_snapshot"))
    topic = F.when(F.col("error") == 0, C.snapshot_topic(F.col("snapshot_name"))).otherwise("")
    checked = checked.withColumn("publishing_topic", topic)
    return checked.select("cmd_seq", E.reply_json("message", "publishing_topic").alias("reply"))


@query("frame_json", with_ctes(*S.DENSE_SNAP, S.ITERS, S.LAST, S.GRID, """
f AS (SELECT queue_name, 0 AS k, iter_index, '{"message_type":0,"iter_index":' || iter_index || ',"snapshot_name":"' || snapshot_name
    || '","timestamp":' || to_us // 1000 || '}' AS payload FROM iters
  UNION ALL SELECT queue_name, 2, iter_index, '{"message_type":2,"error":0,"error_message":"","iter_index":' || iter_index || ',"timestamp":'
    || to_us // 1000 || ',"snapshot_name":"' || snapshot_name || '"}' FROM iters
  UNION ALL SELECT queue_name, 1, iter_index, '{"message_type":1,"iter_index":' || iter_index || ',"timestamp":' || to_us // 1000
    || ',"' || pv_name || '":' || value || '}' FROM grid WHERE seq IS NOT NULL)""", body="""
SELECT queue_name, CAST(iter_index AS BIGINT) AS iter_index, payload FROM f"""))
def frame_json(spark, sf):
    frames = snap.normal_frames(T.dense_events(spark, sf), T.members(T.dense_definitions(spark, sf)))
    return frames.select("queue_name", "iter_index", E.frame_json(F.col("value")).alias("payload"))


_REPLY_TEXT = """CASE error WHEN -1 THEN 'The snapshot type Unknown is not supported' WHEN -3 THEN 'The repeat delay is not valid ' || snapshot_name
  WHEN -4 THEN 'The time window is not valid ' || snapshot_name WHEN -5 THEN 'The snapshot name is not valid ' || snapshot_name
  WHEN -6 THEN 'The pv uri ' || bad[1] || ' is not parsable' ELSE 'The snapshot ''' || snapshot_name || ''' has been started' END"""
_REPLY_PACK = S.mp_map(error=S.mp_int("error"), reply_id=S.mp_text("reply_id"), message=S.mp_text("msg"))
_REPLY_TOPIC = S.mp_map(error=S.mp_int("error"), reply_id=S.mp_text("reply_id"), message=S.mp_text("msg"), publishing_topic=S.mp_text("topic"))


@query("reply_msgpack", with_ctes(*PC.DECODED, PC._VALIDATED, f"""
told AS (SELECT *, {_REPLY_TEXT} AS msg, lower(replace(snapshot_name, ' ', '_')) AS topic FROM val
  WHERE status = 'valid' AND kind = 'repeating_snapshot')""", body=f"""
SELECT cmd_seq, {(f"CASE WHEN error = 0 THEN {_REPLY_TOPIC} ELSE {_REPLY_PACK} END")} AS reply FROM told"""))
def reply_msgpack(spark, sf):
    checked = C.validate_snapshot(PC._valid(spark, sf, "repeating_snapshot"))
    topic = F.when(F.col("error") == 0, C.snapshot_topic(F.col("snapshot_name"))).otherwise("")
    checked = checked.withColumn("publishing_topic", topic)
    return checked.select("cmd_seq", F.hex(E.reply_msgpack("message", "publishing_topic")).alias("reply"))


def frame_maps() -> dict[str, str]:
    """Hexadecimal MsgPack of header, data and tail out of the columns of an iteration, and of a PV value."""
    number, stamp, name = S.mp_int("iter_index"), S.mp_int("(to_us // 1000)"), S.mp_text("snapshot_name")
    data = S.mp_map(message_type="'01'", timestamp=stamp, iter_index=number).replace("'83' ||", "'84' ||", 1)
    return {
        "header": S.mp_map(message_type="'00'", snapshot_name=name, timestamp=stamp, iter_index=number),
        "data": f"{data} || {S.mp_text('pv_name')} || {S.mp_double('value')}",
        "tail": S.mp_map(message_type="'02'", error="'00'", iter_index=number, timestamp=stamp, snapshot_name=name),
    }


_MAPS = frame_maps()


@query("frame_msgpack", with_ctes(*S.DENSE_SNAP, S.ITERS, S.LAST, S.GRID, f"""
f AS (SELECT queue_name, iter_index, {_MAPS['header']} AS hx FROM iters UNION ALL SELECT queue_name, iter_index, {_MAPS['tail']} FROM iters
  UNION ALL SELECT queue_name, iter_index, {_MAPS['data']} FROM grid WHERE seq IS NOT NULL)""", body=f"""
SELECT queue_name, CAST(iter_index AS BIGINT) AS iter_index, {('hx')} AS payload FROM f"""))
def frame_msgpack(spark, sf):
    frames = snap.normal_frames(T.dense_events(spark, sf), T.members(T.dense_definitions(spark, sf)))
    payload = E.frame_msgpack(F.col("value"), frames.schema["value"].dataType)
    return frames.select("queue_name", "iter_index", F.hex(payload).alias("payload"))
