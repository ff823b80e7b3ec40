"""Control messages: decode, validate, route, and answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pvflow.functions import variants as V
from pvflow.functions.packing import msgpack_kind
from pvflow.functions.names import is_pv_uri, pv_parts, pv_topic, snapshot_topic
from pvflow.operators.asof import asof_join

# The command kinds and the worker group that serves each (info has none).
KINDS = [
    "monitor",
    "multi-monitor",
    "get",
    "put",
    "info",
    "snapshot",
    "repeating_snapshot",
    "repeating_snapshot_stop",
    "repeating_snapshot_trigger",
]
HANDLERS = {
    "monitor": "monitor",
    "multi-monitor": "monitor",
    "get": "get",
    "put": "put",
    "snapshot": "snapshot",
    "repeating_snapshot": "snapshot",
    "repeating_snapshot_stop": "snapshot",
    "repeating_snapshot_trigger": "snapshot",
}
# Keys that must be present, with their JSON kind.
REQUIRED = {
    "monitor": {"pv_name": "string"},
    "multi-monitor": {"pv_name_list": "array"},
    "get": {"pv_name": "string", "reply_topic": "string"},
    "put": {"pv_name": "string", "value": "string"},
    "info": {"pv_name": "string", "reply_topic": "string"},
    "snapshot": {"pv_name_list": "array", "reply_topic": "string", "reply_id": "string"},
    "repeating_snapshot": {"pv_name_list": "array", "reply_topic": "string", "reply_id": "string"},
    "repeating_snapshot_stop": {"reply_topic": "string", "reply_id": "string"},
    "repeating_snapshot_trigger": {"reply_topic": "string", "reply_id": "string"},
}
# The message key and the texts of replies.
PARSE_ERROR_KEY = "comand-parse-error-reply"
PV_MALFORMED = "PV name malformed"
TIMED_OUT = "Timeout operation"
GET_CANCELLED = "Operaton cancelled"
PUT_CANCELLED = "Put operation has been cancelled"
PUT_TEXTS = {
    -1: "Base64 decode error during put command processing",
    -2: "Unpack msgpack object error during put command processing",
    -3: "Msgpack object need to be a map",
    -4: PV_MALFORMED,
    0: "Successfull operation",
}
MONITOR_NO_SERIALIZER = "No serializer found"
MONITOR_NO_TOPIC = "Empty destination topic"
MONITOR_OK, MONITORS_OK = "Monitor activated for ", "Monitor activated"
SNAPSHOT_TEXTS = {
    -1: ("The snapshot type ", " is not supported"),
    -2: ("PV name list is empty for snapshot ", ""),
    -3: ("The repeat delay is not valid ", ""),
    -4: ("The time window is not valid ", ""),
    -5: ("The snapshot name is not valid ", ""),
    -6: ("The pv uri ", " is not parsable"),
    0: ("The snapshot '", "' has been started"),
}

NEEDS_PVS = ["multi-monitor", "snapshot", "repeating_snapshot"]
DEFAULT_WINDOW_MSEC = 1000
GET_TIMEOUT_US = 10_000_000


KEYS = [
    "command",
    "serialization",
    "reply_topic",
    "reply_id",
    "pv_name",
    "value",
    "monitor_dest_topic",
    "pv_name_list",
    "pv_field_filter_list",
    "snapshot_name",
    "repeat_delay_msec",
    "time_window_msec",
    "sub_push_delay_msec",
    "triggered",
    "type",
    "tags",
]


def opened(messages: DataFrame, payload: str = "value") -> DataFrame:
    """Messages with their members taken apart and the command ``kind``."""
    name = V.root_text("command")
    return V.open_object(messages, payload, KEYS, kind=F.when(name.isin(KINDS), name).otherwise("unknown"))


def required_present() -> Column:
    """All keys the kind needs are there with the exact JSON kind."""
    kind, out = F.col("kind"), F.lit(False)
    for name, keys in REQUIRED.items():
        out = F.when(kind == name, V.has(keys)).otherwise(out)
    return out


def serialization() -> Column:
    return F.when(F.lower(V.text("serialization")) == "json", "json").otherwise("msgpack")


def snapshot_type(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low == "normal", "Normal").when(low == "timedbuffered", "TimedBuffered").otherwise("Unknown")
    )


def destination() -> Column:
    return V.text("monitor_dest_topic", V.text("reply_topic"))


def message_status() -> Column:
    kind = F.col("kind")
    good = (
        required_present()
        & (~kind.isin(NEEDS_PVS) | (F.size(V.strings("pv_name_list")) > 0))
        & ((kind != "monitor") | (destination() != ""))
    )
    return (
        F.when(~V.is_object(), "corrupt")
        .when(V.present("command") & ~V.is_kind("command", "string"), "fault")
        .when(good, "valid")
        .otherwise("invalid")
    )


def decode(messages: DataFrame, payload: str = "value") -> DataFrame:
    """Add the typed command fields and ``status`` to every message.

    status: ``valid``; ``invalid`` (an object that is no command: dead letter);
    ``fault`` (the command name is not text); ``corrupt`` (no JSON object).
    """
    return V.evaluated(opened(messages, payload), status=message_status()).select(
        *messages.columns,
        "kind",
        "status",
        serialization().alias("serialization"),
        V.text("reply_topic").alias("reply_topic"),
        V.text("reply_id").alias("reply_id"),
        V.text("pv_name").alias("pv_name"),
        V.text("value").alias("put_value"),
        destination().alias("monitor_dest_topic"),
        V.strings("pv_name_list").alias("pv_name_list"),
        V.strings("pv_field_filter_list").alias("pv_field_filter_list"),
        V.text("snapshot_name").alias("snapshot_name"),
        V.integer("repeat_delay_msec", 0).alias("repeat_delay_msec"),
        V.integer("time_window_msec", DEFAULT_WINDOW_MSEC).alias("time_window_msec"),
        V.integer("sub_push_delay_msec", 0).alias("sub_push_delay_msec"),
        V.boolean("triggered", False).alias("triggered"),
        snapshot_type(V.text("type", "normal")).alias("snapshot_type"),
        V.string_map("tags").alias("tags"),
    )


def dead_letters(decoded: DataFrame) -> DataFrame:
    """Replies for commands that could not be built; silent when nobody can be told."""
    return decoded.where("status = 'invalid' AND reply_id != '' AND reply_topic != ''").select(
        "cmd_seq",
        "reply_topic",
        F.lit(PARSE_ERROR_KEY).alias("reply_key"),
        F.lit(-1).alias("error"),
        "reply_id",
        "serialization",
    )


def dispatch(decoded: DataFrame) -> DataFrame:
    """The worker of each valid command; null where no worker is registered."""
    table = F.create_map(*[F.lit(x) for pair in HANDLERS.items() for x in pair])
    return decoded.where("status = 'valid'").withColumn("worker", F.try_element_at(table, F.col("kind")))


def monitor_requests(decoded: DataFrame) -> DataFrame:
    """One row per subscription a monitor or multi-monitor command asks for, by the plain PV name.

    A multi-monitor writes each PV to a topic of its own name. What is no PV URI subscribes to nothing.
    """
    single = decoded.where("status = 'valid' AND kind = 'monitor'").select(
        "cmd_seq", "ts_us", F.col("pv_name").alias("uri"), F.col("monitor_dest_topic").alias("channel_destination"), "serialization"
    )
    several = decoded.where("status = 'valid' AND kind = 'multi-monitor'").select(
        "cmd_seq", "ts_us", F.explode("pv_name_list").alias("uri"), "serialization"
    )
    asked = single.unionByName(several, allowMissingColumns=True).where(is_pv_uri(F.col("uri")))
    name = pv_parts(F.col("uri"))["name"]
    return asked.select(
        "cmd_seq", "ts_us", name.alias("pv_name"), F.coalesce("channel_destination", pv_topic(name)).alias("channel_destination"), "serialization"
    )


def answered(commands: DataFrame, *also: str) -> DataFrame:
    """The commands with a reply topic, and with the other named keys: nobody waits for a reply to the rest."""
    for key in ("reply_topic", *also):
        commands = commands.where(F.coalesce(F.col(key), F.lit("")) != "")
    return commands


def monitor_replies(decoded: DataFrame, serializers: list[str]) -> DataFrame:
    """Answer of the monitor worker: no serializer -3, empty destination -1, else 0; only to who asked for one."""
    monitors = answered(decoded.where("status = 'valid' AND kind IN ('monitor', 'multi-monitor')"), "reply_id")
    missing = ~F.col("serialization").isin(serializers)
    no_topic = (F.col("kind") == "monitor") & (F.col("monitor_dest_topic") == "")
    return monitors.select(
        "cmd_seq",
        "reply_topic",
        "reply_id",
        F.when(missing, -3).when(no_topic, -1).otherwise(0).alias("error"),
        F.when(missing, MONITOR_NO_SERIALIZER)
        .when(no_topic, MONITOR_NO_TOPIC)
        .when(F.col("kind") == "monitor", F.concat(F.lit(MONITOR_OK), F.col("pv_name")))
        .otherwise(MONITORS_OK)
        .alias("message"),
    )


def validate_snapshot(decoded: DataFrame) -> DataFrame:
    """(error, message) of every repeating-snapshot definition, first failing check wins."""
    name = F.col("snapshot_name")
    bad_uri = F.try_element_at(F.filter("pv_name_list", lambda u: ~is_pv_uri(u)), F.lit(1))
    checks = [
        (F.col("snapshot_type") == "Unknown", -1, F.col("snapshot_type")),
        (F.size("pv_name_list") == 0, -2, name),
        (F.col("repeat_delay_msec") < 0, -3, name),
        (F.col("time_window_msec") < 0, -4, name),
        (name == "", -5, name),
        (bad_uri.isNotNull(), -6, bad_uri),
    ]

    def words(code: int, subject: Column) -> Column:
        head, tail = SNAPSHOT_TEXTS[code]
        return F.concat(F.lit(head), subject, F.lit(tail))

    error, message = F.lit(0), words(0, name)
    for failed, code, subject in reversed(checks):
        error = F.when(failed, code).otherwise(error)
        message = F.when(failed, words(code, subject)).otherwise(message)
    return decoded.withColumn("error", error).withColumn("message", message)


def snapshot_commands(decoded: DataFrame, *keep: str) -> DataFrame:
    """Start, stop and trigger commands in the shape ``snapshots.lifecycle`` takes, with the columns named in ``keep``."""
    verbs = F.create_map(
        *[F.lit(x) for x in (
            "repeating_snapshot", "start", "repeating_snapshot_stop", "stop", "repeating_snapshot_trigger", "trigger",
        )]
    )
    wanted = decoded.where("status = 'valid'").withColumn("_verb", F.try_element_at(verbs, F.col("kind")))
    checked = validate_snapshot(wanted.where("_verb IS NOT NULL"))
    return checked.select(
        snapshot_topic(F.col("snapshot_name")).alias("queue_name"),
        "snapshot_name",
        "ts_us",
        F.col("cmd_seq").alias("seq"),
        F.col("_verb").alias("kind"),
        F.when(F.col("_verb") == "start", F.col("error")).otherwise(0).alias("start_error"),
        F.when(F.col("_verb") == "start", F.col("message")).alias("start_message"),
        *keep,
    )


def base64_bytes(text: Column) -> Column:
    """Decoded bytes, padding optional; null for an empty text or a foreign character."""
    core = F.regexp_extract(text, "^([A-Za-z0-9+/]*)", 1)
    size = F.length(core)
    whole = F.left(core, size - F.when(size % 4 == 1, 1).otherwise(0))
    padded = F.rpad(whole, F.ceil(F.length(whole) / 4).cast("int") * 4, "=")
    decoded = F.try_to_binary(padded, F.lit("base64"))
    return F.when(text.rlike("^[A-Za-z0-9+/=]+$") & (F.length(decoded) > 0), decoded)


def put_errors(puts: DataFrame, value: str = "put_value", uri: str = "pv_name") -> DataFrame:
    """(error, message) of every put payload: base64 -1, MsgPack -2, not a map -3, PV name -4, else 0."""
    df = puts.withColumn("_bytes", base64_bytes(F.col(value)))
    df = df.withColumn("_shape", F.when(F.col("_bytes").isNotNull(), msgpack_kind(F.col("_bytes"))))
    checks = [
        (F.col("_bytes").isNull(), -1),
        (F.col("_shape") == "bad", -2),
        (F.col("_shape") != "map", -3),
        (~is_pv_uri(F.col(uri)), -4),
    ]
    error, message = F.lit(0), F.lit(PUT_TEXTS[0])
    for failed, code in reversed(checks):
        error = F.when(failed, code).otherwise(error)
        message = F.when(failed, PUT_TEXTS[code]).otherwise(message)
    return df.withColumn("error", error).withColumn("message", message).drop("_bytes", "_shape")


def put_replies(puts: DataFrame, states: DataFrame, *, width: int | None = None) -> DataFrame:
    """Outcome of each put with a reply topic and id: payload errors, then -2 if the PV last failed or was cancelled, -3 if unknown."""
    checked = put_errors(answered(puts, "reply_id")).withColumn("name", F.coalesce(pv_parts(F.col("pv_name")).getField("name"), F.lit("")))
    known = states.withColumnRenamed("pv_name", "name")
    joined = asof_join(checked, known, ["name"], left_seq="cmd_seq", keep_unmatched=True, width=width)
    ok = F.col("error") == 0
    state = F.col("matched.event_type")
    error = F.when(~ok, F.col("error")).when(state.isNull(), -3).when(state.isin("Fail", "Cancel"), -2).otherwise(0)
    message = (
        F.when(~ok, F.col("message"))
        .when(state.isNull(), TIMED_OUT)
        .when(state == "Fail", "Put operation has failed")
        .when(state == "Cancel", PUT_CANCELLED)
        .otherwise(F.col("message"))
    )
    return joined.withColumn("error", error).withColumn("message", message).drop("matched", "name")


def get_replies(gets: DataFrame, states: DataFrame, *, width: int | None = None) -> DataFrame:
    """Answer of each get that has a reply topic, with the PV's state as of the command.

    Malformed PV -1, last event failed or cancelled -2, no value within the
    time-out -3 (none known at command time plus time-out), else 0 with the value.
    """
    asked = answered(gets).withColumn("name", F.coalesce(pv_parts(F.col("pv_name")).getField("name"), F.lit("")))
    asked = asked.withColumn("_until", F.col("ts_us") + GET_TIMEOUT_US)
    known = states.withColumnRenamed("pv_name", "name")
    joined = asof_join(
        asked, known, ["name"], left_at="_until", left_seq="cmd_seq", keep_unmatched=True, width=width
    )
    state = F.col("matched.event_type")
    bad = ~is_pv_uri(F.col("pv_name"))
    error = (
        F.when(bad, -1)
        .when(state.isNull(), -3)
        .when(state.isin("Fail", "Cancel"), -2)
        .otherwise(0)
    )
    message = (
        F.when(bad, PV_MALFORMED)
        .when(state.isNull(), TIMED_OUT)
        .when(state == "Fail", "Operation failed")
        .when(state == "Cancel", GET_CANCELLED)
    )
    return (
        joined.withColumn("error", error)
        .withColumn("message", message)
        .withColumn("value", F.when(F.col("error") == 0, F.col("matched.value")))
        .withColumn("seq", F.when(F.col("error") == 0, F.col("matched.seq")))
        .drop("matched", "name", "_until")
    )
