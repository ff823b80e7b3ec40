"""Bulk encoding of PV events, replies and frames to JSON and MsgPack, and back."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pvflow.functions import decoding
from pvflow.functions import packing as P

SER_JSON, SER_MSGPACK, SER_COMPACT = 1, 2, 3  # fixed values: serialization codes


def encode_json(pv_name: Column, data: Column, reply_id: Column | None = None) -> Column:
    """``{"<pv>": {...}}``, NaN as text; with ``reply_id`` that key comes first."""
    body = F.to_json(F.create_map(pv_name, data))
    if reply_id is None:
        return body
    head = F.to_json(F.struct(reply_id.alias("reply_id")))
    return F.concat(F.regexp_replace(head, r"\}$", ","), F.substring(body, 2, 2**31 - 1))


def reply_json(*extra: str) -> Column:
    """``{error, reply_id}`` plus the extra columns that are neither null nor empty."""
    more = [F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in extra]
    return F.to_json(F.struct("error", "reply_id", *more))


def frame_json(value: Column) -> Column:
    """Frame payloads by ``message_type``: header, data (PV name -> value), tail."""
    header = F.to_json(F.struct("message_type", "iter_index", "snapshot_name", "timestamp"))
    tail = F.to_json(
        F.struct("message_type", "error", "error_message", "iter_index", "timestamp", "snapshot_name")
    )
    head = F.to_json(F.struct("message_type", "iter_index", "timestamp"))
    body = F.to_json(F.create_map(F.col("pv_name"), value))
    data = F.concat(F.regexp_replace(head, r"\}$", ","), F.substring(body, 2, 2**31 - 1))
    kind = F.col("message_type")
    return F.when(kind == 0, header).when(kind == 1, data).otherwise(tail)


def encode_union(value: Column, kind: T.DataType) -> Column:
    """A value ready for JSON: unions give way to the selected value, as text, and union arrays are left out."""
    if P.is_union(kind):
        out = F.lit(None).cast("string")
        for field in P.alternatives(kind):
            inner = encode_union(value[field.name], field.dataType)
            plain = isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType))
            out = F.when(value[P.TAG] == field.name, F.to_json(inner) if plain else inner.cast("string")).otherwise(out)
        return out
    if isinstance(kind, T.StructType):
        kept = [f for f in kind.fields if not (isinstance(f.dataType, T.ArrayType) and P.is_union(f.dataType.elementType))]
        return F.when(value.isNotNull(), F.struct(*[encode_union(value[f.name], f.dataType).alias(f.name) for f in kept]))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: encode_union(x, kind.elementType))
    return value


def msgpack_message(
    pv_name: Column, data: Column, kind: T.DataType, *, compact: bool = False, reply_id: Column | None = None, wanted: Column | None = None
) -> Column:
    """MsgPack bytes of one PV value, in the full form with only the top-level fields ``wanted`` if that is given.

    Full form: a map ``{[reply_id], pv: {...}}``. Compact form: an array ``[[reply_id], pv, leaf...]`` with the leaves
    in depth-first order. An empty or null reply id is left out.
    """
    told = F.coalesce(reply_id != "", F.lit(False)) if reply_id is not None else None
    if compact:
        leaves = F.concat(F.array(P.text_hex(pv_name)), P.leaves_hex(data, kind))
        if told is not None:
            leaves = F.concat(F.when(told, F.array(P.text_hex(reply_id))).otherwise(F.array().cast("array<string>")), leaves)
        return F.unhex(P.let(leaves, lambda x: F.concat(P.array_head(F.size(x)), F.array_join(x, ""))))
    head = F.lit("81")
    if told is not None:
        head = F.when(told, F.concat(F.lit("82" + P.literal_hex("reply_id")), P.text_hex(reply_id))).otherwise(head)
    body = P.value_hex(data, kind) if wanted is None else P.filtered_hex(data, kind, wanted)
    return F.unhex(F.concat(head, P.text_hex(pv_name), body))


def encode_msgpack(df: DataFrame, data: str = "data", *, compact: bool = False, reply_id: str | None = None) -> DataFrame:
    """Replace ``data`` by MsgPack bytes ``value``; see ``msgpack_message``."""
    reply = F.col(reply_id) if reply_id else None
    value = msgpack_message(F.col("pv_name"), F.col(data), df.schema[data].dataType, compact=compact, reply_id=reply)
    return df.select(*[c for c in df.columns if c not in (data, "value")], value.alias("value"))


def reply_msgpack(*extra: str) -> Column:
    """``{error, reply_id}`` plus the extra text columns that are neither null nor empty, as a MsgPack map."""
    pairs = [("error", P.whole_hex(F.col("error"))), ("reply_id", P.text_hex(F.col("reply_id")))]
    return P.map_bytes([*pairs, *[(c, P.text_hex(F.col(c))) for c in extra]], optional=extra)


def frame_msgpack(value: Column, kind: T.DataType) -> Column:
    """Frame payloads by ``message_type`` as MsgPack maps: header, data (PV name -> value), tail."""
    plain = {c: P.whole_hex(F.col(c)) for c in ("message_type", "iter_index", "timestamp")}
    name = P.text_hex(F.col("snapshot_name"))
    pairs = lambda *keys: [(k, plain[k]) for k in keys]
    header = P.map_bytes([*pairs("message_type"), ("snapshot_name", name), *pairs("timestamp", "iter_index")])
    data = P.map_bytes(pairs("message_type", "timestamp", "iter_index"), tail=[(F.col("pv_name"), P.value_hex(value, kind))])
    error = [("error", P.whole_hex(F.col("error"))), ("error_message", P.text_hex(F.col("error_message")))]
    tail = P.map_bytes([*pairs("message_type"), *error, *pairs("iter_index", "timestamp"), ("snapshot_name", name)], optional=["error_message"])
    message = F.col("message_type")
    return F.when(message == 0, header).when(message == 1, data).otherwise(tail)


def frame_payload(value: Column, kind: T.DataType) -> Column:
    """The bytes of a frame in the run's ``serialization``."""
    as_json = frame_json(encode_union(value, kind)).cast("binary")
    return F.when(F.col("serialization") == "json", as_json).otherwise(frame_msgpack(value, kind))


def decode_msgpack(df: DataFrame, kind: str | T.StructType, value: str = "value") -> DataFrame:
    """MsgPack maps ``{pv: {...}}`` -> pv_name, ``data`` of the given schema, and ``error``.

    Keys the schema does not have are dropped, missing fields are null. Bytes that are no such map, or hold
    a value that does not fit its field, give null and say why in ``error``. Columns with these names are replaced.
    """
    wanted = T.StructType.fromDDL(kind) if isinstance(kind, str) else kind
    keep = [f for f in df.schema.fields if f.name not in (value, "pv_name", "data", "error")]
    made = [T.StructField("pv_name", T.StringType()), T.StructField("data", wanted), T.StructField("error", T.StringType())]
    schema = T.StructType([*keep, *made])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = decoding.columns(batch.column(value).to_pylist(), wanted)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], *found], names=schema.names)

    return df.mapInArrow(rows, schema)


def encoders(kind: T.DataType, data: str = "data") -> dict[int, Column]:
    """The payload of an event by serialization code, as bytes."""
    name, value = F.col("pv_name"), F.col(data)
    return {
        SER_JSON: encode_json(name, encode_union(value, kind)).cast("binary"),
        SER_MSGPACK: msgpack_message(name, value, kind),
        SER_COMPACT: msgpack_message(name, value, kind, compact=True),
    }
