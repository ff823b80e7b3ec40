"""MsgPack into Arrow columns, driven by the schema: each value goes straight into the column of its field.

Keys that the schema lacks are skipped without being built; fields that a map lacks are null. A value that does not fit
the type of its field is an error of its row, and the row's data is null.
"""

from __future__ import annotations

import struct
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import types as T

from pvflow.functions.msgpack import unpack_from
from pvflow.functions.packing import _STEPS, TAG, is_union

_MAPS, _ARRAYS, _NIL = {*range(0x80, 0x90), 0xDE, 0xDF}, {*range(0x90, 0xA0), 0xDC, 0xDD}, 0xC0
_REST, _WIDTH, _UNIT, _ITEMS, _KIDS = (_STEPS[k] for k in ("rest", "width", "unit", "items", "kids"))
BROKEN = (ValueError, IndexError, struct.error, TypeError, RecursionError)


class Misfit(ValueError):
    """A value that is not of the type of its field."""


def _object(buf: bytes, pos: int) -> tuple[int, int]:
    """Where the content after the head of an object starts or, for a plain one, where it ends; and how many items follow."""
    if pos >= len(buf):
        raise ValueError("cut short")
    first = buf[pos]
    if first == 0xC1:
        raise ValueError("unknown code")
    width = _WIDTH[first]
    size = int.from_bytes(buf[pos + 1 : pos + 1 + width], "big")
    end = pos + 1 + width + _REST[first] + _UNIT[first] * size
    items = _KIDS[first] + _ITEMS[first] * size
    if end + items > len(buf):
        raise ValueError("cut short")
    return end, items


def skip(buf: bytes, pos: int) -> int:
    """The position after the object at ``pos``; no value is built and no depth is too deep."""
    left = 1
    while left:
        pos, items = _object(buf, pos)
        left += items - 1
    return pos


def map_items(buf: bytes, pos: int) -> tuple[dict[str, int], int]:
    """Where the value of each text key of a map stands (the last one of equal keys), and the position after the map."""
    at, items = _object(buf, pos)
    found = {}
    for _ in range(items // 2):
        key, after = (None, skip(buf, at)) if buf[at] in _MAPS or buf[at] in _ARRAYS else unpack_from(buf, at)
        if isinstance(key, str):
            found[key] = after
        at = skip(buf, after)
    return found, at


_RANGES = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
_ARROW = {
    T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.FloatType: pa.float32(),
    T.DoubleType: pa.float64(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary(),
}


def _fitting(kind: T.DataType):
    """Checks a plain value, and gives what the column takes."""
    if type(kind) in _RANGES:
        limit = 1 << _RANGES[type(kind)]

        def fit(x):
            if type(x) is not int or not -limit <= x < limit:
                raise Misfit(f"no {kind.simpleString()}")
            return x

    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):

        def fit(x):
            if type(x) not in (int, float):
                raise Misfit(f"no {kind.simpleString()}")
            return float(x)

    elif isinstance(kind, T.DecimalType):

        def fit(x):
            if type(x) is not int or abs(x) >= 10 ** (kind.precision - kind.scale):
                raise Misfit(f"no {kind.simpleString()}")
            return Decimal(x)

    elif isinstance(kind, T.BooleanType):

        def fit(x):
            if type(x) is not bool:
                raise Misfit("no boolean")
            return x

    elif isinstance(kind, T.StringType):

        def fit(x):
            if type(x) not in (str, bytes):
                raise Misfit("no string")
            return x if type(x) is str else x.decode()

    elif isinstance(kind, T.BinaryType):

        def fit(x):
            if type(x) not in (str, bytes):
                raise Misfit("no binary")
            return x if type(x) is bytes else x.encode()

    else:
        raise TypeError(f"{kind.simpleString()} has no MsgPack form")
    return fit


class _Plain:
    def __init__(self, kind: T.DataType):
        self.fit, self.values = _fitting(kind), []
        self.type = pa.decimal128(kind.precision, kind.scale) if isinstance(kind, T.DecimalType) else _ARROW[type(kind)]

    def add(self, buf: bytes, pos: int) -> int:
        if buf[pos] in _MAPS or buf[pos] in _ARRAYS:
            raise Misfit("a map or list where a plain value belongs")
        value, pos = unpack_from(buf, pos)
        self.values.append(None if value is None else self.fit(value))
        return pos

    def missing(self) -> None:
        self.values.append(None)

    def cut(self, n: int) -> None:
        del self.values[n:]

    def finish(self) -> pa.Array:
        return pa.array(self.values, self.type)


class _Struct:
    def __init__(self, kind: T.StructType):
        self.valid, self.fields = [], {f.name: builder(f.dataType) for f in kind.fields}

    def add(self, buf: bytes, pos: int) -> int:
        if buf[pos] == _NIL:
            self.missing()
            return pos + 1
        items, end = map_items(buf, pos) if buf[pos] in _MAPS else ({}, skip(buf, pos))
        for name, field in self.fields.items():
            if name in items:
                field.add(buf, items[name])
            else:
                field.missing()
        self.valid.append(True)
        return end

    def missing(self) -> None:
        for field in self.fields.values():
            field.missing()
        self.valid.append(False)

    def cut(self, n: int) -> None:
        del self.valid[n:]
        for field in self.fields.values():
            field.cut(n)

    def finish(self) -> pa.Array:
        arrays = [f.finish() for f in self.fields.values()]
        mask = pa.array([not v for v in self.valid], pa.bool_())
        return pa.StructArray.from_arrays(arrays, names=list(self.fields), mask=mask)


class _Union(_Struct):
    """A map with one entry, whose key names the alternative; anything else selects none and is null."""

    def add(self, buf: bytes, pos: int) -> int:
        if not self.takes(buf, pos):
            self.missing()
            return skip(buf, pos)
        items, end = map_items(buf, pos)
        ((chosen, at),) = items.items()
        for name, field in self.fields.items():
            if name == chosen:
                field.add(buf, at)
            elif name == TAG:
                field.values.append(chosen or None)
            else:
                field.missing()
        self.valid.append(True)
        return end

    def takes(self, buf: bytes, pos: int) -> bool:
        """Also an empty name, that of a union in which nothing is selected yet."""
        if buf[pos] not in _MAPS or _object(buf, pos)[1] != 2:
            return False
        items, _ = map_items(buf, pos)
        return len(items) == 1 and next(iter(items)) in (set(self.fields) - {TAG} | {""})


class _List:
    def __init__(self, kind: T.ArrayType):
        self.valid, self.ends, self.items = [], [0], builder(kind.elementType)

    def add(self, buf: bytes, pos: int) -> int:
        if buf[pos] == _NIL:
            self.missing()
            return pos + 1
        if buf[pos] not in _ARRAYS:  # no list counts as an empty one
            self._close(0)
            return skip(buf, pos)
        pos, n = _object(buf, pos)
        kept = 0
        for _ in range(n):
            if isinstance(self.items, _Union) and not self.items.takes(buf, pos):
                pos = skip(buf, pos)  # not an entry of a list of unions
                continue
            pos, kept = self.items.add(buf, pos), kept + 1
        self._close(kept)
        return pos

    def _close(self, n: int) -> None:
        self.valid.append(True)
        self.ends.append(self.ends[-1] + n)

    def missing(self) -> None:
        self.valid.append(False)
        self.ends.append(self.ends[-1])

    def cut(self, n: int) -> None:
        del self.valid[n:], self.ends[n + 1 :]
        self.items.cut(self.ends[-1])

    def finish(self) -> pa.Array:
        mask = pa.array([not v for v in self.valid], pa.bool_())
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), self.items.finish(), mask=mask)


def builder(kind: T.DataType):
    if is_union(kind):
        return _Union(kind)
    if isinstance(kind, T.StructType):
        return _Struct(kind)
    if isinstance(kind, T.ArrayType):
        return _List(kind)
    return _Plain(kind)


def columns(payloads: list[bytes | None], kind: T.StructType) -> tuple[pa.Array, pa.Array, pa.Array]:
    """PV names, data and errors (null where there is none) of messages ``{[reply_id], pv: {...}}``."""
    names, errors, data = [], [], _Struct(kind)
    for i, raw in enumerate(payloads):
        try:
            buf = bytes(raw or b"")
            if not buf or buf[0] not in _MAPS:
                raise Misfit("no map")
            items, _ = map_items(buf, 0)
            items.pop("reply_id", None)
            if not items:
                raise Misfit("no PV")
            name, at = next(iter(items.items()))
            data.add(buf, at)
            names.append(name)
            errors.append(None)
        except BROKEN as e:
            data.cut(i)
            data.missing()
            names.append(None)
            errors.append(str(e) or type(e).__name__)
    return pa.array(names, pa.string()), data.finish(), pa.array(errors, pa.string())
