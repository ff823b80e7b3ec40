"""MsgPack as column expressions: a byte builder made from the schema, and a scan of the structure.

Everything runs in the JVM. A value is first built as hexadecimal text, whose pieces are joined and turned into bytes
once, at the end.

A union is a struct whose first field is ``_tag``, the name of the selected alternative, followed by one field per
alternative (``union_type``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "_tag"
NIL = "C0"


def union_type(**alternatives: T.DataType | str) -> T.StructType:
    """The type of a union of the named alternatives."""
    fields = [T.StructField(TAG, T.StringType())]
    for name, kind in alternatives.items():
        fields.append(T.StructField(name, T.DataType.fromDDL(kind) if isinstance(kind, str) else kind))
    return T.StructType(fields)


def is_union(kind: T.DataType) -> bool:
    return isinstance(kind, T.StructType) and kind.names[:1] == [TAG]


def alternatives(kind: T.StructType) -> list[T.StructField]:
    return kind.fields[1:]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` names it.

    A lambda variable is bound per element, so the optimizer cannot copy the expression into each place of use.
    """
    return F.transform(F.array(value), body)[0]


def _table(values: Sequence[object], kind: str) -> Column:
    """A constant list, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _digits(value: Column, count: Column | int) -> Column:
    """The last ``count`` hexadecimal digits of a whole number."""
    return F.right(F.lpad(F.hex(value), 16, "0"), F.lit(count) if isinstance(count, int) else count)


def _head(size: Column, small: int, limit: int, codes: Sequence[tuple[int, str]]) -> Column:
    """The first bytes of something that has a size: in the first byte below ``limit``, else in some bytes after a code."""
    *steps, (last, code) = codes
    out = F.concat(F.lit(code), _digits(size, 2 * last))
    for count, code in reversed(steps):
        out = F.when(size < 1 << (8 * count), F.concat(F.lit(code), _digits(size, 2 * count))).otherwise(out)
    return F.when(size < limit, _digits(size + small, 2)).otherwise(out) if limit else out


def text_head(size: Column) -> Column:
    return _head(size, 0xA0, 32, [(1, "D9"), (2, "DA"), (4, "DB")])


def blob_head(size: Column) -> Column:
    return _head(size, 0, 0, [(1, "C4"), (2, "C5"), (4, "C6")])


def array_head(size: Column) -> Column:
    return _head(size, 0x90, 16, [(2, "DC"), (4, "DD")])


def map_head(size: Column) -> Column:
    return _head(size, 0x80, 16, [(2, "DE"), (4, "DF")])


#: Code and digits of a whole number by its step: itself a byte, unsigned of 1, 2, 4, 8 bytes, then signed ones.
_CODES = ["", "CC", "CD", "CE", "CF", "D0", "D1", "D2", "D3"]
_LENGTHS = [2, 2, 4, 8, 16, 2, 4, 8, 16]
#: The step out of the number of hexadecimal digits (from 0): 1-2, 3-4, 5-8, 9-16.
_STEP_OF = [0, 1, 1, 2, 2, *[3] * 4, *[4] * 8]


def whole_hex(value: Column) -> Column:
    """A whole number in the shortest form. A negative one needs a bit more than what -1 - v takes."""
    v = value.cast("bigint")
    need = F.length(F.hex(F.when(v < 0, -(v + 1) * 2 + 1).otherwise(v)))
    far = F.when(v < -(2**62), F.lit(8)).otherwise(F.element_at(_table(_STEP_OF, "int"), (need + 1).cast("int")) + F.when(v < 0, 4).otherwise(0))
    step = F.when(v.between(-32, 127), F.lit(0)).otherwise(far) + 1
    code = F.element_at(F.split(F.lit(",".join(_CODES)), ","), step)
    return F.concat(code, _digits(v, F.element_at(_table(_LENGTHS, "int"), step)))


def unsigned_hex(value: Column) -> Column:
    """A decimal without fraction, up to 2^64 - 1."""
    wide, half, full = value.cast("decimal(38,0)"), F.lit(str(2**63)).cast("decimal(38,0)"), F.lit(str(2**64)).cast("decimal(38,0)")
    wrapped = F.when(wide >= half, wide - full).otherwise(wide).cast("bigint")
    return F.when(wide >= half, F.concat(F.lit("CF"), _digits(wrapped, 16))).otherwise(whole_hex(wrapped))


def _bits(value: Column, kind: str, method: str) -> Column:
    return F.reflect(F.lit(f"java.lang.{kind}"), F.lit(method), F.coalesce(value, F.lit(0).cast(kind.lower()))).cast("bigint")


def double_hex(value: Column) -> Column:
    return F.concat(F.lit("CB"), _digits(_bits(value, "Double", "doubleToLongBits"), 16))


def float_hex(value: Column) -> Column:
    return F.concat(F.lit("CA"), _digits(_bits(value, "Float", "floatToIntBits"), 8))


def text_hex(value: Column) -> Column:
    return F.coalesce(F.concat(text_head(F.octet_length(value)), F.hex(value.cast("binary"))), F.lit(NIL))


def literal_hex(text: str) -> str:
    """The form of a fixed text of less than 256 bytes."""
    raw = text.encode()
    return (f"{0xA0 + len(raw):02X}" if len(raw) < 32 else f"D9{len(raw):02X}") + raw.hex().upper()


def _map_literal(size: int) -> str:
    return f"{0x80 + size:02X}" if size < 16 else f"DE{size:04X}"


_WHOLE, _DOUBLE, _FLOAT, _TEXT = "bigint", "double", "float", "string"
_FORMS = {_WHOLE: whole_hex, _DOUBLE: double_hex, _FLOAT: float_hex, _TEXT: text_hex}


def _nullable(form: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.when(x.isNull(), NIL).otherwise(form(x))


def _plain_key(kind: T.DataType) -> str | None:
    if isinstance(kind, T.IntegralType):
        return _WHOLE
    return {T.DoubleType: _DOUBLE, T.FloatType: _FLOAT, T.StringType: _TEXT}.get(type(kind))


class _Cells:
    """The plain values met on a walk through a type, by kind; all of a kind are turned into text by one expression."""

    def __init__(self):
        self.values: dict[str, list[Column]] = {}

    def place(self, value: Column, key: str) -> Callable[[Column], Column]:
        held = self.values.setdefault(key, [])
        held.append(value.cast(key))
        at = len(held) - 1
        return lambda cells: F.get(cells[key], F.lit(at))

    def bound(self, body: Callable[[Column], Column]) -> Column:
        """``body`` over the finished cells, each computed once."""
        if not self.values:
            return body(None)
        forms = [F.transform(F.array(*held), _nullable(_FORMS[key])).alias(key) for key, held in self.values.items()]
        return let(F.struct(*forms), body)


Part = Callable[[Column], Column]


def _literal(text: str) -> Part:
    return lambda cells: F.lit(text)


def _walk(value: Column, kind: T.DataType, cells: _Cells) -> Part:
    """How the form of a value comes out of the finished cells."""
    if (key := _plain_key(kind)) is not None:
        return cells.place(value, key)
    if is_union(kind):
        options = [(f.name, _walk(value[f.name], f.dataType, cells)) for f in alternatives(kind)]

        def chosen(done: Column) -> Column:
            out = F.lit(literal_hex("") + NIL)
            for name, part in reversed(options):
                out = F.when(value[TAG] == name, F.concat(F.lit(literal_hex(name)), part(done))).otherwise(out)
            return F.when(value.isNull(), NIL).otherwise(F.concat(F.lit(_map_literal(1)), out))

        return chosen
    if isinstance(kind, T.StructType):
        parts: list[Part] = [_literal(_map_literal(len(kind.fields)))]
        for f in kind.fields:
            parts += [_literal(literal_hex(f.name)), _walk(value[f.name], f.dataType, cells)]
        return lambda done: F.when(value.isNull(), NIL).otherwise(F.concat(*[p(done) for p in parts]))
    return lambda done: _other_hex(value, kind)


def _other_hex(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: value_hex(x, kind.elementType))
        out = F.concat(array_head(F.size(value)), F.array_join(items, ""))
    elif isinstance(kind, T.MapType):
        pairs = lambda e: F.concat(value_hex(e["key"], kind.keyType), value_hex(e["value"], kind.valueType))
        out = F.concat(map_head(F.size(value)), F.array_join(F.transform(F.map_entries(value), pairs), ""))
    elif isinstance(kind, T.BooleanType):
        out = F.when(value, "C3").otherwise("C2")
    elif isinstance(kind, T.DecimalType) and kind.scale == 0:
        out = unsigned_hex(value)
    elif isinstance(kind, T.BinaryType):
        out = F.concat(blob_head(F.octet_length(value)), F.hex(value))
    elif isinstance(kind, T.NullType):
        return F.lit(NIL)
    else:
        raise TypeError(f"{kind.simpleString()} has no MsgPack form")
    return F.when(value.isNull(), NIL).otherwise(out)


def value_hex(value: Column, kind: T.DataType) -> Column:
    """The MsgPack form of a value of the given type; null is nil."""
    if (key := _plain_key(kind)) is not None:
        return F.when(value.isNull(), NIL).otherwise(_FORMS[key](value))
    cells = _Cells()
    part = _walk(value, kind, cells)
    return cells.bound(part)


def filtered_hex(value: Column, kind: T.StructType, wanted: Column) -> Column:
    """The form of a struct with only the fields named in the array ``wanted``, which are left out, not nil; none named keeps all."""
    cells = _Cells()
    parts = [(f.name, _walk(value[f.name], f.dataType, cells)) for f in kind.fields]

    def body(done: Column) -> Column:
        def kept(names: Column) -> Column:
            fields = [F.when((F.size(names) == 0) | F.array_contains(names, n), F.concat(F.lit(literal_hex(n)), p(done))) for n, p in parts]
            present = F.filter(F.array(*fields), lambda x: x.isNotNull())
            return let(present, lambda x: F.concat(map_head(F.size(x)), F.array_join(x, "")))

        return F.when(value.isNull(), NIL).otherwise(kept(wanted))

    return cells.bound(body)


def _leaves(value: Column, kind: T.DataType, cells: _Cells) -> list[Part]:
    """Per leaf, or list of leaves, an array of forms."""
    if is_union(kind) or (isinstance(kind, T.ArrayType) and is_union(kind.elementType)):
        return []
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _leaves(value[f.name], f.dataType, cells)]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        none = F.array().cast("array<string>")
        return [lambda done: F.coalesce(F.flatten(F.transform(value, lambda x: leaves_hex(x, kind.elementType))), none)]
    part = _walk(value, kind, cells)
    return [lambda done: F.array(part(done))]


def leaves_hex(value: Column, kind: T.DataType) -> Column:
    """The forms of all leaves, depth first through structs and struct arrays; unions are left out."""
    cells = _Cells()
    parts = _leaves(value, kind, cells)
    if not parts:
        return F.array().cast("array<string>")
    return cells.bound(lambda done: F.concat(*[p(done) for p in parts]))


def pack(value: Column, kind: T.DataType) -> Column:
    """MsgPack bytes of a column of the given type."""
    return F.unhex(value_hex(value, kind))


def map_bytes(entries: Sequence[tuple[str, Column]], *, tail: Sequence[tuple[Column, Column]] = (), optional: Sequence[str] = ()) -> Column:
    """A map out of (key, hexadecimal value) pairs, then of pairs whose key is a column.

    A pair named in ``optional`` is left out where its value is nil or the empty text.
    """
    fixed, parts = len(entries) + len(tail), []
    if not optional:
        parts.append(F.lit(_map_literal(fixed)))
    for key, value in entries:
        pair = F.concat(F.lit(literal_hex(key)), value)
        parts.append(F.when(value.isin(NIL, "A0"), "").otherwise(pair) if key in optional else pair)
    parts += [F.concat(text_hex(key), value) for key, value in tail]
    if not optional:
        return F.unhex(F.concat(*parts))
    return F.unhex(let(F.array(*parts), lambda p: F.concat(map_head(F.size(F.filter(p, lambda x: x != ""))), F.array_join(p, ""))))


def _steps() -> dict[str, list[int]]:
    """For each first byte: bytes of a fixed rest, bytes of a length field, bytes and items per unit of that length, fixed items.

    The rule behind the table: the formats of the MsgPack specification, by ranges of the first byte.
    """
    rest, width, unit, items, kids = ([0] * 256 for _ in range(5))
    for n in range(16):
        kids[0x80 + n], kids[0x90 + n] = 2 * n, n
    for n in range(32):
        rest[0xA0 + n] = n
    for i, size in enumerate((1, 2, 4)):
        for first in (0xC4, 0xD9):
            width[first + i], unit[first + i] = size, 1
        width[0xC7 + i], unit[0xC7 + i], rest[0xC7 + i] = size, 1, 1
    for i, size in enumerate((2, 4)):
        width[0xDC + i], items[0xDC + i] = size, 1
        width[0xDE + i], items[0xDE + i] = size, 2
    rest[0xCA], rest[0xCB] = 4, 8
    for i in range(4):
        rest[0xCC + i] = rest[0xD0 + i] = 1 << i
    for i in range(5):
        rest[0xD4 + i] = 1 + (1 << i)
    return {"rest": rest, "width": width, "unit": unit, "items": items, "kids": kids}


_STEPS = _steps()
_UNUSED = 0xC1  # fixed value: the one first byte without a format


def msgpack_kind(payload: Column) -> Column:
    """'map', 'other' or 'bad' for MsgPack bytes, null for null: one step per object, no value is built.

    The state is the position and how many objects are still to come; bytes after the first object do not count.
    """

    def number(raw: Column, at: Column, count: Column) -> Column:
        return F.conv(F.hex(F.substr(raw, (at + 1).cast("int"), count.cast("int"))), 16, 10).cast("bigint")

    def step(raw: Column, size: Column, tables: Column, state: Column) -> Column:
        def of(first: Column) -> Column:
            return F.struct(first.alias("first"), *[F.get(tables[k], first.cast("int")).alias(k) for k in _STEPS])

        def sized(f: Column) -> Column:
            length = F.when(f["width"] > 0, F.coalesce(number(raw, state["at"] + 1, f["width"]), F.lit(0))).otherwise(0)
            return let(length.cast("bigint"), lambda n: F.struct(
                (state["at"] + 1 + f["width"] + f["rest"] + f["unit"] * n).alias("at"),
                (state["open"] - 1 + f["kids"] + f["items"] * n).alias("open"),
                (f["first"] == _UNUSED).alias("bad"),
            ))

        def checked(s: Column) -> Column:
            # every object to come takes a byte at least
            bad = s["bad"] | (s["at"] > size) | (s["open"] > size - s["at"])
            return F.when(bad, broken).otherwise(F.struct(s["at"].alias("at"), s["open"].alias("open")))

        broken = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("open"))
        here = let(number(raw, state["at"], F.lit(1)), of)
        return F.when(state["at"] >= size, broken).otherwise(let(let(here, sized), checked))

    def scan(held: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("open"))
        move = lambda state, _: F.when(state["open"] == 0, state).otherwise(step(held["raw"], held["size"], held["tables"], state))
        end = F.aggregate(F.sequence(F.lit(1), F.greatest(held["size"], F.lit(1)).cast("int")), start, move)
        lead = number(held["raw"], F.lit(0), F.lit(1))
        is_map = lead.between(0x80, 0x8F) | lead.isin(0xDE, 0xDF)
        return F.when(end["at"] < 0, "bad").when(is_map, "map").otherwise("other")

    tables = F.struct(*[_table(v, "bigint").alias(k) for k, v in _STEPS.items()]).alias("tables")
    held = F.struct(payload.alias("raw"), F.octet_length(payload).cast("bigint").alias("size"), tables)
    return F.when(payload.isNotNull(), let(held, scan))
