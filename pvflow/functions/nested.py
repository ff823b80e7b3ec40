"""Nested values: field groups, filters, merges, partial updates, leaves.

All functions build column expressions from the schema, so Parquet still prunes
the fields nobody reads.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The fields of the two requests a ca channel is split into.
PRINCIPAL = ["value", "timeStamp", "alarm"]
ADDITIONAL = ["display", "control", "valueAlarm"]


def struct_type(df: DataFrame, path: str) -> T.StructType:
    kind = df.select(path).schema[0].dataType
    if not isinstance(kind, T.StructType):
        raise TypeError(f"{path} is no struct")
    return kind


def pick_fields(df: DataFrame, path: str, fields: Sequence[str]) -> Column:
    """A struct of the requested top-level fields that exist; null stays null."""
    have = [f for f in struct_type(df, path).names if f in set(fields)]
    data = F.col(path)
    return F.when(data.isNotNull(), F.struct(*[data[f].alias(f) for f in have]))


def keep_fields(df: DataFrame, path: str, wanted: Column) -> Column:
    """Row-wise field filter: fields outside the array ``wanted`` become null; an empty array keeps all."""
    data = F.col(path)
    all_fields = F.size(wanted) == 0
    kept = [
        F.when(all_fields | F.array_contains(wanted, f), data[f]).alias(f) for f in struct_type(df, path).names
    ]
    return F.when(data.isNotNull(), F.struct(*kept))


def merge_fields(df: DataFrame, parts: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """One struct out of (struct column, fields) pairs.

    Field order is that of first appearance, which also fixes the type; the last
    non-null struct that has the field gives the value. A field that is nested
    in one and plain in another raises.
    """
    first: dict[str, T.DataType] = {}
    sources: dict[str, list[Column]] = {}
    for path, fields in parts:
        kind = struct_type(df, path)
        for f in fields:
            if f not in kind.names:
                continue
            have = first.setdefault(f, kind[f].dataType)
            if isinstance(have, T.StructType) != isinstance(kind[f].dataType, T.StructType):
                raise TypeError(f"field {f} is nested in one structure and plain in another")
            value = F.col(path)[f].cast(have)
            sources.setdefault(f, []).append(F.when(F.col(path).isNotNull(), F.struct(value.alias("v"))))
    picked = [F.coalesce(*reversed(cols))["v"].alias(f) for f, cols in sources.items()]
    return F.struct(*picked)


def append_structs(a: Column, a_type: T.StructType, b: Column, b_type: T.StructType) -> Column:
    """Fields of both structs, by name and in depth; on a clash of plain fields ``b`` wins."""
    out = []
    for name in [*a_type.names, *[n for n in b_type.names if n not in a_type.names]]:
        in_a, in_b = name in a_type.names, name in b_type.names
        if in_a and in_b:
            ta, tb = a_type[name].dataType, b_type[name].dataType
            if isinstance(ta, T.StructType) and isinstance(tb, T.StructType):
                value = append_structs(a[name], ta, b[name], tb)
            else:
                value = F.coalesce(b[name].cast(ta), a[name])
        else:
            value = a[name] if in_a else b[name]
        out.append(value.alias(name))
    return F.struct(*out)


def leaf_paths(kind: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """(dotted path, type) of every leaf outside struct arrays, depth first."""
    out = []
    for field in kind.fields:
        path = f"{prefix}{field.name}"
        if isinstance(field.dataType, T.StructType):
            out += leaf_paths(field.dataType, path + ".")
        else:
            out.append((path, field.dataType))
    return out


def _is_struct_array(kind: T.DataType) -> bool:
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType)


def _text(value: Column, kind: T.DataType) -> Column:
    return F.to_json(value) if isinstance(kind, T.ArrayType) else value.cast("string")


def _element_leaves(path: Column, kind: T.StructType):
    def of(element, i):
        return leaves(element, kind, F.concat(path, F.lit("["), i.cast("string"), F.lit("].")))

    return of


def leaves(value: Column, kind: T.StructType, prefix: str | Column = "") -> Column:
    """``array<struct<path, value>>`` of all scalars and scalar arrays in field order.

    Walks through structs and struct arrays; variants (unions) are left out.
    """
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    parts = []
    for field in kind.fields:
        path = F.concat(head, F.lit(field.name))
        item, t = value[field.name], field.dataType
        if isinstance(t, T.VariantType):
            continue
        if isinstance(t, T.StructType):
            parts.append(leaves(item, t, F.concat(path, F.lit("."))))
        elif _is_struct_array(t):
            parts.append(F.flatten(F.transform(item, _element_leaves(path, t.elementType))))
        else:
            parts.append(F.array(F.struct(path.alias("path"), _text(item, t).alias("value"))))
    # a null struct array has no leaves; the rest of its row stays
    return F.concat(*[F.coalesce(p, F.array().cast("array<struct<path:string,value:string>>")) for p in parts])


def rebuild(data: Column, kind: T.StructType, leaf, prefix: str = "") -> Column:
    """The struct with every leaf replaced by ``leaf(path, old value, type)``; one pass over the schema."""
    fields = []
    for field in kind.fields:
        path, old = f"{prefix}{field.name}", data[field.name]
        if isinstance(field.dataType, T.StructType):
            fields.append(rebuild(old, field.dataType, leaf, path + ".").alias(field.name))
        else:
            fields.append(leaf(path, old, field.dataType).alias(field.name))
    return F.struct(*fields)


def table_rows(df: DataFrame, path: str) -> DataFrame:
    """A table value (struct of equally long arrays) as rows with their position."""
    columns = struct_type(df, path).names
    zipped = F.arrays_zip(*[F.col(f"{path}.{c}").alias(c) for c in columns])
    rest = [c for c in df.columns if c != path.split(".")[0]]
    return df.select(*rest, F.posexplode(zipped).alias("row", "_cells")).select(*rest, "row", "_cells.*")


def alarm_severity(value: Column, lolo: Column, low: Column, high: Column, hihi: Column) -> Column:
    """0 none, 1 minor, 2 major, by limits that count as reached when equal."""
    return F.when((value >= hihi) | (value <= lolo), 2).when((value >= high) | (value <= low), 1).otherwise(0)
