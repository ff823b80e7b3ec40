"""Typed access to JSON objects held as VARIANT, with exact kinds and defaults.

``open_object`` takes the text apart once: per key a VARIANT column and the name
of its type. The accessors below only read those columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
_MEMBER, _TYPE, ROOT = "_m_", "_t_", "_root"


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once per row.

    The generator keeps the optimizer from copying the expressions into every
    filter and projection above, which for parsing is the larger cost.
    """
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def open_object(df: DataFrame, payload: str, keys: list[str], **early: Column) -> DataFrame:
    """Take the text apart. ``early`` columns read the root (``root_text``) and come
    first: a filter on them spares the other rows the rest of the work."""
    root = F.col(ROOT)
    df = evaluated(df, **{ROOT: F.try_parse_json(F.col(payload).cast("string"))})
    if early:
        df = evaluated(df, **early)
    df = evaluated(df, **{_MEMBER + k: F.try_variant_get(root, f"$.{k}", "variant") for k in keys})
    types = {_TYPE + k: F.schema_of_variant(F.col(_MEMBER + k)) for k in keys}
    return evaluated(df, **types, _t_root=F.schema_of_variant(root))


def root_text(key: str) -> Column:
    """The value of a plain member as text, whatever its kind."""
    return F.try_variant_get(F.col(ROOT), f"$.{key}", "string")


def is_object() -> Column:
    return F.coalesce(F.col("_t_root").startswith("OBJECT"), F.lit(False))


def is_kind(key: str, kind: str) -> Column:
    """The key is present and its value has exactly this JSON kind."""
    t = F.col(_TYPE + key)
    test = {
        "string": t == "STRING",
        "number": t.rlike(_NUMBER),
        "boolean": t == "BOOLEAN",
        "array": t.startswith("ARRAY"),
        "object": t.startswith("OBJECT"),
    }[kind]
    return F.coalesce(test, F.lit(False))


def present(key: str) -> Column:
    return F.col(_TYPE + key).isNotNull()


def has(wanted: dict[str, str]) -> Column:
    checks = F.lit(True)
    for key, kind in wanted.items():
        checks = checks & is_kind(key, kind)
    return checks


def _as(key: str, kind: str) -> Column:
    return F.try_variant_get(F.col(_MEMBER + key), "$", kind)


def text(key: str, default: str | Column = "") -> Column:
    return F.when(is_kind(key, "string"), _as(key, "string")).otherwise(default)


def integer(key: str, default: int) -> Column:
    """A number that is an exact 32-bit integer, else the default."""
    d = _as(key, "double")
    exact = is_kind(key, "number") & (d == F.floor(d)) & (d >= -(2**31)) & (d < 2**31)
    return F.when(exact, d.cast("int")).otherwise(default)


def boolean(key: str, default: bool) -> Column:
    return F.when(is_kind(key, "boolean"), _as(key, "boolean")).otherwise(default)


def strings(key: str) -> Column:
    """The distinct string elements of an array; other elements are skipped."""
    only = F.filter(_as(key, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    names = F.array_distinct(F.transform(only, lambda x: F.try_variant_get(x, "$", "string")))
    return F.when(is_kind(key, "array"), names).otherwise(F.array().cast("array<string>"))


def string_map(key: str) -> Column:
    """The string values of an object; other values are skipped."""
    entries = F.map_filter(_as(key, "map<string,variant>"), lambda _, x: F.schema_of_variant(x) == "STRING")
    kept = F.transform_values(entries, lambda _, x: F.try_variant_get(x, "$", "string"))
    return F.when(is_kind(key, "object"), kept).otherwise(F.create_map().cast("map<string,string>"))
