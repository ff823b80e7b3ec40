"""Equi join of a large event side with a lookup side that is usually small."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20
SALTS = 32
#: Keys a summary of the event side follows, and the share of all rows from which a key counts as hot.
TRACKED, HOT_SHARE = 1_000, 1 / 256
_SALT = "_salt"
#: What a text or a list is taken for where only the number of rows is known.
_GUESS = 64


class Size(NamedTuple):
    rows: int
    bytes: int


def _plain_width(kind: T.DataType) -> int:
    if isinstance(kind, T.StructType):
        return sum(_plain_width(f.dataType) for f in kind.fields)
    return 8 if isinstance(kind, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)) else _GUESS


def _width(value: Column, kind: T.DataType) -> Column:
    """About the bytes of one value; text and lists by their length."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        return F.coalesce(F.octet_length(F.array_join(value, "")) + 16 * F.size(value), F.lit(0)) + 16
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.size(value), F.lit(0)) * _GUESS + 16
    return F.lit(_plain_width(kind))


def measured(df: DataFrame) -> Size:
    """Rows and about the bytes of a table, in one pass."""
    total = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(8))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(total.cast("bigint")).alias("b")).first()
    return Size(row.n, row.b or 0)


def hot_keys(big: DataFrame, on: Sequence[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys that hold at least ``share`` of the rows, out of a bounded summary built in one pass.

    The summary (``approx_top_k``) merges per task, so no key is shuffled. Of n rows it may miss or overrate
    a key by about n / TRACKED; salting a key that is not hot costs little and changes no result.
    """
    top = F.expr(f"approx_top_k(_key, {min(TRACKED, int(1 / share) + 1)}, {TRACKED})")
    row = big.select(F.xxhash64(*on).alias("_key")).agg(F.count(F.lit(1)).alias("n"), top.alias("top")).first()
    return [t["item"] for t in row.top or [] if t["item"] is not None and t["count"] >= max(1, share * row.n)]


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    *,
    rows: int | None = None,
    max_rows: int = BROADCAST_ROWS,
    max_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Join ``big`` with ``small`` (inner, left, left_semi, left_anti).

    ``small`` is measured (unless its number of ``rows``, or a bound of it, is known) and broadcast only up to
    ``max_rows`` rows and about ``max_bytes`` bytes. Beyond that the join shuffles on (key, salt). Only the rows of
    hot keys, which a summary of ``big`` names, get a salt other than 0, and only their rows of ``small`` are
    repeated; the rest joins plainly. The salt is a hash of the whole row, so a recomputed task sends its rows to
    the same place. A stream cannot be summed up beforehand: there all keys are salted.
    """
    size = measured(small) if rows is None else Size(rows, rows * _plain_width(small.schema))
    if size.rows <= max_rows and size.bytes <= max_bytes:
        return big.join(F.broadcast(small), list(on), how)
    spread = F.pmod(F.xxhash64(*_hashable(big)), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if not big.isStreaming:
        hot = hot_keys(big, on, share)
        if not hot:
            return big.join(small, list(on), how)
        is_hot = F.xxhash64(*on).isin(hot)
        spread, every = F.when(is_hot, spread).otherwise(0), F.when(is_hot, every).otherwise(F.array(F.lit(0)))
    repeated = small.withColumn(_SALT, F.explode(every))
    return big.withColumn(_SALT, spread).join(repeated, [*on, _SALT], how).drop(_SALT)


def _hashable(df: DataFrame) -> list:
    blocked = ("map", "variant")
    return [F.col(f"`{n}`") for n, t in df.dtypes if not any(b in t for b in blocked)]
