"""Ordered scans over a key: last value, next value, running sum.

A window over ``partitionBy(key)`` puts the whole history of one key into one
task. These helpers cut the history into slices of the ordering column: each
(key, slice) is scanned on its own, and what happened before the slice arrives
as one extra row at its head. That row comes from a pre-aggregated summary with
one row per (key, slice), so the result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_ROWS = 2_000_000
_CELL_US = 60_000_000

_SLICE, _HEAD, _VAL, _FLOOR = "_slice", "_head", "_val", "_floor"


def slice_width(df: DataFrame, at: str, target_rows: int = TARGET_ROWS, cell: int = _CELL_US) -> int:
    """Width of a slice of the integer column ``at``, or 0 when one slice is enough.

    The busiest cell bounds the row count of a slice even if all its rows share
    one key. The job reads only ``at`` and combines on the map side.
    """
    cells = df.groupBy(F.floor(F.col(at) / F.lit(cell)).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    row = cells.agg(F.sum("n").alias("total"), F.max("n").alias("peak")).first()
    if row.total is None or row.total <= target_rows:
        return 0
    return max(1, cell * target_rows // row.peak)


def _window(keys: Sequence[str], at: str, order: Sequence[str], backward: bool, head: bool):
    flip = (lambda c: F.col(c).desc()) if backward else (lambda c: F.col(c).asc())
    ordering = [flip(c) for c in (at, *order)]
    if head:
        return Window.partitionBy(*keys, _SLICE).orderBy(F.col(_HEAD), *ordering)
    return Window.partitionBy(*keys).orderBy(*ordering)


def _sliced(df: DataFrame, at: str, width: int) -> DataFrame:
    return df.withColumn(_SLICE, slice_of(at, width)).withColumn(_HEAD, F.lit(1))


def _chain(keys: Sequence[str], backward: bool):
    by = F.col(_SLICE).desc() if backward else F.col(_SLICE).asc()
    return Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)


def carry(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    order: Sequence[str],
    value: Column,
    out: str,
    *,
    width: int,
    strict: bool = False,
    backward: bool = False,
) -> DataFrame:
    """Add ``out``: the last non-null ``value`` of the key up to this row.

    ``width`` is that of ``slice_width``; ``strict`` leaves out the row itself;
    ``backward`` looks at later rows and takes the nearest. ``(at, *order)`` must
    order the rows of a key totally.
    """
    end = -1 if strict else 0
    if width == 0:
        w = _window(keys, at, order, backward, head=False).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))

    rows = _sliced(df.withColumn(_VAL, value), at, width)
    pick = F.min_by if backward else F.max_by
    rank = F.when(F.col(_VAL).isNotNull(), F.struct(at, *order))
    summary = rows.groupBy(*keys, _SLICE).agg(pick(F.col(_VAL), rank).alias(_VAL))
    heads = (
        summary.withColumn(_VAL, entering(_VAL, keys, backward))
        .where(F.col(_VAL).isNotNull())
        .withColumn(_HEAD, F.lit(0))
    )
    w = slice_window(keys, at, order, backward).rowsBetween(Window.unboundedPreceding, end)
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .withColumn(out, F.last(_VAL, ignorenulls=True).over(w))
        .where(F.col(_HEAD) == 1)
        .drop(_SLICE, _HEAD, _VAL)
    )


def slice_of(at: str, width: int) -> Column:
    return F.floor(F.col(at) / F.lit(width))


def slice_window(keys: Sequence[str], at: str, order: Sequence[str], backward: bool):
    """Rows of one (key, slice), its head row first."""
    return _window(keys, at, order, backward, head=True)


def entering(value: str, keys: Sequence[str], backward: bool = False) -> Column:
    """Over one row per (key, slice): the last non-null value of the slices before (or after) this one."""
    return F.last(value, ignorenulls=True).over(_chain(keys, backward))


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    order: Sequence[str],
    amount: Column,
    out: str,
    *,
    width: int,
    backward: bool = False,
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over the key up to and including this row."""
    if width == 0:
        w = _window(keys, at, order, backward, head=False).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(amount).over(w))

    rows = _sliced(df.withColumn(_VAL, amount), at, width)
    heads = (
        rows.groupBy(*keys, _SLICE)
        .agg(F.sum(_VAL).alias(_VAL))
        .withColumn(_VAL, F.sum(_VAL).over(_chain(keys, backward)))
        .where(F.col(_VAL).isNotNull())
        .withColumn(_HEAD, F.lit(0))
    )
    w = _window(keys, at, order, backward, head=True).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .withColumn(out, F.sum(_VAL).over(w))
        .where(F.col(_HEAD) == 1)
        .drop(_SLICE, _HEAD, _VAL)
    )


def running_low(
    df: DataFrame,
    keys: Sequence[str],
    at: str,
    order: Sequence[str],
    amount: Column,
    total: str,
    low: str,
    *,
    width: int,
) -> DataFrame:
    """Add the running sum ``total`` and the lowest running sum so far ``low``."""
    if width == 0:
        w = _window(keys, at, order, False, head=False).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(total, F.sum(amount).over(w)).withColumn(low, F.min(total).over(w))

    rows = _sliced(df.withColumn(_VAL, amount), at, width)
    w = _window(keys, at, order, False, head=True).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select(*keys, _SLICE, _HEAD, at, *order, _VAL).withColumn("_s", F.sum(_VAL).over(w))
    chain = _chain(keys, False)
    heads = (
        local.groupBy(*keys, _SLICE)
        .agg(F.sum(_VAL).alias("_sum"), F.min("_s").alias(_FLOOR))
        .withColumn("_before", F.sum("_sum").over(chain))
        .withColumn(_FLOOR, F.min(F.coalesce("_before", F.lit(0)) + F.col(_FLOOR)).over(chain))
        .where(F.col("_before").isNotNull())
        .select(*keys, _SLICE, F.lit(0).alias(_HEAD), F.col("_before").alias(_VAL), _FLOOR)
    )
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .withColumn(total, F.sum(_VAL).over(w))
        .withColumn(low, F.min(F.coalesce(_FLOOR, total)).over(w))
        .where(F.col(_HEAD) == 1)
        .drop(_SLICE, _HEAD, _VAL, _FLOOR)
    )


def explode_range(df: DataFrame, first: Column, last: Column, out: str, block: int = 4096) -> DataFrame:
    """One row per integer of ``[first, last]``, in two steps so that no row builds a long array."""
    lo, hi = "_lo", "_hi"
    return (
        df.withColumn(lo, first.cast("bigint"))
        .withColumn(hi, last.cast("bigint"))
        .where(F.col(hi) >= F.col(lo))
        .withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(hi) - F.col(lo)) / block))))
        .withColumn(
            out,
            F.explode(
                F.sequence(
                    F.col(lo) + F.col("_blk") * block,
                    F.least(F.col(hi), F.col(lo) + F.col("_blk") * block + (block - 1)),
                )
            ),
        )
        .drop(lo, hi, "_blk")
    )
