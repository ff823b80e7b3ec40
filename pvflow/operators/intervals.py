"""Interval join: points of time and the intervals that hold them, per key, out of equi joins only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.operators.joins import lookup_join
from pvflow.operators.ordered import explode_range, running_sum, slice_of

_SLICE, _CELL = "_slice", "_cell"


def interval_width(intervals: DataFrame, start: str, stop: str) -> int:
    """A slice as long as half of the closed intervals: short ones meet two slices, and a slice sees few in vain."""
    row = intervals.agg(F.percentile_approx(F.col(stop) - F.col(start), 0.5)).first()
    return max(1, int(row[0] or 0))


def active(points: DataFrame, intervals: DataFrame, keys: Sequence[str], *, at: str, start: str, stop: str, width: int) -> DataFrame:
    """The intervals alive in each slice of a key that holds points: the intervals' columns and ``_slice``.

    Slices without points are never written out. The slices of a key that hold points are numbered in order of time;
    two running sums give each interval the number of the first and the last of them that it overlaps, and it is
    repeated for these numbers only, whatever its length.
    """
    cells = points.where(F.col(at).isNotNull()).select(*keys, slice_of(at, width).alias(_SLICE), F.lit(1).cast("bigint").alias("_one")).distinct()
    live = intervals.where(F.col(stop).isNull() | (F.col(stop) > F.col(start)))
    through = F.coalesce(F.floor((F.col(stop) - 1) / F.lit(width)), F.lit(2**62))
    rows = live.withColumns({"_one": F.lit(0).cast("bigint"), "_last": through, _SLICE: slice_of(start, width)})
    # at the start of an interval a slice of equal number is still to come, at its end it counts
    first = cells.withColumn("_side", F.lit(1)).unionByName(rows.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    first = running_sum(first, keys, _SLICE, ["_side"], F.col("_one"), "_before", width=0)
    numbered = first.where("_side = 1").select(*keys, _SLICE, F.col("_before").alias(_CELL))
    begun = first.where("_side = 0").withColumn(_SLICE, F.col("_last"))
    last = cells.withColumn("_side", F.lit(0)).unionByName(begun.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    last = running_sum(last, keys, _SLICE, ["_side"], F.col("_one"), "_through", width=0).where("_side = 1")
    spans = explode_range(last.select(*live.columns, "_before", "_through"), F.col("_before") + 1, F.col("_through"), _CELL)
    return spans.join(numbered, [*keys, _CELL]).select(*live.columns, _SLICE)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    *,
    at: str = "ts_us",
    start: str = "start_us",
    stop: str = "stop_us",
    width: int,
) -> DataFrame:
    """Each point with every interval of its key that holds it: start <= at < stop, a null stop being open.

    Points and intervals meet on (key, slice of time) only where both are there, so the work grows with the points
    and with what they find, not with points x intervals of a key; a key that holds many points spreads over its
    slices. ``width`` is that of ``interval_width``. Columns other than the keys must have different names.
    Points without a time and empty intervals find nothing.
    """
    alive = active(points, intervals, keys, at=at, start=start, stop=stop, width=width)
    placed = points.withColumn(_SLICE, slice_of(at, width))
    met = lookup_join(placed, alive, [*keys, _SLICE])
    return met.where((F.col(at) >= F.col(start)) & (F.col(stop).isNull() | (F.col(at) < F.col(stop)))).drop(_SLICE)
