"""As-of joins: each left row with the latest right row at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.operators.ordered import carry, slice_width


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    *,
    left_at: str = "ts_us",
    right_at: str = "ts_us",
    left_seq: str = "seq",
    right_seq: str = "seq",
    keep_unmatched: bool = False,
    width: int | None = None,
) -> DataFrame:
    """``left`` plus a struct column ``matched`` holding the matching right row.

    Both sides travel in one shuffle on the key, and a running last value picks
    the match: no range condition, no row multiplication. At equal times the
    right row counts as earlier. ``width`` None measures both sides first.
    """
    if width is None:
        times = left.select(F.col(left_at).alias("t")).unionAll(right.select(F.col(right_at).alias("t")))
        width = slice_width(times, "t")
    null_left = F.lit(None).cast(_struct_type(left))
    null_right = F.lit(None).cast(_struct_type(right))
    events = left.select(
        *on,
        F.col(left_at).alias("_at"),
        F.lit(1).alias("_side"),
        F.col(left_seq).alias("_seq"),
        F.struct(*left.columns).alias("_l"),
        null_right.alias("_r"),
    ).unionByName(
        right.select(
            *on,
            F.col(right_at).alias("_at"),
            F.lit(0).alias("_side"),
            F.col(right_seq).alias("_seq"),
            null_left.alias("_l"),
            F.struct(*right.columns).alias("_r"),
        )
    )
    joined = carry(events, on, "_at", ["_side", "_seq"], F.col("_r"), "matched", width=width).where("_side = 1")
    if not keep_unmatched:
        joined = joined.where(F.col("matched").isNotNull())
    return joined.select("_l.*", "matched")


def _struct_type(df: DataFrame) -> str:
    return df.schema.simpleString()
