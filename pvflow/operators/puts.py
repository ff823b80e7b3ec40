"""Partial updates of nested PV values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pvflow.functions.nested import leaf_paths, rebuild, struct_type


def last_writes(changes: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Per PV the last value written to each path, one column per path.

    changes: pv_name, change_seq, path, value (text). One aggregation with a
    partial step; unknown paths take no part.
    """
    known = changes.where(F.col("path").isin(list(paths)))
    picks = []
    for i, p in enumerate(paths):
        hit = F.col("path") == p
        picks.append(F.max_by(F.when(hit, F.col("value")), F.when(hit, F.col("change_seq"))).alias(f"_w{i}"))
    return known.groupBy("pv_name").agg(*picks)


def put_apply(states: DataFrame, changes: DataFrame, immutable: Sequence[str] = ()) -> DataFrame:
    """States with the last written leaves; what was not written stays as it is.

    A write to an immutable leaf is refused as a whole put (``put_outcome``), so
    such puts have to be filtered out first.
    """
    kind = struct_type(states, "data")
    paths = [(p, t) for p, t in leaf_paths(kind) if p not in immutable]
    written = last_writes(changes, [p for p, _ in paths])
    joined = states.join(written, "pv_name", "left")
    slot = {path: f"_w{i}" for i, (path, _) in enumerate(paths)}

    def leaf(path, old, t):
        if path not in slot:
            return old
        text = F.col(slot[path])
        return F.coalesce(F.from_json(text, t) if t.typeName() == "array" else text.try_cast(t), old)

    return joined.select("pv_name", rebuild(F.col("data"), kind, leaf).alias("data"))


def put_outcome(changes: DataFrame, kind, immutable: Sequence[str] = ()) -> DataFrame:
    """Per put (pv_name, change_seq): 'ok', 'immutable' or 'nothing to update'."""
    known = F.col("path").isin([p for p, _ in leaf_paths(kind)])
    locked = F.col("path").isin(list(immutable)) if immutable else F.lit(False)
    return (
        changes.groupBy("pv_name", "change_seq")
        .agg(F.bool_or(known).alias("_any"), F.bool_or(locked).alias("_locked"))
        .select(
            "pv_name",
            "change_seq",
            F.when(F.col("_locked"), "immutable")
            .when(~F.col("_any"), "nothing to update")
            .otherwise("ok")
            .alias("outcome"),
        )
    )
