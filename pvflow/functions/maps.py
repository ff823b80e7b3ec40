"""Maps out of entries that may repeat a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_wins(entries: Column) -> Column:
    """A map of (key, value) entries; of a repeated key the first entry counts, null keys are left out."""
    named = F.filter(entries, lambda e: e["key"].isNotNull())
    keys = F.transform(named, lambda e: e["key"])
    return F.map_from_entries(F.filter(named, lambda e, i: F.array_position(keys, e["key"]) == i + 1))


def last_wins(entries: Column) -> Column:
    """The same with the last entry of each key."""
    return first_wins(F.reverse(entries))
