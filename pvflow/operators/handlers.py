"""User code over windows and over registry rows, fed with Arrow batches."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pvflow.operators import snapshots as snap

#: Rows of the batches that user code sees at most; a group of any size comes in as many as it needs.
PAGE = 4_096

GroupCode = Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
PageCode = Callable[[pa.RecordBatch], pa.RecordBatch]


def _pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The batches cut where a key changes, each piece with its key."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = {batch.num_rows}
        for key in keys:
            ends.update(pc.run_end_encode(batch.column(key)).run_ends.to_pylist())
        start = 0
        for end in sorted(ends):
            for at in range(start, end, PAGE):
                piece = batch.slice(at, min(PAGE, end - at))
                yield tuple(piece.column(key)[0].as_py() for key in keys), piece
            start = end


def over_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str], code: GroupCode, schema: str | StructType) -> DataFrame:
    """Run ``code(key, batches)`` for every group of equal ``keys``, its rows in the order of ``order``.

    The rows come batch by batch out of a sorted partition, and what ``code`` yields leaves batch by batch: no group is
    ever held whole, neither here nor in the JVM, which sorts with spilling. ``code`` may stop reading early. Groups
    are dealt by key, so one group is one task's work, as code over a group in order has to be.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in itertools.groupby(_pieces(batches, keys), key=lambda piece: piece[0]):
            yield from code(key, (batch for _, batch in group))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def over_windows(events: DataFrame, members: DataFrame, code: GroupCode, schema: str | StructType) -> DataFrame:
    """Run code over the events of every finished window of every run, by (queue_name, start_us, iter_index) in order of time.

    events and members as in ``snapshots``; a window without events is not visited.
    """
    members, known = snap.until_newest(events, members)
    routed = snap.route(events, members, known).withColumn("iter_index", snap.iteration())
    return over_groups(routed, [*snap.RUN, "iter_index"], ["ts_us", "seq", "pv_name"], code, schema)


def process_rows(
    registry: DataFrame, code: PageCode, schema: str, *, only_unprocessed: bool = False, done: str = "processed"
) -> DataFrame:
    """The registry after ``code`` has seen its rows in pages: the columns of ``schema`` beside it, and ``done`` set.

    ``code`` takes a page of at most ``PAGE`` rows and returns as many, in the same order, with the columns of
    ``schema``, among them a boolean ``ok``; rows that are not ok keep their mark, so a later call
    for the unprocessed ones sees them again. With ``only_unprocessed`` rows already marked are left out.
    """
    rows = registry.where(~F.coalesce(F.col(done), F.lit(False))) if only_unprocessed else registry
    added = StructType.fromDDL(schema)
    kept = [f for f in rows.schema.fields if f.name not in added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGE):
                page = batch.slice(at, PAGE)
                made = code(page)
                if made.num_rows != page.num_rows:
                    raise ValueError(f"{page.num_rows} rows went in and {made.num_rows} came out")
                arrays = [page.column(f.name) for f in kept] + [made.column(n) for n in added.names]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in kept] + added.names)

    out = rows.mapInArrow(run, StructType(kept + added.fields))
    return out.withColumn(done, F.coalesce(F.col(done), F.lit(False)) | F.coalesce(F.col("ok"), F.lit(False)))
