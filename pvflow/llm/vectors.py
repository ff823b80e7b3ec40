"""What the vector operators share: clean vectors, whole components, Arrow batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 256
#: Whole components are held within +-LIMIT, so that squared distances and their sums fit 64 bits.
LIMIT = 1 << 24


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def is_clean(vector: Column) -> Column:
    """Whether a vector is there and holds finite numbers only (NaN sorts above infinity)."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def whole(vector: Column) -> Column:
    """The components as whole numbers, array<int>."""
    bound = lambda x: F.greatest(F.least(x, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))
    return F.transform(vector, lambda x: F.floor(bound(x.cast("double") * SCALE)).cast("int"))


def matrix(lists: pa.Array, dtype: type = np.int64) -> np.ndarray:
    """A list column whose rows have equal lengths, as a matrix."""
    n = len(lists)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(n, -1)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at least ``rows`` (but for the last), which bounds what a worker holds."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def slot_sums(df: DataFrame, partial, shape: tuple[int, ...]) -> np.ndarray:
    """Exact sums over all rows, added up in each task first.

    ``partial(batches)`` yields int64 arrays of ``shape``. Each task passes on the cells other than zero; their
    totals, as many as ``shape`` has cells, come to the driver as Python integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for part in partial(batches):
            total += part
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(total.ravel()[slots], pa.int64())], names=["slot", "part"])

    sums = df.mapInArrow(run, "slot bigint, part bigint").groupBy("slot").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out = np.zeros(int(np.prod(shape)), dtype=object)
    for slot, total in sums.collect():
        out[slot] = int(total)
    return out.reshape(shape)
