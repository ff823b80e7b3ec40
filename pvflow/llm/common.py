"""What the training-data operators share: words, batches, durable intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pvflow.session import configure, work_dir

#: A word is a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch: bound what a Python worker holds at once, however long the texts that meet.
BATCH_ROWS = 256
BATCH_BYTES = 8 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators rely on."""
    spark = configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, however often ``body`` names it.

    A lambda variable is bound per element, so the optimizer cannot copy the
    expression into each place of use.
    """
    return F.transform(F.array(value), body)[0]


def text_of(col: str = "text") -> Column:
    """The text, a null one being empty."""
    return F.coalesce(F.col(col), F.lit(""))


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write once below the shared checkpoint folder and read back: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_columns(df: DataFrame, inputs: list[str], fn: Callable[..., dict[str, pa.Array]], schema: str) -> DataFrame:
    """Add columns computed batch by batch: ``fn`` takes Arrow arrays and returns the new ones by name.

    Columns of ``df`` keep their order and type; ``schema`` lists the new columns. Names of the new
    columns replace equal names of ``df``.
    """
    from pyspark.sql.types import StructType

    added = StructType.fromDDL(schema)
    names = {f.name.lower() for f in added.fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    kept_names = [f.name for f in kept]
    new_names = added.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            made = fn(*[batch.column(n) for n in inputs])
            arrays = [batch.column(n) for n in kept_names] + [made[n] for n in new_names]
            yield pa.RecordBatch.from_arrays(arrays, names=kept_names + new_names)

    return df.mapInArrow(run, StructType(kept + added.fields))
