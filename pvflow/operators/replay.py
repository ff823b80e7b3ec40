"""Archive tables of snapshots and PV values, and replay by time range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the Bloom filter of a file, and how many of them a name sets. A file with more names has more false hits, and no misses.
BLOOM_BITS, BLOOM_HASHES = 1 << 16, 4


def snapshot_id(queue: Column, start_us: Column, iter_index: Column) -> Column:
    """Iterations count from 1 in every run, so the start of the run is part of the id."""
    return F.concat_ws("-", queue, start_us.cast("string"), iter_index.cast("string"))


def calendar(ts_us: Column) -> dict[str, Column]:
    at = F.timestamp_micros(ts_us)
    return {"year": F.year(at), "month": F.month(at), "day": F.dayofmonth(at)}


def pv_values(samples: DataFrame, source: str) -> DataFrame:
    """One row per PV sample in the shape of the value archive, with its date."""
    return samples.select(
        F.col("pv_name").alias("pv"),
        "value",
        F.lit(dict(samples.dtypes)["value"]).alias("type"),
        "ts_us",
        "seq",
        F.lit(source).alias("source"),
        "snapshot_id" if "snapshot_id" in samples.columns else F.lit(None).cast("string").alias("snapshot_id"),
        F.to_date(F.timestamp_micros("ts_us")).alias("date"),
    )


def snapshot_index(blobs: DataFrame) -> DataFrame:
    """One row per snapshot: its time, how many PVs it holds (one row each), and the folder its rows are in."""
    counted = blobs.groupBy("snapshot_id", "snapshot_us").agg(F.count(F.lit(1)).alias("pv_count"))
    folders = [F.concat(F.lit(f"{name}="), value) for name, value in calendar(F.col("snapshot_us")).items()]
    return counted.withColumn("blob_key", F.concat_ws("/", *folders))


def replay(index: DataFrame, blobs: DataFrame, from_us: int, to_us: int) -> DataFrame:
    """PV rows of the snapshots taken in ``[from_us, to_us]``, in time order.

    The range reaches both tables, so that date partitions of the blobs outside
    it are never opened.
    """
    wanted = index.where(F.col("snapshot_us").between(from_us, to_us)).select("snapshot_id", "snapshot_us")
    inside = blobs.where(F.col("snapshot_us").between(from_us, to_us))
    if {"year", "month", "day"} <= set(blobs.columns):
        day = F.make_date("year", "month", "day")
        low = F.to_date(F.timestamp_micros(F.lit(from_us)))
        high = F.to_date(F.timestamp_micros(F.lit(to_us)))
        inside = inside.where(day.between(low, high))
    return inside.join(wanted, ["snapshot_id", "snapshot_us"]).orderBy("snapshot_us", "snapshot_id", "pv_name", "seq")


def _bits(name: Column) -> Column:
    """The bits a PV name sets, by two hashes."""
    step = F.pmod(F.xxhash64(F.lit("step"), name), F.lit(BLOOM_BITS)) + 1
    first = F.pmod(F.xxhash64(name), F.lit(BLOOM_BITS))
    return F.transform(F.sequence(F.lit(0), F.lit(BLOOM_HASHES - 1)), lambda j: F.pmod(first + j * step, F.lit(BLOOM_BITS)))


def file_index(values: DataFrame) -> DataFrame:
    """One row per file of the value archive: path, range of names and times, and a Bloom filter of its PV names.

    values: read from files, with pv and ts_us. Names are made distinct per file first, so a filter is put
    together out of (file, word) rows, and no task holds the names of a file. The filter is a map of its 64-bit words.
    """
    named = values.select(F.col("_metadata.file_path").alias("path"), "pv", "ts_us").where("pv IS NOT NULL")
    per_name = named.groupBy("path", "pv").agg(F.min("ts_us").alias("low"), F.max("ts_us").alias("high"), F.count(F.lit(1)).alias("n"))
    ranges = per_name.groupBy("path").agg(
        F.min("pv").alias("min_pv"), F.max("pv").alias("max_pv"), F.min("low").alias("min_us"), F.max("high").alias("max_us"), F.sum("n").alias("rows")
    )
    bits = per_name.select("path", F.explode(_bits(F.col("pv"))).alias("bit"))
    words = bits.groupBy("path", F.shiftright("bit", 6).alias("at")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("bit") % 64).cast("int"))).alias("word")
    )
    filters = words.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("bloom"))
    return ranges.join(filters, "path")


def files_with(index: DataFrame, names: Sequence[str], from_us: int, to_us: int) -> DataFrame:
    """The files of the index that may hold one of the named PVs within ``[from_us, to_us]``."""
    asked = F.array(*[F.struct(F.lit(n).alias("pv"), _bits(F.lit(n)).alias("bits")) for n in names])

    def has(bit: Column) -> Column:
        word = F.try_element_at("bloom", F.shiftright(bit, 6))
        return F.coalesce(F.getbit(word, (bit % 64).cast("int")) == 1, F.lit(False))

    inside = F.exists(asked, lambda a: a["pv"].between(F.col("min_pv"), F.col("max_pv")) & F.forall(a["bits"], has))
    return index.where((F.col("min_us") <= to_us) & (F.col("max_us") >= from_us) & inside).select("path", "rows")


def replay_pvs(spark: SparkSession, archive: str, schema: str, index: DataFrame, names: Sequence[str], from_us: int, to_us: int) -> DataFrame:
    """The samples of a few named PVs in ``[from_us, to_us]``, in time order, out of the files that may hold them.

    Only the list of these files comes to the driver, as the listing of a folder does; the others are never opened.
    """
    paths = [r.path for r in files_with(index, names, from_us, to_us).select("path").collect()]
    reader = spark.read.schema(schema)
    rows = reader.option("basePath", archive).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return rows.where(F.col("pv").isin(list(names)) & F.col("ts_us").between(from_us, to_us)).orderBy("ts_us", "pv", "seq")
