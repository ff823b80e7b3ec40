"""Streams cut into several batches give what the batch operators give."""

import pytest
from pyspark.sql import functions as F

from pvflow.operators import latest as L
from pvflow.operators import registry as R
from pvflow.operators import snapshots as snap
from pvflow.sources import tables as T
from pvflow.sources.readers import file_stream
from pvflow.streaming import runs as X
from pvflow.streaming import snapshots as XS
from pvflow.streaming import stateful as XF


FAR = T.STOP_US + 20 * T.DAY_US


@pytest.fixture(scope="module")
def parts(spark, sf_dir, tmp_path_factory):
    """The sparse events in five files out of order (later days first within each pair), one a batch, then a heartbeat."""
    X.use_rocksdb(spark)
    path = str(tmp_path_factory.mktemp("events"))
    events = T.as_sparse(T.timed(T.table(spark, sf_dir, "events")))
    for i in (1, 0, 3, 2, 4):
        low, high = T.START_US + i * 6 * T.DAY_US, T.START_US + (i + 1) * 6 * T.DAY_US
        events.where(F.col("ts_us").between(low, high - 1)).coalesce(1).write.mode("append").parquet(path)
    end = F.timestamp_micros(F.lit(FAR))
    beat = spark.range(1).select(F.lit("").alias("pv_name"), end.alias("ts"), F.lit(T.START_US).alias("ts_us"))
    beat = beat.withColumns({"event_type": F.lit("Data"), "source": F.lit("view")})
    events.limit(0).unionByName(beat, allowMissingColumns=True).coalesce(1).write.mode("append").parquet(path)
    return path, events


def stream(spark, parts):
    path, events = parts
    return X.watched(file_stream(spark, path, events.schema, max_files=1), "13 days")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_asof(spark, parts, tmp_path):
    side = F.when(F.col("source") == "click", 1).otherwise(0).alias("side")
    sides = stream(spark, parts).where("source IN ('click', 'view')").select("pv_name", "ts", "ts_us", "seq", "value", side)
    got = X.drain(XF.asof_stream(sides), str(tmp_path / "out"))
    halves = [parts[1].where(F.col("source") == s).select("pv_name", "ts_us", "seq", "value") for s in ("click", "view")]
    want = L.merge_additional(*halves, width=0)
    want = want.select("pv_name", "ts_us", "seq", "value", "matched.ts_us", "matched.seq", "matched.value")
    assert rows(got) == rows(want)


def test_refcount(spark, parts, tmp_path):
    def changes(df, *also):
        delta = F.when(F.col("source") == "click", 1).otherwise(-1).cast("bigint").alias("delta")
        return df.where("source IN ('click', 'view')").select("pv_name", *also, "ts_us", "seq", delta)

    got = X.drain(XF.refcount_stream(changes(stream(spark, parts), "ts")), str(tmp_path / "out"))
    want = R.reference_counts(changes(parts[1]), width=0)
    assert rows(got) == rows(want.select(got.columns))


def test_purge(spark, parts, tmp_path):
    def scans(df, *also):
        consumers = F.when(F.col("source") == "view", 1).otherwise(0).cast("bigint").alias("consumers")
        return df.select("pv_name", *also, "ts_us", "seq", consumers)

    got = X.drain(XF.purge_stream(scans(stream(spark, parts), "ts"), T.DAY_US), str(tmp_path / "out"))
    want = R.purge(scans(parts[1]), ["pv_name"], T.DAY_US, width=0)
    assert rows(got) == rows(want.select(got.columns))


def test_normal(spark, parts, sf_dir, tmp_path):
    """All windows up to the stop, the first and the last included."""
    members = T.sparse_members(spark, sf_dir)
    data = stream(spark, parts).where("event_type = 'Data'")
    got = X.drain(XS.normal_stream(snap.route(data, members)), str(tmp_path / "out")).drop("to_us")
    events = parts[1].where("event_type = 'Data'").drop("event_type", "source", "ts")
    assert rows(got) == rows(snap.normal(events, members).select(got.columns))


def test_late_rows_are_dropped_openly(spark, parts, sf_dir, tmp_path):
    """With a delay shorter than the disorder windows that were emitted stay as they were, each once."""
    path, events = parts
    short = X.watched(file_stream(spark, path, events.schema, max_files=1), "1 day").where("event_type = 'Data'")
    members = T.sparse_members(spark, sf_dir)
    got = X.drain(XS.normal_stream(snap.route(short, members)), str(tmp_path / "out"))
    keys = ["queue_name", "start_us", "pv_name", "iter_index"]
    assert got.count() == got.select(keys).distinct().count() > 0
    full = snap.normal(events.where("event_type = 'Data'").drop("event_type", "source", "ts"), members)
    assert got.select(keys).join(full.select(keys), keys, "left_anti").count() == 0


def test_deduplicates(spark, sf_dir, tmp_path):
    events = T.as_sparse(T.timed(T.table(spark, sf_dir, "events")))
    path = str(tmp_path / "in")
    for _ in range(2):
        events.coalesce(1).write.mode("append").parquet(path)
    once = X.watched(file_stream(spark, path, events.schema), "60 days", unique="seq")
    assert X.drain(once, str(tmp_path / "out")).count() == events.count()
