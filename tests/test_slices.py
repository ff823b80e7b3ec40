"""Sliced scans and salted joins give what the plain plans give, also with a hot key."""

import pytest
from pyspark.sql import functions as F

from pvflow.operators import asof, joins, ordered
from pvflow.operators import registry as R
from pvflow.operators import snapshots as snap
from pvflow.sources import tables as T

WIDTHS = [1_000, 86_400_000_000, 7 * 86_400_000_000]


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows belong to one key, some at the same time."""
    return spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"),
        (F.floor(F.col("id") * 7919 % 1000) * 500 - 200_000).cast("bigint").alias("t"),
        F.col("id").alias("seq"),
        F.when(F.hash("id") % 4 == 0, F.col("id")).alias("v"),
        (F.hash("id") % 3).cast("bigint").alias("d"),
    ).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("width", [700, 50_000, 10_000_000])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("backward", [False, True])
def test_carry(hot, width, strict, backward):
    args = dict(strict=strict, backward=backward)
    plain = ordered.carry(hot, ["k"], "t", ["seq"], F.col("v"), "out", width=0, **args)
    sliced = ordered.carry(hot, ["k"], "t", ["seq"], F.col("v"), "out", width=width, **args)
    assert rows(plain) == rows(sliced.select(plain.columns))


@pytest.mark.parametrize("width", [700, 50_000])
@pytest.mark.parametrize("backward", [False, True])
def test_running_sum(hot, width, backward):
    plain = ordered.running_sum(hot, ["k"], "t", ["seq"], F.col("d"), "out", width=0, backward=backward)
    sliced = ordered.running_sum(hot, ["k"], "t", ["seq"], F.col("d"), "out", width=width, backward=backward)
    assert rows(plain) == rows(sliced.select(plain.columns))


@pytest.mark.parametrize("width", [700, 50_000])
def test_running_low(hot, width):
    plain = ordered.running_low(hot, ["k"], "t", ["seq"], F.col("d"), "s", "m", width=0)
    sliced = ordered.running_low(hot, ["k"], "t", ["seq"], F.col("d"), "s", "m", width=width)
    assert rows(plain) == rows(sliced.select(plain.columns))


def test_refcount_is_the_clamped_walk(hot):
    changes = hot.select(F.col("k").cast("string").alias("pv_name"), F.col("t").alias("ts_us"), "seq", F.when(F.col("d") == 0, 1).otherwise(-1).cast("bigint").alias("delta"))
    got = {r.seq: r.users for r in R.reference_counts(changes, width=50_000).collect()}
    users = {}
    for r in sorted(changes.collect(), key=lambda r: (r.ts_us, r.seq)):
        users[r.pv_name] = max(0, users.get(r.pv_name, 0) + r.delta)
        assert got[r.seq] == users[r.pv_name]


def test_slice_width_bounds_rows(hot):
    width = ordered.slice_width(hot, "t", target_rows=100, cell=1_000)
    assert width > 0
    biggest = hot.groupBy(F.floor(F.col("t") / width)).count().agg(F.max("count")).first()[0]
    assert biggest <= 200
    assert ordered.slice_width(hot, "t") == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_anti", "left_semi"])
def test_salted_join(hot, how, spark):
    small = spark.range(25).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).union(spark.sql("SELECT 0L, 7L"))
    plain = hot.join(small, ["k"], how)
    salted = joins.lookup_join(hot, small, ["k"], how, max_rows=0, salts=5)
    assert rows(plain) == rows(salted.select(plain.columns))


@pytest.mark.parametrize("width", WIDTHS)
def test_asof(spark, sf_dir, width):
    events = T.sparse_events(spark, sf_dir)
    left, right = events.where("source = 'click'"), events.where("source = 'view'")
    plain = asof.asof_join(left, right, ["pv_name"], width=0, keep_unmatched=True)
    sliced = asof.asof_join(left, right, ["pv_name"], width=width, keep_unmatched=True)
    assert rows(plain) == rows(sliced)


def test_triggered_snapshots(spark, sf_dir):
    events, members = T.dense_events(spark, sf_dir), T.members(T.dense_definitions(spark, sf_dir))
    names = T.dense_definitions(spark, sf_dir).select("def_id", "queue_name")
    triggers = T.dense_triggers(spark, sf_dir).join(names, "def_id").drop("def_id")
    plan = snap.plan_triggers(events, members, triggers)
    for operator in (snap.triggered_buffered, snap.triggered_normal):
        plain = operator(events, members, triggers, plan=plan)
        sliced = operator(events, members, triggers, plan=plan._replace(width=86_400_000_000))
        assert rows(plain) == rows(sliced.select(plain.columns))


def test_once_sliced(spark, sf_dir):
    events = T.sparse_events(spark, sf_dir).where("event_type = 'Data'")
    requests = spark.createDataFrame(
        [(i, "t", f"r{i}", T.START_US + i * 3 * T.DAY_US // 2, 3_600_000 * 12, [f"pva://user:{i % 15}", "ca://user:3.HIHI", "nope"][: 2 + i % 2]) for i in range(20)],
        "request_id long, reply_topic string, reply_id string, request_us long, time_window_msec long, pv_name_list array<string>",
    )
    plain = snap.once(events, requests, width=0)
    assert rows(plain) == rows(snap.once(events, requests, width=86_400_000_000 * 2))


def test_explode_range(spark):
    df = spark.createDataFrame([(1, 3, 12), (2, 5, 4), (3, -2, 0)], "id int, a long, b long")
    got = ordered.explode_range(df, F.col("a"), F.col("b"), "i", block=4)
    assert rows(got.select("id", "i")) == sorted([(1, i) for i in range(3, 13)] + [(3, i) for i in (-2, -1, 0)], key=str)


def test_long_runs_use_iteration_slices(spark, sf_dir, monkeypatch):
    events = T.sparse_events(spark, sf_dir).where("event_type = 'Data'").drop("event_type", "source")
    members = T.sparse_members(spark, sf_dir)
    plain = rows(snap.normal(events, members))
    monkeypatch.setattr(snap, "TARGET_ROWS", 4)
    assert plain == rows(snap.normal(events, members))
