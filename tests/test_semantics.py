"""Small cases with expected results written out."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from pvflow.functions import msgpack as M
from pvflow.functions import names as N
from pvflow.functions import nested as NV
from pvflow.functions import packing as PK
from pvflow.operators import commands as C
from pvflow.operators import encode as E
from pvflow.operators import intervals as IV
from pvflow.operators import joins as J
from pvflow.operators import latest as L
from pvflow.operators import metrics as MT
from pvflow.operators import registry as R
from pvflow.operators import snapshots as snap
from pvflow.session import work_dir
from pvflow.sources import readers, sinks, topics


@pytest.mark.parametrize(
    "uri, want",
    [
        ("VGXX-L3B-1602-PLOG", None),
        ("pva://VGXX-L3B-1602-PLOG", ("pva", "VGXX-L3B-1602-PLOG", "value", "pva")),
        ("ca://variable:a.HIHI", ("ca", "variable:a", "HIHI", "ca")),
        ("", None),
        ("pva://variable:a.root.field", ("pva", "variable:a", "root.field", "pva")),
        ("pva://channel::a", None),
        ("pv://a", ("pv", "a", "value", "ca")),
    ],
)
def test_pv_uri(spark, uri, want):
    got = spark.createDataFrame([(uri,)], "u string").select(N.pv_parts(F.col("u")).alias("p")).first().p
    assert (tuple(got) if got else None) == want


def decode(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "cmd_seq int, value string").withColumn("ts_us", F.lit(0))
    return {r.cmd_seq: r for r in C.decode(df).collect()}


def test_command_table(spark):
    got = decode(
        spark,
        '{"command":"monitor","pv_name":"a","reply_topic":"t"}',
        '{"command":"monitor","pv_name":"a","reply_topic":"t","monitor_dest_topic":"d","serialization":"JSON"}',
        '{"command":"monitor","pv_name":["a"],"reply_topic":"t"}',
        '{"command":"snapshot","pv_name_list":["a","b","a",4],"reply_topic":"t","reply_id":"i"}',
        '{"command":"strange"}',
        '{"key":"value"}',
        "plain",
        "[1]",
        '{"command":7}',
        '{"command":"put","pv_name":"a","value":"x"}',
        '{"command":"repeating_snapshot","pv_name_list":["a"],"reply_topic":"t","reply_id":"i","time_window_msec":1500.0,"repeat_delay_msec":1.5}',
        '{"command":"snapshot","pv_name_list":[],"reply_topic":"t","reply_id":"i"}',
        "",
    )
    status = [got[i].status for i in range(13)]
    assert status == [
        "valid", "valid", "invalid", "valid", "invalid", "invalid", "corrupt", "corrupt", "fault", "valid", "valid",
        "invalid", "corrupt",
    ]
    assert (got[0].monitor_dest_topic, got[0].serialization) == ("t", "msgpack")
    assert (got[1].monitor_dest_topic, got[1].serialization) == ("d", "json")
    assert sorted(got[3].pv_name_list) == ["a", "b"] and got[3].time_window_msec == 1000
    assert (got[10].time_window_msec, got[10].repeat_delay_msec) == (1500, 0)


@pytest.fixture(scope="module")
def ramp(spark):
    """One event per second: 0..10, then 0 again, and a static PV with one event."""
    rows = [("ramp", s * 1_000_000, s, float(s % 11)) for s in range(40)] + [("static", 500_000, 100, 5.0)]
    return spark.createDataFrame(rows, "pv_name string, ts_us long, seq long, value double")


def members(spark, window_msec=4000, stop=40_000_000, pvs=("ramp", "static")):
    rows = [("q", "Q", 0, stop, window_msec, 0, p) for p in pvs]
    return spark.createDataFrame(
        rows,
        "queue_name string, snapshot_name string, start_us long, stop_us long, time_window_msec long, "
        "sub_push_delay_msec long, pv_name string",
    )


def test_normal_counts(spark, ramp):
    frames = snap.normal_frames(ramp, members(spark)).groupBy("iter_index").count().collect()
    assert {r.iter_index: r["count"] for r in frames} == {i: 4 for i in range(1, 11)}


def test_buffered_has_at_least_five_frames(spark, ramp):
    frames = snap.buffered_frames(ramp, members(spark)).groupBy("iter_index").count().collect()
    assert all(r["count"] >= 5 for r in frames) and len(frames) == 10


def test_partial_last_window(spark):
    last = snap.windows(members(spark, stop=10_000_000)).orderBy(F.desc("iter_index")).first()
    assert (last.iter_index, last.from_us, last.to_us, last.partial) == (3, 8_000_000, 10_000_000, True)


def triggers(spark, *at):
    return spark.createDataFrame([("q", t, i) for i, t in enumerate(at)], "queue_name string, trigger_us long, trigger_seq long")


def test_no_output_until_triggered(spark, ramp):
    assert snap.triggered_buffered(ramp, members(spark), triggers(spark), flush_on_stop=False).count() == 0


def test_triggered_ramp_is_continuous(spark, ramp):
    got = snap.triggered_buffered(ramp, members(spark), triggers(spark, 9_500_000, 30_100_000), flush_on_stop=False)
    by_iter = {}
    for r in got.where("pv_name = 'ramp'").orderBy("ts_us").collect():
        by_iter.setdefault(r.iter_index, []).append(r.value)
    assert sorted(by_iter) == [1, 2]
    for values in by_iter.values():
        assert len(values) == 5  # the window is closed on both ends
        assert all(b == a + 1 or (a, b) == (10.0, 0.0) for a, b in zip(values, values[1:]))


def test_triggered_normal_keeps_values(spark, ramp):
    got = snap.triggered_normal(ramp, members(spark), triggers(spark, 100_000, 600_000, 20_000_000), flush_on_stop=False)
    values = {(r.iter_index, r.pv_name): r.value for r in got.collect()}
    assert values == {(1, "ramp"): 0.0, (2, "ramp"): 0.0, (2, "static"): 5.0, (3, "ramp"): 9.0, (3, "static"): 5.0}


def test_once_counts(spark, ramp):
    ask = "request_id long, reply_topic string, reply_id string, request_us long, time_window_msec long, pv_name_list array<string>"
    request = spark.createDataFrame([(1, "t", "i", 2_500_000, 1000, ["pva://ramp", "ca://static"])], ask)
    got = snap.once(ramp, request, width=0).collect()
    assert sorted(r.error for r in got) == [0, 0, 1]
    assert {r.pv_name: r.seq for r in got if r.error == 0} == {"ramp": 3, "static": 100}


def test_silent_and_forced(spark, ramp):
    silent = snap.silent(ramp, members(spark, pvs=("ramp", "static", "ghost"))).collect()
    assert sum(r.pv_name == "ghost" for r in silent) == 10
    assert sum(r.pv_name == "static" for r in silent) == 9
    forced = snap.forced(ramp, members(spark, pvs=("ramp", "static", "ghost"))).collect()
    assert sorted((r.pv_name, r.iter_index) for r in forced) == [("static", i) for i in (3, 5, 7, 9)]


@pytest.mark.parametrize("asked, window, want", [(250, 1000, 250), (2000, 1000, 1000), (5, 0, 5), (0, 4000, 1000), (0, 500, 500)])
def test_push_delay(spark, asked, window, want):
    df = spark.createDataFrame([(asked, window)], "sub_push_delay_msec long, time_window_msec long")
    assert df.select(snap.push_delay_msec()).first()[0] == want


@pytest.mark.parametrize(
    "consumers, timeout_s, want",
    [
        ([1, 1], 3600, ["clear", "clear"]),
        ([0, 0], 3600, ["mark", "wait"]),
        ([0, 0, 0], 1, ["mark", "stop", "gone"]),
        ([0, 1, 0], 1, ["mark", "clear", "mark"]),
    ],
)
def test_purge(spark, consumers, timeout_s, want):
    rows = [("p", i * 2_000_000, i, c) for i, c in enumerate(consumers)]
    scans = spark.createDataFrame(rows, "pv_name string, ts_us long, seq long, consumers long")
    out = R.purge(scans, ["pv_name"], timeout_s * 1_000_000, width=0).orderBy("seq").collect()
    assert [r.action for r in out] == want


def test_hundred_destinations(spark):
    subs = spark.range(100).selectExpr("id", "'pv' AS pv_name", "concat('dest_', id) AS channel_destination", "1 AS event_serialization", "false AS processed")
    assert R.distinct_pvs(subs).count() == 1
    assert [r.idx for r in R.process_batch(subs).orderBy("idx").collect()] == list(range(100))


VALUES = [
    None, True, False, 0, 127, 128, 255, 256, 65536, 2**32, 2**64 - 1, -1, -32, -33, -129, -(2**31), -(2**63), 1.5, "", "x" * 31,
    "x" * 32, "y" * 300, "z" * 70000, b"ab", [], [1, "a", None], list(range(20)), {}, {"a": {"b": [1.0]}}, {str(i): i for i in range(20)},
]


@pytest.mark.parametrize("value", VALUES, ids=[str(i) for i in range(len(VALUES))])
def test_msgpack_round_trip(value):
    assert M.unpack(M.pack(value)) == value


def test_msgpack_known_bytes():
    assert M.pack({"value": 12}).hex() == "81a576616c75650c"
    assert M.pack([1.5]).hex() == "91cb3ff8000000000000"


TYPED = """flag BOOLEAN, b TINYINT, s SMALLINT, i INT, l BIGINT, u DECIMAL(20,0), f FLOAT, d DOUBLE, t STRING,
  ds ARRAY<DOUBLE>, ss ARRAY<STRING>, n STRUCT<x: INT, y: STRING>, ns ARRAY<STRUCT<x: INT>>, gone INT"""


def test_encode_decode_every_type(spark):
    from decimal import Decimal

    rows = [
        ("pv:1", (True, -3, 300, -70000, 2**40, Decimal(2**63), 1.5, 2.25, "é", [1.0, 2.0], ["a"], (1, "n"), [(1,), (2,)], None)),
        ("pv:2", (False, 0, -1, 0, -1, Decimal(0), 0.0, -0.5, "", [], [], (None, None), [], None)),
    ]
    df = spark.createDataFrame(rows, f"pv_name STRING, data STRUCT<{TYPED.replace(' ', ':', 0)}>".replace("\n", " "))
    packed = E.encode_msgpack(df)
    for r in packed.collect():  # the bytes are those of the plain packer
        data = next(x[1] for x in rows if x[0] == r.pv_name)
        names = [f.name for f in df.schema["data"].dataType.fields]
        plain = dict(zip(names, data)) | {"u": int(data[5]), "n": dict(zip("xy", data[11])), "ns": [{"x": x[0]} for x in data[12]]}
        want = bytearray(M.pack({r.pv_name: plain}))
        at = want.find(b"\xa1f\xcb")  # a float takes four bytes
        want[at + 2 : at + 11] = b"\xca" + struct.pack(">f", data[6])
        assert bytes(r.value) == bytes(want)
    back = E.decode_msgpack(packed.select("value"), TYPED).select("pv_name", "data")
    assert sorted(map(str, df.select("pv_name", "data").collect())) == sorted(map(str, back.collect()))
    compact = E.encode_msgpack(df, compact=True).orderBy("pv_name").collect()
    flat = M.unpack(bytes(compact[0].value))
    assert flat[0] == "pv:1" and flat[-4:] == ["n", 1, 2, None]


def test_struct_merge(spark):
    df = spark.sql("SELECT struct(1 AS a, 2 AS b) AS x, struct(9 AS b, 3 AS c) AS y UNION ALL SELECT struct(1, 2), NULL")
    merged = df.select(NV.merge_fields(df, [("x", ["a", "b"]), ("y", ["b", "c", "missing"])]).alias("m"))
    assert sorted(map(tuple, merged.select("m.*").collect()), key=str) == [(1, 2, None), (1, 9, 3)]


def test_struct_merge_clash(spark):
    df = spark.sql("SELECT struct(1 AS a) AS x, struct(struct(1 AS z) AS a) AS y")
    with pytest.raises(TypeError):
        NV.merge_fields(df, [("x", ["a"]), ("y", ["a"])])


def test_metrics_text(spark):
    lines = ['name{k="v",k2="v2"} 10', "name 1.5e3", "# HELP x", "", "bad line"]
    got = MT.parse_text(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert sorted((r.name, r.value, tuple(sorted(r.labels.items()))) for r in got) == [
        ("name", "1.5e3", ()),
        ("name", "10", (("k", "v"), ("k2", "v2"))),
    ]


def test_counter_reset(spark):
    rows = [("c", i, i, v) for i, v in enumerate([5, 7, 7, 2, 4])]
    samples = spark.createDataFrame(rows, "name string, ts_us long, seq long, value long")
    assert MT.counter_totals(samples, ["name"], width=0).first().total == 9


def test_empty_inputs(spark, ramp):
    none = ramp.where("false")
    assert snap.normal(none, members(spark)).count() == 0
    assert snap.normal(ramp, members(spark).where("false")).count() == 0
    assert snap.buffered_frames(none, members(spark)).count() == 20
    assert L.last_value(none).count() == 0
    assert snap.triggered_normal(none, members(spark), triggers(spark, 5)).count() == 0


def test_repeated_header_keys_do_not_end_the_job(spark):
    rows = [(b"k", b"v", [("a", b"1"), ("a", b"2"), (None, b"3")]), (None, b"w", None)]
    kind = "key binary, value binary, headers array<struct<key:string,value:binary>>"
    got = [r.headers for r in readers.normalize(spark.createDataFrame(rows, kind)).collect()]
    assert got == [{"a": "1"}, {}]


def test_repeated_labels_keep_the_last(spark):
    line = spark.createDataFrame([('up{pv="a",pv="b",op="get"} 3',)], "line string")
    assert MT.parse_text(line).first().labels == {"pv": "b", "op": "get"}


def test_leaves_of_null_struct_arrays(spark):
    kind = "id int, data struct<a:int,list:array<struct<x:int,inner:array<struct<y:int>>>>,b:string>"
    rows = [(1, (5, None, "t")), (2, (6, [], "u")), (3, (7, [(1, None), (2, [(9,), None])], None)), (4, None)]
    df = spark.createDataFrame(rows, kind)
    got = df.select("id", F.inline(NV.leaves(F.col("data"), NV.struct_type(df, "data")))).collect()
    by = {i: {r.path: r.value for r in got if r.id == i} for i in (1, 2, 3)}
    assert by[1] == {"a": "5", "b": "t"} and by[2] == {"a": "6", "b": "u"}
    assert by[3]["list[0].x"] == "1" and by[3]["list[1].inner[0].y"] == "9" and by[3]["b"] is None


def test_hostile_and_tagged_payloads(spark):
    deep = b"\x91" * 100_000 + b"\xc0"
    tagged = [b"\x81\xa1v" + x for x in (b"\xd4\x01\xff", b"\xd8\x01" + b"z" * 16, b"\xc7\x03\x05abc", b"\xc8\x00\x01\x05a")]
    rows = [(deep,), (b"\x81\xa1v\xc7\x09\x05abc",), *[(t,) for t in tagged]]
    got = spark.createDataFrame(rows, "b binary").select(PK.msgpack_kind(F.col("b")).alias("k")).collect()
    assert [r.k for r in got] == ["other", "bad", "map", "map", "map", "map"]
    body = M.pack({"pv": {"raw": b"\x00\x01", "n": 4}})
    decoded = E.decode_msgpack(spark.createDataFrame([(body,), (deep,)], "value binary"), "raw binary, n int").collect()
    assert [(r.pv_name, r.data and bytes(r.data.raw), r.data and r.data.n) for r in decoded] == [("pv", b"\x00\x01", 4), (None, None, None)]


def test_changes_apply_column_by_column(spark):
    base = spark.createDataFrame([(p, "d", False, -1) for p in "abcd"], "pv_name string, channel_destination string, processed boolean, start_purge_ts long")
    rows = [("a", "d", 1, None, True, None), ("a", "d", 2, None, None, 50), ("b", "d", 1, True, None, None), ("b", "d", 2, None, True, None)]
    rows += [("c", "d", 1, None, True, 3), ("c", "d", 2, False, False, None)]
    kind = "pv_name string, channel_destination string, change_seq long, deleted boolean, processed boolean, start_purge_ts long"
    got = {r.pv_name: (r.processed, r.start_purge_ts) for r in R.merge_changes(base, spark.createDataFrame(rows, kind)).collect()}
    assert got == {"a": (True, 50), "c": (False, 3), "d": (False, -1)}


def test_documents_do_not_follow_the_data_size(spark):
    rows = spark.range(60_000).selectExpr("concat('pv:', id) AS pv_name", "'d' AS channel_destination", "1 AS event_serialization", "'n' AS node")
    one = R.dump_documents(rows, ["node"])
    assert one.columns == ["node", "document"] and one.count() == 1
    several = R.dump_documents(rows, ["node"], 3)
    assert several.count() == 3 and R.load_documents(several).count() == 60_000


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(spark.sparkContext.getConf)

    class Session:
        conf, sparkContext = spark.conf, Context()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError):
            work_dir(Session(), "x")


def test_open_runs_go_on_to_the_newest_event(spark, ramp):
    """A run without a stop gives what a run gives that stops at the end of the last window the newest event has passed."""
    newest = ramp.agg(F.max("ts_us")).first()[0]
    assert newest % 4_000_000
    by_window = (snap.normal, snap.silent, snap.normal_frames, snap.buffered_frames, snap.forced)
    for operator in (*by_window, snap.buffered, snap.route):
        stopped = members(spark, stop=newest // 4_000_000 * 4_000_000 if operator in by_window else newest + 1)
        still = stopped.withColumn("stop_us", F.lit(None).cast("bigint"))
        want = operator(ramp, stopped).drop("stop_us")
        got = operator(ramp, still).select(want.columns)
        assert want.count() > 0 or operator is snap.forced
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), operator
    stopped = members(spark, stop=newest + 1)
    still = stopped.withColumn("stop_us", F.lit(None).cast("bigint"))
    fired = triggers(spark, 10, 25)
    for operator in (snap.triggered_buffered, snap.triggered_normal):
        want = operator(ramp, stopped, fired, flush_on_stop=False).drop("stop_us")
        got = operator(ramp, still, fired).select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_an_open_run_before_any_event_has_no_window(spark, ramp):
    late = members(spark).withColumn("start_us", F.lit(10**9)).withColumn("stop_us", F.lit(None).cast("bigint"))
    assert snap.normal_frames(ramp, late).count() == 0 and snap.buffered_frames(ramp.where("false"), late).count() == 0


@pytest.mark.parametrize("value", [v for v in VALUES if not isinstance(v, (dict, list, type(None)))], ids=str)
def test_column_packer_equals_plain_packer(spark, value):
    kinds = {bool: "boolean", int: "decimal(20,0)" if isinstance(value, int) and value >= 2**63 else "bigint", float: "double", str: "string", bytes: "binary"}
    from decimal import Decimal

    kind = kinds[type(value)]
    df = spark.createDataFrame([(Decimal(value) if kind.startswith("decimal") else value, None), (None, None)], f"v {kind}, w {kind}")
    got = df.select(PK.pack(F.col("v"), df.schema["v"].dataType).alias("b")).collect()
    assert [bytes(r.b) for r in got] == [M.pack(value), b"\xc0"]
    df = df.select(F.struct(F.array("v", "w").alias("list"), F.create_map(F.lit("k"), "v").alias("map")).alias("s"))
    got = df.select(PK.pack(F.col("s"), df.schema["s"].dataType).alias("b")).first()
    assert bytes(got.b) == M.pack({"list": [value, None], "map": {"k": value}})


def test_structure_scan_agrees_with_the_reader(spark):
    rng = random.Random(4)
    bodies = [M.pack(v) for v in VALUES] + [M.pack({"a": [1, {"b": VALUES[-3]}], "c": list(range(70000))})]
    cases = bodies + [b[: rng.randrange(len(b))] for b in bodies] + [b"\xc1", b"", b"\xdf\xff\xff\xff\xff", b"\xdc\x00\x02\x01"]
    cases = [c for c in cases if len(c) < 2000]

    def kind(b):
        try:
            return "map" if isinstance(M.unpack(b), dict) else "other"
        except (ValueError, struct.error):
            return "bad"

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, b binary")
    got = {r.i: r.k for r in df.select("i", PK.msgpack_kind(F.col("b")).alias("k")).collect()}
    assert got == {i: kind(c) for i, c in enumerate(cases)}


def test_decoder_tells_what_does_not_fit(spark):
    kind = "v INT, s STRUCT<x: DOUBLE>, l ARRAY<INT>, u STRUCT<_tag: STRING, a: INT, b: STRING>, us ARRAY<STRUCT<_tag: STRING, a: INT, b: STRING>>"
    good = {"v": 1, "s": {"x": 2, "more": [1]}, "l": [1, 2], "u": {"b": "t"}, "us": [{"a": 1}, 5, {"c": 1}, {"b": "z", "a": 1}, {"b": "e"}], "x": {}}
    bodies = [
        M.pack({"reply_id": "r", "pv": good}),
        M.pack({"pv": {"v": "text"}}),
        M.pack({"pv": {"v": 2**40, "l": [1]}}),
        M.pack({"pv": {"v": 7, "s": 3, "l": 4, "u": {"c": 1}}}),
        M.pack({"pv": good})[:-9],
        M.pack([1]),
        None,
        M.pack({"pv": {"v": None, "l": [1, None]}}),
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, value binary").coalesce(1)
    got = {r.i: r for r in E.decode_msgpack(df, kind).collect()}
    assert [got[i].error is None for i in range(8)] == [True, False, False, True, False, False, False, True]
    assert [got[i].data is None for i in range(8)] == [False, True, True, False, True, True, True, False]
    d = got[0].data
    assert (d.v, d.s.x, d.l, d.u._tag, d.u.a, d.u.b) == (1, 2.0, [1, 2], "b", None, "t") and [(u._tag, u.a, u.b) for u in d.us] == [("a", 1, None), ("b", None, "e")]
    d = got[3].data
    assert (d.v, d.s.x, d.l, d.u) == (7, None, [], None)
    assert got[7].data.l == [1, None] and "int" in got[1].error


def test_union_round_trip_and_other_forms(spark):
    kind = PK.union_type(a="INT", b="STRING", c="STRUCT<x: DOUBLE>")
    rows = [(1, (("a", 99, None, None), [("a", 1, None, None), ("b", None, "test", None)])), (2, (("c", None, None, (1.5,)), [])), (3, (None, None))]
    text = kind.simpleString()
    df = spark.createDataFrame(rows, f"seq int, data struct<value:{text},list:array<{text}>>").withColumn("pv_name", F.lit("pv"))
    packed = E.encode_msgpack(df)
    assert bytes(packed.where("seq = 1").first().value) == M.pack({"pv": {"value": {"a": 99}, "list": [{"a": 1}, {"b": "test"}]}})
    back = E.decode_msgpack(packed, df.schema["data"].dataType)
    assert sorted(map(str, back.select("seq", "data").collect())) == sorted(map(str, df.select("seq", "data").collect()))
    as_json = df.select("seq", E.encode_json(F.col("pv_name"), E.encode_union(F.col("data"), df.schema["data"].dataType)).alias("j"))
    assert {r.seq: r.j for r in as_json.collect()} == {1: '{"pv":{"value":"99"}}', 2: '{"pv":{"value":"{\\"x\\":1.5}"}}', 3: '{"pv":{}}'}
    assert bytes(E.encode_msgpack(df, compact=True).where("seq = 1").first().value) == M.pack(["pv"])


def test_interval_join_equals_nested_loops(spark):
    rng = random.Random(1)
    points = [(rng.choice("ab"), rng.randrange(5000), i) for i in range(800)] + [("c", 5, 900), ("a", None, 901), (None, 5, 902)]
    spans = []
    for i in range(90):
        start = rng.randrange(5000)
        spans.append((rng.choice("ab"), start, rng.choice([None, start, start + rng.choice([1, 5, 50, 3000])]), i))
    spans += [("z", 0, None, 200), (None, 0, None, 201)]
    left = spark.createDataFrame(points, "k string, ts_us long, seq long")
    right = spark.createDataFrame(spans, "k string, start_us long, stop_us long, run int")
    want = sorted((q, r) for k, t, q in points for of, a, b, r in spans if k == of and k and t is not None and a <= t and (b is None or t < b))
    for width in (1, 7, 300, 10**6, IV.interval_width(right, "start_us", "stop_us")):
        got = IV.interval_join(left, right, ["k"], width=width)
        assert sorted((r.seq, r.run) for r in got.collect()) == want, width
    assert IV.interval_join(left.where("false"), right, ["k"], width=5).count() == 0
    assert IV.interval_join(left, right.where("false"), ["k"], width=5).count() == 0


def test_hot_keys_alone_are_salted(spark):
    big = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    small = spark.range(500).selectExpr("id AS k", "id * 2 AS w")
    assert len(J.hot_keys(big, ["k"])) == 1 and J.hot_keys(spark.range(30_000).selectExpr("id AS k"), ["k"]) == []
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = big.join(small, "k", how)
        got = J.lookup_join(big, small, ["k"], how, max_rows=0, salts=5).select(want.columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    wide = small.withColumn("text", F.repeat(F.lit("x"), 1000))
    assert J.measured(wide).bytes > 500_000 and J.measured(wide).rows == 500


def test_commands_to_frames(spark, ramp):
    """Start, trigger and stop, restarts and runs still open, of all four kinds."""
    at = lambda s: s * 1_000_000
    rows = [("q1", at(2), 1, "start", "Normal", False), ("q1", at(11), 2, "stop", None, None), ("q1", at(20), 3, "start", "Normal", False),
            ("q2", at(0), 4, "start", "TimedBuffered", False), ("q2", at(6), 5, "stop", None, None),
            ("q3", at(1), 6, "start", "Normal", True), ("q3", at(5), 7, "trigger", None, None), ("q3", at(9), 8, "stop", None, None),
            ("q3", at(10), 9, "trigger", None, None), ("q4", at(3), 10, "start", "TimedBuffered", True), ("q4", at(8), 11, "trigger", None, None)]
    kind = "queue_name string, ts_us long, seq long, kind string, snapshot_type string, triggered boolean"
    commands = spark.createDataFrame(rows, kind).withColumns(
        {
            "snapshot_name": F.upper("queue_name"), "start_error": F.lit(0), "start_message": F.lit("ok"), "time_window_msec": F.lit(4000).cast("bigint"),
            "sub_push_delay_msec": F.lit(0).cast("bigint"), "serialization": F.lit("json"), "pv_name_list": F.array(F.lit("pva://ramp"), F.lit("ca://ramp.HIHI")),
        }
    )
    replies = snap.lifecycle(commands, width=0).cache()
    told = {r.seq: (r.outcome, r.message, r.publishing_topic) for r in snap.lifecycle_replies(replies).collect()}
    assert told[1] == ("started", "ok", "q1") and told[2] == ("stopped", "Snapshot 'Q1' has been stopped", "") and told[9][1] == "Snapshot 'Q3' has not been found"
    out = snap.command_frames(ramp, replies, save=sinks.saved, width=0).collect()
    data = lambda q: sorted((r.start_us // 10**6, r.iter_index, r.seq) for r in out if r.queue_name == q and r.message_type == 1)
    ends = lambda q: sorted((r.start_us // 10**6, r.iter_index) for r in out if r.queue_name == q and r.message_type == 2)
    # 2-6-10-(11), then 20-24-..-36: the newest event is at 39, so the window up to 40 is not finished
    assert data("q1") == [(2, 1, 5), (2, 2, 9), (2, 3, 10), (20, 1, 23), (20, 2, 27), (20, 3, 31), (20, 4, 35)]
    assert ends("q1") == [(2, 1), (2, 2), (2, 3), (20, 1), (20, 2), (20, 3), (20, 4)]
    assert data("q2") == [(0, 1, s) for s in range(4)] + [(0, 2, s) for s in (4, 5)]
    assert data("q3") == [(1, 1, 5), (1, 2, 8)] and ends("q3") == [(1, 1), (1, 2)]
    assert data("q4") == [(3, 1, s) for s in range(4, 9)] and ends("q4") == [(3, 1)]


def test_topic_log(spark, tmp_path):
    """Positions without gaps over batches; repeated batches and half-written ones leave nothing."""
    path, schema = str(tmp_path / "log"), "n int, v string"
    rng = random.Random(3)
    batches = [[(rng.choice("aab"), rng.randrange(1000) * 10 + i % 10, f"{b}-{i}") for i in range(200)] for b in range(3)]
    frame = lambda rows: spark.createDataFrame(rows, "topic string, n int, v string").repartition(4)
    for b, rows in enumerate(batches):
        topics.append(frame(rows), path, ["n", "v"], b)
        topics.append(frame(rows), path, ["n", "v"], b)  # a repeated batch
    frame(batches[0]).withColumn("_place", F.lit(1)).write.partitionBy("topic").parquet(f"{path}/data/batch=3/attempt=lost")
    topics.append(frame([]), path, ["n", "v"], 4)
    topics.append(frame([(None, 1, "nowhere")]), path, ["n", "v"], 5)
    got = sorted((r.topic, r.ord, r.n, r.v) for r in topics.read(spark, path, schema).collect())
    want = []
    for topic in "ab":
        lines = [x for rows in batches for x in sorted((n, v) for t, n, v in rows if t == topic)]
        want += [(topic, i, n, v) for i, (n, v) in enumerate(lines)]
    assert got == want
