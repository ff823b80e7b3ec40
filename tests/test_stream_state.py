"""Keyed operators of streams against plain loops, and how many state calls they make; no stream runs here."""

import random

import pandas as pd
import pytest

from pvflow.plans import all as _  # noqa: F401  (the catalogue in its order)
from pvflow.plans import streams as P
from pvflow.sources import tables as T
from pvflow.streaming import forced as XD
from pvflow.streaming import replies as XR
from pvflow.streaming import snapshots as XS
from pvflow.streaming import stateful as XF

HOUR_MS = 3_600_000


class Handle:
    """State of one bucket, which counts its calls."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getListState(self, name, schema):
        handle, held = self, []

        class State:
            def get(self):
                handle.calls += 1
                return iter(held)

            def appendList(self, rows):
                handle.calls += 1
                held.extend(rows)

            def put(self, rows):
                handle.calls += 1
                held[:] = rows

            def clear(self):
                handle.calls += 1
                held.clear()

        return State()

    def listTimers(self):
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Clock:
    def __init__(self, passed):
        self.passed = passed

    def getCurrentWatermarkInMs(self):
        return self.passed


def drive(processor, rows, cuts, marks):
    """Rows in batches, with the watermark of each; the output as sorted tuples and the most calls of a batch."""
    handle, out, most = Handle(), [], 0
    processor.init(handle)
    for part, passed in [*zip(cuts, marks), ([], marks[-1])]:
        before, clock = handle.calls, Clock(passed)
        batch = rows.iloc[part]
        if len(batch):
            out += processor.handleInputRows((0,), iter([batch]), clock)
        for at in sorted(t for t in handle.timers if t <= passed):
            out += processor.handleExpiredTimer((0,), clock, None)
            handle.timers.discard(at)
        most = max(most, handle.calls - before)
    got = pd.concat(out) if out else pd.DataFrame(columns=processor.output)
    plain = [tuple(None if v is None or v != v else v for v in r) for r in got[processor.output].itertuples(index=False, name=None)]
    return sorted(plain, key=str), most


def shuffled(n, pvs, seed, span_ms=100 * HOUR_MS):
    """Events in three batches of any order, the watermark just behind the oldest row still to come."""
    r = random.Random(seed)
    ts = [r.randrange(span_ms) * 1000 for _ in range(n)]
    rows = pd.DataFrame({"pv_name": [f"p{r.randrange(pvs)}" for _ in ts], "ts_us": ts, "seq": range(n), "value": [float(r.randrange(50)) for _ in ts]})
    third = [int(t // 1000 * 3 // span_ms) for t in ts]
    cuts = [[i for i in range(n) if third[i] == k] for k in range(3)]
    for cut in cuts:
        r.shuffle(cut)
    return rows, cuts, [0, span_ms // 3, span_ms * 2 // 3, 10 * span_ms], r


def by_pv(rows, order=("ts_us", "seq")):
    return [(pv, list(part.sort_values(list(order)).itertuples(index=False))) for pv, part in rows.groupby("pv_name")]


@pytest.mark.parametrize("pvs", [1, 7, 3000])
def test_asof_and_calls(pvs):
    rows, cuts, marks, r = shuffled(6000, pvs, pvs)
    rows["side"] = [r.randrange(2) for _ in range(len(rows))]
    want = []
    for pv, events in by_pv(rows, ("ts_us", "side", "seq")):
        last = None
        for e in events:
            if e.side == 0:
                last = e
            elif last:
                want.append((pv, e.ts_us, e.seq, e.value, last.ts_us, last.seq, last.value))
    got, calls = drive(XF.AsOf(), rows, cuts, marks)
    assert got == sorted(want, key=str) and calls <= 12


def test_references():
    rows, cuts, marks, r = shuffled(6000, 900, 2)
    rows["delta"] = [r.choice([1, -1, -1]) for _ in range(len(rows))]
    want = []
    for pv, events in by_pv(rows):
        n = 0
        for e in events:
            n = max(0, n + e.delta)
            want.append((pv, e.ts_us, e.seq, n, n > 0))
    got, calls = drive(XF.References(), rows, cuts, marks)
    assert got == sorted(want, key=str) and calls <= 12


@pytest.mark.parametrize("pvs", [1, 40, 900])
def test_retirement(pvs):
    rows, cuts, marks, r = shuffled(4000, pvs, pvs)
    rows["consumers"] = [r.choice([0, 0, 0, 0, 2]) for _ in range(len(rows))]
    timeout, want = 8 * HOUR_MS * 1000 // max(1, 900 // pvs // 20), []
    for pv, events in by_pv(rows):
        since, stopped = None, False
        for e in events:
            if e.consumers > 0:
                since, stopped, action = None, False, "clear"
            elif since is None:
                since, action = e.ts_us, "mark"
            elif stopped:
                action = "gone"
            elif e.ts_us - since > timeout:
                stopped, action = True, "stop"
            else:
                action = "wait"
            want.append((pv, e.ts_us, e.consumers, action))
    got, calls = drive(XF.Retirement(timeout), rows, cuts, marks)
    assert got == sorted(want, key=str) and calls <= 12
    assert {w[-1] for w in want} == {"clear", "mark", "wait", "stop", "gone"}


@pytest.mark.parametrize("buffered", [True, False])
def test_triggered(buffered):
    rows, cuts, marks, r = shuffled(3000, 9, 4)
    window = 2 * HOUR_MS * 1000
    rows["side"] = [int(r.randrange(20) == 0) for _ in range(len(rows))]
    rows = rows.assign(queue_name="q", start_us=0, window_us=window)
    held, n, want = [], 0, []
    for e in rows.sort_values(["ts_us", "side", "seq"]).itertuples(index=False):
        if e.side == 0:
            held.append((e.pv_name, e.ts_us, e.seq, e.value))
            continue
        n += 1
        held = [h for h in held if h[1] >= held[-1][1] - window] if buffered else list({h[0]: h for h in held}.values())
        want += [("q", 0, n, e.ts_us, *h) for h in held]
        held = [] if buffered else held
    got, calls = drive(XF.Triggered(buffered), rows, cuts, marks)
    assert got == sorted(want, key=str) and calls <= 12


@pytest.mark.parametrize("pvs", [1, 300])
def test_window_ends(pvs):
    """Carried and forced values; a run of 95 hours with windows of 4, the last one cut short, and one without a stop."""
    rows, cuts, marks, _ = shuffled(600, pvs, pvs, 90 * HOUR_MS)
    marks[-1] = 130 * HOUR_MS
    window = 4 * HOUR_MS * 1000
    for stop in (95 * HOUR_MS * 1000, 2**62):
        routed = rows.assign(queue_name="q", start_us=0, window_us=window, stop_us=stop, iter_index=rows["ts_us"] // window + 1)
        carried, fed = [], []
        for pv, events in by_pv(routed):
            own, last, before = {e.iter_index: e for e in events}, None, False
            for i in range(1, 10**9):
                end = min(i * window, stop)
                if end > marks[-1] * 1000:
                    break
                last = own.get(i, last)
                if last:
                    carried.append(("q", 0, pv, i, end, last.ts_us, last.seq, last.value))
                    before = i not in own and not before
                    if before and end < stop:
                        fed.append(("q", 0, pv, i + 1, last.ts_us, last.seq, last.value))
                if end >= stop:
                    break
        got, calls = drive(XS.Carried(), routed, cuts, marks)
        assert got == sorted(carried, key=str) and calls <= 12
        got, calls = drive(XD.Silence(), routed, cuts, marks)
        assert got == sorted(fed, key=str) and calls <= 12


def test_answers():
    """The first event from the command's time up to the bound, both included; commands without a PV too, copies once."""
    rows, cuts, marks, r = shuffled(3000, 40, 6)
    wait = 3 * HOUR_MS * 1000
    events = rows.assign(name=rows["pv_name"], side=1, until_us=0, event_type="Data", reply=None)
    asked = [i for i in range(len(rows)) if r.randrange(5) == 0]
    commands = events.iloc[asked].assign(side=0, until_us=rows["ts_us"].iloc[asked] + wait, event_type=None, value=None, reply="x")
    commands["name"] = [r.choice([n, n, "", "none"]) for n in commands["name"]]
    both = pd.concat([events, commands, commands.iloc[:50]], ignore_index=True)
    third = [int(t // 1000 * 3 // (100 * HOUR_MS)) for t in both["ts_us"]]
    cuts = [[i for i, t in enumerate(third) if t == k] for k in range(3)]
    want = []
    for c in commands.itertuples(index=False):
        seen = [e for e in rows.itertuples(index=False) if e.pv_name == c.name and c.ts_us <= e.ts_us <= c.until_us]
        hit = min(seen, key=lambda e: (e.ts_us, e.seq), default=None)
        want.append((c.name, c.seq, hit is not None, hit and hit.ts_us))
    waiting = "name string, ts_us long, side int, seq long, until_us long, event_type string, value double, reply string"
    answers = XR.Answers(wait, waiting, ["name", "cmd_seq", "met", "hit_ts_us"])
    got, calls = drive(answers, both, cuts, marks)
    assert sorted([(*g[:3], g[3] if g[2] else None) for g in got], key=str) == sorted(want, key=str) and calls <= 12


def test_late_rows_and_heartbeats():
    rows = pd.DataFrame({"pv_name": ["a", "a", "", None], "ts_us": [5_000_000, 9_000_000, 9_000_000, 9_000_000], "seq": [1, 2, 3, 4], "delta": [1, 1, 1, 1]})
    got, _ = drive(XF.References(), rows, [[0, 1, 2, 3]], [6000, 20_000][:1])
    assert got == []  # one is late, one waits, two are heartbeats
    got, _ = drive(XF.References(), rows, [[0, 1, 2, 3], []], [6000, 20_000])
    assert got == [("a", 9_000_000, 2, 1, True)]


def test_batches_do_not_grow_with_files(spark, sf_dir, monkeypatch):
    """Parts of many files are still one batch each."""
    monkeypatch.setattr(P, "FILE_ROWS", 7)
    events = T.as_sparse(T.timed(T.table(spark, sf_dir, "events"))).repartition(16)
    path = P.work_dir(spark, "counted")
    stream = P._scattered(spark, events, "many-files", files=3)
    query = stream.writeStream.format("parquet").trigger(availableNow=True).option("checkpointLocation", f"{path}-c").start(path)
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) <= 4
    assert spark.read.parquet(path).where("pv_name != ''").count() == events.count()


def test_pushes_and_last_values_keep_no_python_state(spark, sf_dir):
    from pvflow.operators import snapshots as snap

    dense = T.as_dense(T.timed(T.table_stream(spark, sf_dir, "events"))).withWatermark("ts", "1 hour")
    routed = snap.route(dense, T.members(T.dense_definitions(spark, sf_dir)))
    for stream in (XD.push_stream(routed), XS.window_last(routed)):
        plan = stream._jdf.queryExecution().analyzed().toString()
        assert "Aggregate" in plan and "TransformWithState" not in plan
