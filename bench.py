"""Bench of the headline queries: one JSON line with the seconds each takes.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query is run once to
warm up and then timed; all rows are computed and thrown away.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pvflow.plans.all import QUERIES  # noqa: E402
from pvflow.session import local_session  # noqa: E402

HEADLINES = [
    "snap_frames",
    "snap_normal",
    "snap_buffered",
    "snap_trigger_buffered",
    "snap_trigger_normal",
    "snap_forced",
    "asof_merge",
    "monitor_fanout",
    "encode_once",
    "last_value",
    "refcount",
    "counter_delta",
    "sub_purge",
    "cmd_repeating",
    "snap_lifecycle",
    "get_reply",
    "flatten_leaves",
    "encode_json",
    "encode_msgpack",
    "decode_job",
    "archive_pv_values",
    "replay_range",
    "pipeline_snapshot",
    "pipeline_monitor",
    "frame_sink",
    "fanout_msgpack",
    "put_validate",
    "replay_pvs",
    "window_code",
    "stream_fanout",
    "stream_buffered",
    "stream_topics",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session("pvflow-bench", cores)
    times = {}
    for name in sys.argv[1:] or HEADLINES:
        run(spark, name, sf_dir)
        times[name] = round(run(spark, name, sf_dir), 3)
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    spark.stop()
    print(json.dumps(result))


if __name__ == "__main__":
    main()
