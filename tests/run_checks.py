"""Check catalogue queries against their SQL: python tests/run_checks.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path[:0] = ["/root/repo", "/root/repo/tests"]

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402
from pvflow.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(cores=os.environ.get("CHECK_CPUS", "8"))
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or list(queries)
    bad = 0
    for name in names:
        t = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracle:
                n, problems = compare(df, con, oracle[name])
            else:
                n, problems = df.count(), []
            status = "ok " if not problems else "BAD"
        except Exception as e:
            n, problems, status = -1, [str(e)[:1500] + "\n" + traceback.format_exc()[-600:]], "ERR"
        bad += status != "ok "
        print(f"{status} {name:24s} rows={n:7d} {time.time() - t:6.2f}s", *problems[:4], flush=True)
    print("bad:", bad, "of", len(names))
