"""Every catalogue query against its SQL counterpart."""

import pytest

import __spark_entry__ as entry
from compare import compare

QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        _, problems = compare(df, duck, ORACLE[name])
        assert not problems, "\n".join(problems)
    else:
        assert df.count() > 0


def test_entry_has_frames(spark):
    kinds = {r.message_type for r in entry.entry(spark).select("message_type").distinct().collect()}
    assert kinds == {0, 1, 2}
