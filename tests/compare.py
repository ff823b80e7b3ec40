"""Runs a catalogue query and its SQL counterpart and compares schema and values."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(_plain(x)) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_plain(x)}" for k, x in v.items()) + "}"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and v == int(v) and abs(v) < 2**53:
        return str(int(v))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v)


def _rows(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)].astype(object)
    rows = [tuple(_plain(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple("" if v is None else str(v) for v in r))


_KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
    "float": "FLOAT", "tinyint": "TINYINT", "smallint": "SMALLINT", "binary": "BLOB",
}


def compare(spark_df, con, sql: str) -> tuple[int, list[str]]:
    """Row count and a list of differences (empty when equal)."""
    rel = con.sql(sql)
    want = rel.df()
    got = spark_df.toPandas()
    problems = []
    if sorted(got.columns) != sorted(want.columns):
        return len(got), [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for name, kind in spark_df.dtypes:
        if kind in _KINDS and types[name] != _KINDS[kind]:
            problems.append(f"type of {name}: {kind} != {types[name]}")
    a, b = _rows(got), _rows(want)
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        sa, sb = set(a), set(b)
        cols = sorted(got.columns)
        problems.append(f"cols {cols}\n  only spark {sorted(sa - sb, key=str)[:3]}\n  only sql {sorted(sb - sa, key=str)[:3]}")
    return len(a), problems
