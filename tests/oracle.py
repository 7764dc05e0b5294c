"""Runs a query and its SQL side by side."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _missing(v) -> bool:
    return v is None or v is pd.NA or v != v


def _shown(v) -> str:
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _plain(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple("" if _missing(v) else _shown(v) for v in row) for row in frame.astype(object).itertuples(index=False)]
    return list(frame.columns), sorted(rows)


def compare(spark, con, name, run, sql, sf_dir) -> None:
    columns, rows = _plain(run(spark, sf_dir).toPandas())
    want_columns, want = _plain(con.sql(sql).df())
    assert columns == want_columns, name
    assert len(rows) == len(want), f"{name}: {len(rows)} rows, SQL has {len(want)}"
    wrong = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
    assert not wrong, f"{name}: {len(wrong)} rows differ, first {wrong[0]}"
