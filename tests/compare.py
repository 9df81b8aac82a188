"""Spark results against DuckDB on the same Parquet tables."""

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir=DATA):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(r) for r in frame.itertuples(index=False)), key=repr)


def assert_same(df, sql, sf_dir=DATA, con=None):
    got, want = df.toPandas(), (con or duck(sf_dir)).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert {c: str(got[c].dtype) for c in got} == {c: str(want[c].dtype) for c in want}
    assert rows_of(got) == rows_of(want)
