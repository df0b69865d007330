"""Every query with SQL gives the same rows as DuckDB, on the smallest tables."""

import math
from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")
SF = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def names():
    import __spark_entry__ as entry

    return sorted(n for n in entry.oracle_sql() if not n.startswith("op"))


def test_same_rows(spark, db):
    import __spark_entry__ as entry

    found, sql, wrong = entry.queries(), entry.oracle_sql(), []
    for name in names():
        frame = found[name](spark, str(SF))
        want = db.sql(sql[name])
        if rows(frame.columns, frame.collect()) != rows(want.columns, want.fetchall()):
            wrong.append(name)
    assert wrong == []
