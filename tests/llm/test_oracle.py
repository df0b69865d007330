"""The SQL of the training-data operators beside their queries, on the smallest tables and on documents with odd rows."""

import math

import pytest

pytest.importorskip("tablelens.llm")
duckdb = pytest.importorskip("duckdb")
from pathlib import Path  # noqa: E402

from tablelens.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = Path("/root/testdata/sf0.001")


def plain(v):
    return (None if math.isnan(v) else float(f"{v:.8g}")) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differing(spark, folder):
    con, wrong = duckdb.connect(), []
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet{'' if (folder / 'documents.parquet').is_file() else '/*.parquet'}')")
    for name, sql in ORACLE_SQL.items():
        frame, want = QUERIES[name](spark, str(folder)), con.sql(sql)
        if rows(frame.columns, frame.collect()) != rows(want.columns, want.fetchall()):
            wrong.append(name)
    return wrong


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_same_rows(spark):
    assert differing(spark, SF) == []


def test_same_rows_of_odd_documents(spark, tmp_path):
    long = "The Quick brown fox, and the quick brown dog. " * 80
    texts = [None, "", " \t\n", long, long, long + "é", "x" * 49, "x" * 50, "x" * 51, "ÀÉ #|# É", long[5:900] + "?" + long[40:700], "one two three four five " * 30]
    docs = [(k, text, ("en", "de", None)[k % 3], ("a", "b", None, "c")[k % 4], 0) for k, text in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert differing(spark, tmp_path) == []
