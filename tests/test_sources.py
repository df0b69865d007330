"""Databases, ingesting side by side, duplicates, ranking metrics, importances."""

import random
import threading
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators.profile import duplicate_rows
from tablelens.plans.readiness import permutation_importance, ranking_metrics
from tablelens.sources import readers, warehouse

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def database(spark):
    spark._jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    url = f"jdbc:derby:memory:{uuid.uuid4().hex}"
    rows = [(k if k else None, f"name {k}", k % 7 * 1.5) for k in range(100)]
    spark.createDataFrame(rows, "K int, LABEL string, AMOUNT double").write.format("jdbc").options(url=f"{url};create=true", dbtable="THINGS", createTableColumnTypes="LABEL VARCHAR(40)", **DRIVER).save()
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    for statement in ("CREATE VIEW few AS SELECT * FROM things WHERE k < 5", 'CREATE SCHEMA other', 'CREATE TABLE other."odd name" (x INT)', "CREATE TABLE empty_one (x INT)"):
        connection.createStatement().execute(statement)
    connection.close()
    return url


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_tables_are_read_in_parts_with_filters_pushed(spark, database):
    read = readers.read_jdbc(spark, database, "THINGS", partition_column="K", parts=5, **DRIVER)
    assert read.rdd.getNumPartitions() == 5 and read.count() == 100
    narrow = read.filter("AMOUNT > 3").select("LABEL")
    assert "GreaterThan(AMOUNT,3.0)" in plan(narrow) and "ReadSchema: struct<LABEL:string>" in plan(narrow)
    assert narrow.count() == sum(k % 7 > 2 for k in range(100))
    assert readers.read_jdbc(spark, database, "EMPTY_ONE", partition_column="X", **DRIVER).count() == 0


def test_limits_and_queries_go_to_the_database(spark, database):
    few = readers.read_jdbc(spark, database, "THINGS", limit=7, **DRIVER)
    assert "FETCH FIRST 7 ROWS ONLY" in plan(few) and few.count() == 7
    assert readers.read_jdbc(spark, database, query="SELECT COUNT(*) AS n FROM things WHERE k < 10", **DRIVER).first()[0] == 9
    with pytest.raises(ValueError, match="table or a query"):
        readers.read_jdbc(spark, database, **DRIVER)
    with pytest.raises(Exception):  # noqa: B017  a name is never more than a name
        readers.read_jdbc(spark, database, 'THINGS" WHERE 1 = 0 --', **DRIVER).count()


def test_listing_a_database(spark, database):
    found = readers.list_database(spark, database, **DRIVER)
    assert [(o.name, o.kind, o.schema) for o in found] == [("EMPTY_ONE", "table", None), ("THINGS", "table", None), ("FEW", "view", None)]
    odd = readers.list_database(spark, database, schemas=["OTHER"], **DRIVER)
    assert [(o.name, o.schema) for o in odd] == [("odd name", "OTHER")]
    assert readers.read_jdbc(spark, database, "OTHER.odd name", **DRIVER).count() == 0


def test_objects_are_ingested_side_by_side(spark):
    meet = threading.Barrier(2, timeout=60)
    tag = uuid.uuid4().hex[:8]

    def slow(n):
        def read():
            meet.wait()
            return spark.range(n)

        return read

    def broken():
        raise ValueError("no such file")

    done = warehouse.ingest_all(spark, {"one": slow(3), "bad": broken, "two": slow(5), "none": lambda: spark.range(0)}, f"side {tag}").collect()
    assert [(r["object"], r["n_rows"]) for r in done] == [("one", 3), ("!bad", None), ("two", 5), ("!none", None)]
    assert done[1]["problem"] == "no such file"
    for name in ("one", "two"):
        warehouse.drop(spark, f"side_{tag}_{name}")


def test_duplicates_are_proved(spark):
    rows = [("x", None, [1]), (None, "x", [1]), ("x", None, [1]), ("x", None, [None]), ("x", None, []), (None, None, None), (None, None, None)]
    frame = spark.createDataFrame(rows, "a string, b string, c array<int>").withColumn("m", F.create_map(F.lit("k"), F.col("a")))
    assert tuple(duplicate_rows(frame).first()) == (7, 2)
    one = lambda _: [F.lit(1), F.lit(2)]  # noqa: E731  every row collides
    assert tuple(duplicate_rows(frame, one).first()) == (7, 2)
    assert tuple(duplicate_rows(frame.limit(0)).first()) == (0, 0)
    assert tuple(duplicate_rows(spark.range(10)).first()) == (10, 0)


def test_ranking_metrics(spark):
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.3), rng.choice([rng.random(), 0.5, 0.25])) for _ in range(400)]
    got = ranking_metrics(spark.createDataFrame(rows, "label int, score double"))
    y, s = (np.array(c) for c in zip(*rows, strict=True))
    pairs = (s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0])
    precision = sum((y[s == t].sum() / y.sum()) * y[s >= t].mean() for t in set(s.tolist()))
    assert got == pytest.approx({"roc_auc": pairs.mean(), "average_precision": precision})
    assert all(np.isnan(v) for v in ranking_metrics(spark.createDataFrame([(1, 0.5)], "label int, score double")).values())


@pytest.mark.parametrize("task", ["regression", "binary_classification"])
def test_importance_of_used_columns_only(spark, task):
    rng = random.Random(6)
    rows = [(float(rng.random() < 0.5), float(rng.randint(0, 9)), rng.choice(["p", "q"])) for _ in range(200)]
    rows = [(4.0 * b + (c == "p") if task == "regression" else float(b > 4), a, b, c) for a, b, c in rows]
    frame = spark.createDataFrame(rows, "label double, a double, b double, c string").repartition(3)
    guess = (lambda d: d.withColumn("prediction", 4 * F.col("b") + (F.col("c") == "p").cast("double"))) if task == "regression" else (lambda d: d.withColumn("prediction", (F.col("b") > 4).cast("double")))
    got = {r["column"]: r["importance"] for r in permutation_importance(guess, frame, ["a", "b", "c"], task, repeats=3).collect()}
    assert got["a"] == 0 and got["b"] > 0.9 and (got["c"] > 0) == (task == "regression")
