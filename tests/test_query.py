import datetime as dt

import pytest

from tablelens.functions.names import UnknownName, clean_alias, normal_columns, resolve, table_name
from tablelens.operators.query import BadQuery, Dimension, Filter, Metric, QuerySpec, Sort, moment, number, roll_up, run_spec
from tablelens.plans.adhoc import NotAllowed, adhoc


@pytest.fixture(scope="module")
def orders(spark):
    rows = [(k, dt.datetime(2024, 1 + k % 3, 1 + k % 28), "North" if k % 2 else "West", float(k), k % 7) for k in range(60)]
    return spark.createDataFrame(rows, "order_id long, order_date timestamp_ntz, region string, revenue double, delivery_days long")


def test_filters_reach_the_scan(spark, tmp_path, orders):
    orders.write.parquet(str(tmp_path / "o"))
    frame = run_spec(spark.read.parquet(str(tmp_path / "o")), QuerySpec([Dimension("region")], [Metric("sum", "revenue")], [Filter("revenue", ">", "10")])).frame
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(revenue), GreaterThan(revenue,10.0)]" in plan
    assert "ReadSchema: struct<region:string,revenue:double>" in plan


@pytest.mark.parametrize(
    "bad",
    [
        QuerySpec([Dimension("region", "month")], [Metric("count")]),
        QuerySpec([Dimension("order_date", "fortnight")], [Metric("count")]),
        QuerySpec(metrics=[Metric("sum", "region")]),
        QuerySpec(metrics=[Metric("sum", "order_id")]),
        QuerySpec(metrics=[Metric("sum", "*")]),
        QuerySpec(metrics=[Metric("mode", "revenue")]),
        QuerySpec(metrics=[Metric("count")], filters=[Filter("revenue", "=", "many")]),
        QuerySpec(metrics=[Metric("count")], filters=[Filter("order_date", ">", "soon")]),
        QuerySpec(metrics=[Metric("count")], filters=[Filter("revenue", "between", [1])]),
        QuerySpec(metrics=[Metric("count")], filters=[Filter("region", "last_n_days", 3)]),
        QuerySpec(metrics=[Metric("count")], filters=[Filter("region", "like", "x")]),
        QuerySpec(metrics=[Metric("avg", "revenue", "x"), Metric("max", "revenue", "X")]),
    ],
)
def test_bad_queries_are_refused(orders, bad):
    with pytest.raises(BadQuery):
        run_spec(orders, bad, {"order_id": "identifier"})


def test_unknown_name_offers_near_ones(orders):
    with pytest.raises(UnknownName, match="region"):
        run_spec(orders, QuerySpec([Dimension("regio")], [Metric("count")]))
    assert resolve("Order Date", orders.columns) == "order_date"
    assert resolve("area", orders.columns, {"region": ["Area"]}) == "region"


def test_having_sort_and_limit(orders):
    spec = QuerySpec([Dimension("region")], [Metric("sum", "revenue", "total")], [Filter("total", ">", 0)], [Sort("REVENUE", True), Sort("nowhere")], 1)
    answer = run_spec(orders, spec)
    assert [r["region"] for r in answer.frame.collect()] == ["North"]
    assert answer.warnings == ["no output 'nowhere' to sort by"]


def test_literals_and_names():
    assert number("12") == 12 and number("1e3") == 1000.0
    assert moment("2024-03") == dt.datetime(2024, 3, 1) and moment("05/02/2024") == dt.datetime(2024, 2, 5)
    assert clean_alias("2 Big-Words") == "c_2_big_words" and clean_alias("") == "value"
    assert normal_columns(["Month ", "Unnamed: 1", "a b", "A-B", "a_b_1", None, "9x"]) == ["month", "column_2", "a_b", "a_b_1", "a_b_1_1", "column_6", "c_9x"]
    assert normal_columns(["a", "Unnamed: 1", None, "--", "column_2"]) == ["a", "column_2", "column_3", "column_4", "column_2_1"]
    assert table_name("My File", "2024") == "my_file_2024" and table_name("") == "dataset"


def test_roll_up_warns_of_averages(orders):
    fine = run_spec(orders, QuerySpec([Dimension("region"), Dimension("delivery_days")], [Metric("avg", "revenue", "m")])).frame
    _, caveats = roll_up(fine, ["region"], {"m": "avg"})
    assert len(caveats) == 1


def test_adhoc_reads_known_tables_only(spark, tmp_path, orders):
    for name in ("a", "b"):
        orders.write.parquet(str(tmp_path / name))
    a = spark.read.parquet(str(tmp_path / "a"))
    spark.read.parquet(str(tmp_path / "b")).createOrReplaceTempView("other_view")
    assert adhoc(spark, "WITH x AS (SELECT * FROM a) SELECT count(*) AS n FROM x;", {"a": a}).first()["n"] == 60
    with pytest.raises(NotAllowed):
        adhoc(spark, "SELECT * FROM other_view", {"a": a})
    spark.createDataFrame([(1,)], "secret int").createOrReplaceTempView("local_view")
    spark.createDataFrame([(1,)], "secret int").createOrReplaceGlobalTempView("everywhere")
    spark.createDataFrame([(1,)], "secret int").write.mode("overwrite").saveAsTable("kept_table")
    foreign = ("local_view", "global_temp.everywhere", "kept_table", "range(3)", "a CROSS JOIN local_view", "(SELECT * FROM a WHERE region IN (SELECT secret FROM local_view))", "a, LATERAL (SELECT secret FROM kept_table)", "(VALUES (1)) AS v")
    for source in foreign:
        with pytest.raises(NotAllowed):
            adhoc(spark, f"SELECT 1 FROM {source}", {"a": a})
    with pytest.raises(NotAllowed):
        adhoc(spark, "SELECT reflect('java.lang.System', 'nanoTime') FROM a", {"a": a})
    assert adhoc(spark, "SELECT (SELECT count(*) FROM a) AS n FROM a AS x JOIN a AS y ON x.region = y.region LIMIT 1", {"a": a}).first()["n"] == 60
    assert adhoc(spark, "SELECT 1 AS one", {"a": a}).first()["one"] == 1
    given = spark.createDataFrame([(1,)], "k int")
    assert adhoc(spark, "SELECT * FROM given", {"given": given}).first()["k"] == 1
    spark.sql("DROP TABLE kept_table")
    for text in ("DROP TABLE a", f"SELECT * FROM parquet.`{tmp_path / 'b'}`", "SELECT 1; SELECT 2"):
        with pytest.raises(Exception):  # noqa: B017
            adhoc(spark, text, {"a": a})


def test_grains_are_monday_weeks(spark):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 7),)], "d timestamp_ntz")
    week = run_spec(frame, QuerySpec([Dimension("d", "week")], [Metric("count")])).frame.first()
    assert week["d_week"] == dt.datetime(2024, 1, 1)


def test_registered_queries_give_all_rows(spark, tmp_path):
    from tablelens.queries import QUERIES

    rows = spark.range(60_000).selectExpr("id AS l_suppkey", "'A' AS l_returnflag", "'O' AS l_linestatus", "1 AS l_quantity")
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES["c2_projection"](spark, str(tmp_path)).count() == 60_000
    rows.selectExpr("l_suppkey", "20000 AS l_quantity").write.parquet(f"{tmp_path}/more/lineitem.parquet")
    assert QUERIES["c21_having"](spark, f"{tmp_path}/more").count() == 60_000
    table = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    assert adhoc(spark, "SELECT * FROM lineitem", {"lineitem": table}, cap=None).count() == 60_000
    assert adhoc(spark, "SELECT * FROM lineitem", {"lineitem": table}).count() == 50_000
    assert run_spec(table, QuerySpec(limit=10**6)).frame.count() == 50_000
