import csv
import datetime as dt
import random

import pytest

from tablelens.operators.columns import grain, profile_columns, rank_dimensions, rank_measures
from tablelens.operators.profile import duplicate_rows, number_statistics, profile
from tablelens.operators.report import pack
from tablelens.plans.readiness import task_of, tasks
from tablelens.sources import readers, warehouse
from tablelens.sources.exports import ends_open


def orders(spark, n=400):
    rng = random.Random(11)
    rows = [(k + 1, str(dt.date(2023, 1, 1) + dt.timedelta(days=k // 4)), rng.choice(["North", "South", "East", "West"]), rng.choice(["Online", "Retail"]), rng.randint(1, 9), round(rng.lognormvariate(4, 0.7), 2)) for k in range(n)]
    return spark.createDataFrame(rows, "order_id long, order_date string, region string, channel string, units long, revenue double")


def test_semantic_types(spark):
    found = {r["column"]: r["semantic"] for r in profile_columns(warehouse.promote_dates(orders(spark))).collect()}
    assert found == {"order_id": "identifier", "order_date": "temporal", "region": "geo", "channel": "categorical", "units": "categorical", "revenue": "currency"}


def test_grain_and_ranking(spark):
    p = profile_columns(orders(spark))
    assert grain(p).first()["grain"] == "one row per order_id"
    assert [r["column"] for r in rank_dimensions(p).orderBy("rank").collect()] == ["region", "units", "channel"]
    assert rank_measures([r.asDict() for r in p.collect()]) == ["revenue"]


def test_pack_has_tiles_in_order(spark):
    made = pack(warehouse.promote_dates(orders(spark)))
    assert list(made.tiles)[:2] == ["kpi", "trend"] and list(made.tiles)[-1] == "detail" and not made.dropped
    assert made.tiles["kpi"].first()["records"] == 400


def test_nulls_nan_and_nested(spark):
    frame = spark.createDataFrame([(float("nan"), None, [1]), (1.0, "a", [1]), (None, "a", None)], "x double, s string, v array<int>")
    found = {r["column"]: r for r in profile(frame).collect()}
    assert found["x"]["n"] == 1 and found["x"]["std"] == 0.0
    assert found["s"]["top_value"] == "a" and found["s"]["n_missing"] == 1
    assert found["v"]["semantic"] == "unknown" and found["v"]["n_unique"] == 1


def test_empty_table(spark):
    frame = spark.createDataFrame([], "a long, b string")
    found = profile_columns(frame).collect()
    assert {r["n_unique"] for r in found} == {0}
    assert duplicate_rows(frame).first().asDict() == {"n_rows": 0, "n_duplicates": 0}


def test_duplicates_count_nulls_as_equal(spark):
    frame = spark.createDataFrame([(None, 1), (None, 1), (2, 1), (2, None)], "a int, b int")
    assert duplicate_rows(frame).first()["n_duplicates"] == 1


def test_sketched_quantiles_are_near(spark):
    frame = spark.range(10_000).selectExpr("id * 1.0D AS x")
    row = number_statistics(frame, ["x"], exact=False).first()
    assert abs(row["median"] - 5_000) < 50


def test_tasks(spark):
    rows = [(k * 1.7, k % 2, ["a", "b", "c"][k % 3]) for k in range(300)]
    found = {r["column"]: r["task"] for r in task_of(profile(spark.createDataFrame(rows, "price double, is_fraud long, tier string"))).collect()}
    assert found == {"price": "regression", "is_fraud": "binary_classification", "tier": "multiclass_classification"}


def test_tasks_from_sketches_agree_with_whole_profiles(spark):
    """Around every number of values at which a task turns, and without counting quantiles or what is clear."""
    for n in (40, 400):
        kinds = {f"c{u}": f"id % {u}" for u in (1, 2, 3, 15, 16, n)} | {f"s{u}": f"'v' || (id % {u})" for u in (2, 100, 101)}
        kinds |= {f"t{u}": f"repeat('x', 45) || (id % {u})" for u in (int(n * 0.2), int(n * 0.6), int(n * 0.6) + 1)} | {f"part{u}_id": f"repeat('x', 45) || (id % {u})" for u in (int(n * 0.6) + 1, int(n * 0.8), int(n * 0.8) + 1)}
        kinds |= {"none": "CAST(NULL AS DOUBLE)", "real": "IF(id % 7 = 0, CAST('NaN' AS DOUBLE), (id % 2) * -0.0D)", "at": "timestamp_seconds(id % 2)", "deep": "map('k', id % 2)"}
        frame = spark.range(n).selectExpr(*[f"{sql} AS {name}" for name, sql in kinds.items()])
        assert {tuple(r) for r in tasks(frame).collect()} == {tuple(r) for r in task_of(profile(frame, numbers=False)).collect()}
    empty = spark.createDataFrame([], "a double, b string")
    assert {tuple(r) for r in tasks(empty).collect()} == {tuple(r) for r in task_of(profile(empty)).collect()}


def test_no_quantiles_where_none_are_wanted(spark, monkeypatch):
    monkeypatch.setattr("tablelens.operators.profile.exact_quantiles", lambda *_: pytest.fail("quantiles aren't wanted"))
    frame = spark.range(300).selectExpr("id", "id % 2 AS flag")
    assert {r["column"]: r["task"] for r in tasks(frame).collect()} == {"id": "regression", "flag": "binary_classification"}
    assert "median" not in profile(frame, numbers=False).columns


def test_untidy_exports(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Report for,,\n,,\nMonth ,Region,Revenue Target,Headcount\n2024-01,North,100,5\n,,,\n2024-02,South,90,4\n")
    out = readers.columns_of(readers.read_untidy(spark, str(tmp_path)))
    assert set(out.columns) == {"file", "row_no", "month", "region", "revenue_target", "headcount"}
    assert out.count() == 2


def test_untidy_exports_by_splits(spark, tmp_path):
    """Records with quotes and line breaks, cut at any byte, are those of a plain reader."""
    rng = random.Random(9)
    cell = lambda: rng.choice(["", "a", 'say ""so""', "x, y", "two\nlines", '"', "end\n\n", "7.5", "inch 5"])
    want = set()
    for name in ("one", "two"):
        rows = [[cell() for _ in range(3)] for _ in range(400)]
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding="utf-8-sig" if name == "one" else "utf-8") as f:
            f.write('Report,,\n"made\nby hand",,\n')
            csv.writer(f, lineterminator="\n").writerows([["First Name", "Second", "2nd"], *rows])
        want |= {(name, *(c if c.strip() else None for c in r)) for r in rows if any(c.strip() for c in r)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "701")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        read = readers.read_untidy(spark, str(tmp_path))
        found = {(r["file"].rsplit("/", 1)[1][:-4], *(r["cells"].get(n) for n in ("first_name", "second", "c_2nd"))) for r in read.collect()}
        assert found == want
        numbers = [(r["file"], r["row_no"]) for r in read.collect()]
        assert len(set(numbers)) == len(numbers)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_where_quotes_open_cells():
    assert [ends_open(x, False) for x in ('a,b', '"a', '"a"', '"a""', 'a"b', 'a,"b', '"a","b', '""', '"a" ,"b')] == [False, True, False, True, False, True, True, False, True]
    assert [ends_open(x, True) for x in ('a', 'a"', 'a""', 'a","b', 'a",b')] == [True, False, True, True, False]


def test_csv_scan_and_objects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\n3;4\n")
    (tmp_path / "b.csv").write_text("x;y\n5;6\n")
    assert readers.list_objects(spark, str(tmp_path)) == ["a", "b"]
    assert readers.read_csv(spark, str(tmp_path), "a", sep=";").count() == 2
    assert readers.read_csv(spark, str(tmp_path), sep=";", limit=1).count() == 1
    assert readers.source_type(spark, str(tmp_path)) == "csv"
    try:
        readers.read_csv(spark, str(tmp_path), "c")
        raise AssertionError
    except readers.NoSuchObject:
        pass


def test_ingest_append_and_look(spark):
    done = warehouse.ingest_all(spark, {"Orders 1": lambda: orders(spark, 40), "empty": lambda: orders(spark, 40).filter("false")}, "tl_test")
    rows = {r["object"]: r for r in done.collect()}
    table = rows["Orders 1"]["table"]
    try:
        assert rows["Orders 1"]["n_rows"] == 40 and rows["!empty"]["problem"]
        assert warehouse.append(spark.table(table).limit(3), table) == 43
        assert warehouse.append(spark.table(table).filter("false"), table) == 43
        assert table in warehouse.tables(spark) and warehouse.preview(spark, table, 5).count() == 5
    finally:
        warehouse.drop(spark, table)
    assert table not in warehouse.tables(spark)
