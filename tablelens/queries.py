"""The registered queries of the table operators, each with the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.names import CURRENCY_NAME, GEO_NAME, ID_NAME, TIME_NAME
from tablelens.operators import activity, columns, patterns, profile, report, series
from tablelens.operators.query import ALL_ROWS, Dimension, Filter, Metric, QuerySpec, Sort, roll_up, roll_up_exactly, run_spec
from tablelens.plans import readiness
from tablelens.plans.adhoc import adhoc
from tablelens.plans.analysis import analyze
from tablelens.sources import readers, warehouse
from tablelens.sources.scratch import shared_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None, *rounded: str) -> Callable[[Callable], Callable]:
    """Registers a query by its function's name. Doubles are rounded on both sides; `rounded` names them in the SQL."""

    def register(build: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = build(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark, sf_dir)
            return out.withColumns({f.name: F.round(f.name, DIGITS) for f in out.schema if isinstance(f.dataType, T.DoubleType)})

        QUERIES[build.__name__] = run
        if sql is not None:
            replaced = ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in rounded)
            ORACLE_SQL[build.__name__] = f"SELECT * REPLACE ({replaced}) FROM ({sql})" if rounded else sql
        return build

    return register


def spec(frame: DataFrame, dims=(), metrics=(), filters=(), sort=(), limit=ALL_ROWS, **more) -> DataFrame:
    return run_spec(frame, QuerySpec(dims, metrics, filters, sort, limit), **more).frame


# Sources and sinks


@query("SELECT * FROM nation")
def a2_parquet_scan(t, spark, sf_dir):
    return readers.read_parquet(spark, f"{sf_dir}/nation.parquet")


@query("SELECT * FROM (SELECT c_custkey % 3 AS k, nullif(c_mktsegment, 'BUILDING') AS segment, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS balance FROM customer) WHERE segment IS NOT NULL OR balance IS NOT NULL")
def a6_drop_empty_rows(t, spark, sf_dir):
    rows = t("customer").select((F.col("c_custkey") % 3).alias("k"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("balance"))
    kept = readers.drop_empty_rows(rows.select("segment", "balance", F.when(F.col("segment").isNotNull() | F.col("balance").isNotNull(), F.col("k")).alias("k")))
    return kept.select("k", "segment", "balance")


@query("SELECT n_nationkey AS nation_key, n_name AS column_2, n_regionkey AS region_key_2 FROM nation")
def a7_tidy_names(t, spark, sf_dir):
    return readers.tidy_names(t("nation").toDF(" Nation  Key", "Unnamed: 1", "Region-Key 2"))


@query("SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS ordered, o_orderstatus FROM orders")
def a8_promote_dates(t, spark, sf_dir):
    return warehouse.promote_dates(t("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ordered"), "o_orderstatus"))


@query("SELECT o_orderkey, date_trunc('minute', o_orderdate)::TIMESTAMP AS ordered FROM orders")
def a8_mixed_dates(t, spark, sf_dir):
    """Order times written in seven forms, one after another."""
    forms = ("yyyy-MM-dd HH:mm", "yyyy/M/d HH:mm:ss", "M/d/yyyy H:mm", "d MMM yyyy HH:mm", "MMMM d, yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    minute = F.date_trunc("minute", "o_orderdate")
    written = F.coalesce(*[F.when(F.col("o_orderkey") % len(forms) == k, F.date_format(minute, form)) for k, form in enumerate(forms)])
    return warehouse.promote_dates(t("orders").select("o_orderkey", written.alias("ordered")))


def in_database(t, spark: SparkSession) -> tuple[str, dict[str, str]]:
    """A database within the driver that holds customer, and a view of it. Its rows can be read by one process only, so
    these queries are for local sessions; elsewhere give read_jdbc the URL of a server."""
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise NotImplementedError("an embedded database is open to a single process")
    spark._jvm.System.setProperty("derby.stream.error.file", "/dev/null")
    url, options = f"jdbc:derby:memory:{uuid.uuid4().hex}", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = t("customer").select(*[F.col(c).alias(c.upper()) for c in ("c_custkey", "c_name", "c_acctbal", "c_mktsegment")])
    rows.write.format("jdbc").options(url=f"{url};create=true", dbtable="CUSTOMER", createTableColumnTypes="C_NAME VARCHAR(64), C_MKTSEGMENT VARCHAR(64)", **options).save()
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    connection.createStatement().execute("CREATE VIEW debtors AS SELECT * FROM customer WHERE c_acctbal < 0")
    connection.close()
    return url, options


def _lower(frame: DataFrame) -> DataFrame:
    return frame.toDF(*[c.lower() for c in frame.columns])


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 1000")
def a3_database_table(t, spark, sf_dir):
    """A table read in ranges of its key; the filter goes to the database."""
    url, options = in_database(t, spark)
    read = _lower(readers.read_jdbc(spark, url, "CUSTOMER", partition_column="C_CUSTKEY", parts=4, **options))
    return read.filter("c_acctbal > 1000").select("c_custkey", "c_name", "c_acctbal")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def a4_database_query(t, spark, sf_dir):
    url, options = in_database(t, spark)
    read = _lower(readers.read_jdbc(spark, url, query="SELECT c_mktsegment, COUNT(*) AS n FROM customer GROUP BY c_mktsegment", **options))
    return read.select("c_mktsegment", F.col("n").cast("long").alias("n"))


@query("SELECT 'customer' AS name, 'table' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'debtors', 'view', count(*) FROM customer WHERE c_acctbal < 0")
def a14_list_database(t, spark, sf_dir):
    """The objects of a database, with their rows."""
    url, options = in_database(t, spark)
    listed = readers.list_database(spark, url, **options)
    counts = [readers.read_jdbc(spark, url, o.name, **options).agg(F.lit(o.name.lower()).alias("name"), F.lit(o.kind).alias("kind"), F.count(F.lit(1)).alias("n")) for o in listed]
    return reduce(DataFrame.unionByName, counts)


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def a1_csv_scan(t, spark, sf_dir):
    """Customers exported as CSV and read again."""
    path = shared_path(spark, "customer_csv")
    t("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment").write.csv(path, header=True, sep=";")
    return readers.read_csv(spark, path, sep=";").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def a5_untidy_headers(t, spark, sf_dir):
    """Customers exported below a line of remarks and under untidy names."""
    path = shared_path(spark, "customer_untidy")
    body = t("customer").select(F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("value"), F.lit(2).alias("place"), F.pmod("c_custkey", F.lit(4)).alias("part"))
    head = spark.createDataFrame([("Export of customers,,", 0), ("C CustKey,C-Name,C MktSegment", 1)], "value string, place int")
    for part in range(4):  # four exports, each a file with its own header
        body.filter(F.col("part") == part).select("value", "place").unionByName(head).coalesce(1).sortWithinPartitions("place").select("value").write.mode("append").text(path)
    read = readers.columns_of(readers.read_untidy(spark, path, glob="*.txt"))
    return read.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")


@query("""SELECT 'nation' AS object, 'geo_nation' AS "table", count(*) AS n_rows, false AS failed FROM nation UNION ALL SELECT 'region', 'geo_region', count(*), false FROM region
    UNION ALL SELECT '!nothing', NULL, NULL, true""")
def a13_ingest_source(t, spark, sf_dir):
    objects = {"nation": lambda: t("nation"), "nothing": lambda: t("nation").limit(0), "region": lambda: t("region")}
    return warehouse.ingest_all(spark, objects, "geo").select("object", "table", "n_rows", F.col("problem").isNotNull().alias("failed"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def a10_write_replace(t, spark, sf_dir):
    path = shared_path(spark, "customer")
    warehouse.write_path(t("customer").limit(5), path)
    warehouse.write_path(t("customer"), path)
    return spark.read.parquet(path).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def a11_write_append(t, spark, sf_dir):
    path = shared_path(spark, "nation")
    warehouse.write_path(t("nation").filter("n_nationkey < 10"), path, "append")
    warehouse.write_path(t("nation").filter("n_nationkey >= 10"), path, "append")
    return spark.read.parquet(path).groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'rows' AS what, count(*) AS n FROM lineitem UNION ALL SELECT 'preview', least(500, count(*)) FROM lineitem UNION ALL SELECT 'listed', 1 UNION ALL SELECT 'listed after drop', 0")
def a16_table_looks(t, spark, sf_dir):
    """A stored table counted, previewed, listed and dropped."""
    name = f"looked_at_{uuid.uuid4().hex}"
    written = warehouse.replace(t("lineitem"), name)
    counts = [("rows", written), ("preview", warehouse.preview(spark, name, 500).count()), ("listed", warehouse.tables(spark).count(name))]
    warehouse.drop(spark, name)
    return spark.createDataFrame([*counts, ("listed after drop", warehouse.tables(spark).count(name))], "what string, n long")


@query("SELECT r_name AS source, n_name AS dataset FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def a17_remove_source(t, spark, sf_dir):
    sources = t("region").select(F.col("r_name").alias("name"))
    datasets = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("dataset"))
    return warehouse.remove_source(sources, datasets, ["ASIA", "EUROPE"])[1]


# Columns and catalogue

TABLES = {
    "orders": [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "text"), ("o_totalprice", "real"), ("o_orderdate", "temporal"), ("o_orderpriority", "text")],
    "customer": [("c_custkey", "integer"), ("c_name", "text"), ("c_nationkey", "integer"), ("c_acctbal", "real"), ("c_mktsegment", "text")],
    "lineitem": [("l_orderkey", "integer"), ("l_partkey", "integer"), ("l_suppkey", "integer"), ("l_linenumber", "integer"), ("l_quantity", "real"), ("l_extendedprice", "real"), ("l_discount", "real"), ("l_tax", "real"), ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "temporal")],
    "events": [("event_id", "integer"), ("ts", "temporal"), ("user_id", "integer"), ("event_type", "text"), ("value", "real"), ("props", "text")],
    "part": [("p_partkey", "integer"), ("p_name", "text"), ("p_brand", "text"), ("p_type", "text"), ("p_size", "integer"), ("p_retailprice", "real")],
}


def sql_evidence(table: str) -> str:
    """SQL: a row per column with place, kind, n_rows, n, n_unique, mean_length."""
    rows = []
    for place, (c, kind) in enumerate(TABLES[table]):
        length = f"avg(length({c}))" if kind == "text" else "NULL::DOUBLE"
        rows.append(f"SELECT '{c}' AS \"column\", {place} AS place, '{kind}' AS kind, count(*) AS n_rows, count({c}) AS n, count(DISTINCT {c}) AS n_unique, {length} AS mean_length FROM {table}")
    return " UNION ALL ".join(rows)


def sql_semantic() -> str:
    says = lambda p: f"regexp_matches(\"column\", '(?i){p}')"
    number = "kind IN ('integer', 'real')"
    return f"""CASE WHEN kind = 'temporal' THEN 'temporal'
        WHEN kind = 'integer' AND {says(ID_NAME)} THEN 'identifier'
        WHEN {number} AND {says(CURRENCY_NAME)} THEN 'currency'
        WHEN kind = 'integer' AND n_unique <= 12 AND n > 50 THEN 'categorical'
        WHEN {number} AND {says(TIME_NAME)} AND n_unique < 200 THEN 'categorical'
        WHEN {number} THEN 'numeric'
        WHEN {says(ID_NAME)} AND n_unique / n > 0.8 THEN 'identifier'
        WHEN {says(GEO_NAME)} THEN 'geo'
        WHEN mean_length > 60 OR (n_unique / n > 0.6 AND mean_length > 40) THEN 'text'
        WHEN n_unique <= greatest(50, 0.2 * n) THEN 'categorical' ELSE 'text' END"""


def sql_profile(table: str) -> str:
    return f"SELECT *, {sql_semantic()} AS semantic FROM ({sql_evidence(table)})"


@query(" UNION ALL ".join(f"SELECT '{t}' AS \"table\", \"column\", semantic FROM ({sql_profile(t)})" for t in TABLES))
def b1_semantic_types(t, spark, sf_dir):
    frames = [columns.semantic_types(t(name)).select(F.lit(name).alias("table"), "column", "semantic") for name in TABLES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("""SELECT 'ordered' AS "column", avg((try_strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') IS NOT NULL)::INT) AS time_share FROM orders
    UNION ALL SELECT 'o_orderstatus', avg((try_strptime(o_orderstatus, '%d/%m/%Y') IS NOT NULL)::INT) FROM orders""", "time_share")
def b2_looks_temporal(t, spark, sf_dir):
    rows = t("orders").select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("ordered"), "o_orderstatus")
    return columns.basics(rows).select("column", "time_share")


@query(f"""SELECT p."column", p.n_unique, p.semantic, 0.0::DOUBLE AS null_fraction, m.lo AS min_number, m.hi AS max_number, m.lo_t AS min_time, m.hi_t AS max_time
    FROM ({sql_profile('orders')}) p JOIN (
        SELECT 'o_orderkey' AS c, min(o_orderkey)::DOUBLE AS lo, max(o_orderkey)::DOUBLE AS hi, NULL::VARCHAR AS lo_t, NULL::VARCHAR AS hi_t FROM orders
        UNION ALL SELECT 'o_custkey', min(o_custkey), max(o_custkey), NULL, NULL FROM orders
        UNION ALL SELECT 'o_totalprice', min(o_totalprice), max(o_totalprice), NULL, NULL FROM orders
        UNION ALL SELECT 'o_orderdate', NULL, NULL, min(o_orderdate)::DATE::VARCHAR, max(o_orderdate)::DATE::VARCHAR FROM orders
        UNION ALL SELECT 'o_orderstatus', NULL, NULL, NULL, NULL UNION ALL SELECT 'o_orderpriority', NULL, NULL, NULL, NULL) m ON m.c = p."column" """, "min_number", "max_number")
def b3_column_profile(t, spark, sf_dir):
    return columns.profile_columns(t("orders")).select("column", "n_unique", "semantic", "null_fraction", "min_number", "max_number", "min_time", "max_time")


@query(f"""SELECT p."column", p.n_rows, p.n_unique, p.semantic, 'ingested_customer' AS dataset, 'one row per c_custkey' AS grain FROM ({sql_profile('customer')}) p""")
def a12_ingest(t, spark, sf_dir):
    done = warehouse.ingest(t("customer"), "Ingested Customer")
    return done.select("column", "n_rows", "n_unique", "semantic", "dataset", "grain")


SQL_TOP = """SELECT '{c}' AS "column", value, n, (row_number() OVER (ORDER BY n DESC, value))::INT AS rank FROM (SELECT {c}::VARCHAR AS value, count(*) AS n FROM {t} WHERE {c} IS NOT NULL GROUP BY 1) QUALIFY rank <= 10"""


@query(" UNION ALL ".join(f"SELECT * FROM ({SQL_TOP.format(c=c, t='part')})" for c in ("p_brand", "p_type", "p_size", "p_name")))
def b3_common_values(t, spark, sf_dir):
    return columns.top_values(columns.value_counts(t("part").select("p_brand", "p_type", "p_size", "p_name")))


@query(f"""SELECT '{"events"}' AS "table", n_rows, count(*)::BIGINT AS n_columns, sum(n_unique)::BIGINT AS distinct_values FROM ({sql_evidence('events')}) GROUP BY n_rows""")
def b4_frame_profile(t, spark, sf_dir):
    return columns.profile_columns(t("events")).groupBy("n_rows").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n_unique").alias("distinct_values")).select(F.lit("events").alias("table"), "n_rows", "n_columns", "distinct_values")


@query(" UNION ALL ".join(
    f"""SELECT '{t}' AS "table", coalesce('one row per ' || min_by("column", place) FILTER (n_unique >= 0.98 * n_rows),
        'one row per ' || min_by("column", place) FILTER (semantic = 'identifier') || ' and ' || min_by("column", place) FILTER (semantic = 'temporal'),
        min_by("column", place) FILTER (semantic = 'identifier') || ' (repeating)', 'unspecified') AS grain FROM ({sql_profile(t)})"""
    for t in ("orders", "lineitem", "events")))
def b5_grain(t, spark, sf_dir):
    frames = [columns.grain(columns.profile_columns(t(n))).select(F.lit(n).alias("table"), "grain") for n in ("orders", "lineitem", "events")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{kind}; ' || (SELECT count(DISTINCT {c}) FROM nation) || ' distinct; '
    || {"(SELECT min(" + c + ")::DOUBLE::VARCHAR || ' to ' || max(" + c + ")::DOUBLE::VARCHAR || '; ' FROM nation)" if number else "''"}
    || 'e.g. ' || (SELECT string_agg(value, ', ' ORDER BY n DESC, value) FROM (SELECT {c}::VARCHAR AS value, count(*) AS n FROM nation GROUP BY 1 ORDER BY n DESC, value LIMIT 8)) AS entry"""
    for c, kind, number in (("n_nationkey", "numeric/int", True), ("n_name", "categorical/string", False), ("n_regionkey", "numeric/int", True))))
def b6_data_dictionary(t, spark, sf_dir):
    return columns.dictionary(columns.profile_columns(t("nation")))


_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query(f"""SELECT p."column", p.n_unique, 'complete' AS completeness, s.samples FROM ({sql_profile('customer')}) p
    JOIN (SELECT "column", string_agg(value, '|' ORDER BY rank) AS samples FROM ({" UNION ALL ".join(f"SELECT * FROM ({SQL_TOP.format(c=c, t='customer')})" for c in _CUSTOMER)}) WHERE rank <= 5 GROUP BY 1) s USING ("column")""")
def b7_quality_facts(t, spark, sf_dir):
    return columns.quality_facts(columns.profile_columns(t("customer"))).select("column", "n_unique", "completeness", "samples")


@query("SELECT sum(l_extendedprice * (1 - l_discount)) AS net_revenue FROM lineitem", "net_revenue")
def b9_named_metric(t, spark, sf_dir):
    return columns.named_metric(t("lineitem"), "net_revenue", "sum(l_extendedprice * (1 - l_discount))")


@query("SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 200")
def b10_top_values(t, spark, sf_dir):
    return columns.top_of(t("part"), "p_brand")


# Aggregate queries


@query("SELECT * FROM region LIMIT 1000")
def c1_raw_scan(t, spark, sf_dir):
    return spec(t("region"), limit=1_000)


@query("SELECT l_returnflag, l_linestatus FROM lineitem WHERE l_quantity = 1")
def c2_projection(t, spark, sf_dir):
    return spec(t("lineitem"), [Dimension("l_returnflag"), Dimension("l_linestatus")], filters=[Filter("l_quantity", "=", 1)])


@query("""SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_l_quantity, sum(l_extendedprice) AS sum_l_extendedprice, avg(l_discount) AS avg_l_discount, count(*) AS row_count
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2""", "sum_l_quantity", "sum_l_extendedprice", "avg_l_discount")
def c3_grouped_aggregate(t, spark, sf_dir):
    metrics = [Metric("sum", "l_quantity"), Metric("sum", "l_extendedprice"), Metric("avg", "l_discount"), Metric("count")]
    return spec(t("lineitem"), [Dimension("l_returnflag"), Dimension("l_linestatus")], metrics, [Filter("l_shipdate", "<=", "1998-09-02")])


@query("SELECT sum(o_totalprice) AS sum_o_totalprice, count(*) AS row_count FROM orders", "sum_o_totalprice")
def c4_global_aggregate(t, spark, sf_dir):
    return spec(t("orders"), metrics=[Metric("sum", "o_totalprice"), Metric("count")])


def _bucketed(grain: str) -> None:
    sql = f"SELECT date_trunc('{grain}', o_orderdate)::TIMESTAMP AS o_orderdate_{grain}, count(*) AS row_count FROM orders GROUP BY 1"

    def build(t, spark, sf_dir):
        return spec(t("orders"), [Dimension("o_orderdate", grain)], [Metric("count")])

    build.__name__ = f"c5_time_bucket_{grain}"
    query(sql)(build)


for _grain in ("day", "week", "month", "quarter", "year"):
    _bucketed(_grain)


def _metric(number: str, agg: str, column: str, sql: str, *rounded: str) -> None:
    def build(t, spark, sf_dir):
        return spec(t("lineitem"), [Dimension("l_returnflag")], [Metric(agg, column)])

    build.__name__ = f"{number}_{agg}"
    query(f"SELECT l_returnflag, {sql} AS {agg}_{column} FROM lineitem GROUP BY 1", *rounded)(build)


_metric("c6", "sum", "l_quantity", "sum(l_quantity)", "sum_l_quantity")
_metric("c7", "avg", "l_tax", "avg(l_tax)", "avg_l_tax")
_metric("c8", "min", "l_shipdate", "min(l_shipdate)")
_metric("c8", "max", "l_linestatus", "max(l_linestatus)")
_metric("c10", "count", "l_tax", "count(l_tax)")
_metric("c11", "count_distinct", "l_suppkey", "count(DISTINCT l_suppkey)")
_metric("c12", "median", "l_extendedprice", "median(l_extendedprice)", "median_l_extendedprice")
_metric("c13", "stddev", "l_discount", "stddev_samp(l_discount)", "stddev_l_discount")


@query("SELECT l_linestatus, count(*) AS row_count FROM lineitem GROUP BY 1")
def c9_count_rows(t, spark, sf_dir):
    return spec(t("lineitem"), [Dimension("l_linestatus")], [Metric("count")])


def _filtered(name: str, filters: list[Filter], where: str, table: str = "orders", as_of: dt.date | None = None, derive: Callable[[DataFrame], DataFrame] = lambda d: d) -> None:
    def build(t, spark, sf_dir):
        return spec(derive(t(table)), metrics=[Metric("count")], filters=filters, as_of=as_of)

    build.__name__ = name
    query(f"SELECT count(*) AS row_count FROM {table} WHERE {where}")(build)


_filtered("c14_compare_number", [Filter("o_totalprice", ">=", "100000.5")], "o_totalprice >= 100000.5")
_filtered("c14_compare_text", [Filter("o_orderstatus", "!=", "F")], "o_orderstatus <> 'F'")
_filtered("c15_in", [Filter("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])], "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filtered("c15_not_in", [Filter("o_orderstatus", "not_in", ["F", "O"])], "o_orderstatus NOT IN ('F', 'O')")
_filtered("c16_between", [Filter("o_orderdate", "between", ["1996-01-01", "1996-12-31"])], "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31'")
_filtered("c17_contains", [Filter("c_mktsegment", "contains", "UILD")], "contains(lower(c_mktsegment), 'uild')", "customer")
_filtered("c17_starts_with", [Filter("p_type", "starts_with", "promo")], "starts_with(lower(p_type), 'promo')", "part")
_filtered("c18_is_not_null", [Filter("o_custkey", "is_not_null")], "o_custkey IS NOT NULL")
_filtered("c18_is_null", [Filter("part", "is_null")], "l_quantity > 40", "lineitem", derive=lambda d: d.withColumn("part", F.when(F.col("l_quantity") <= 40, F.col("l_quantity"))))
_filtered("c19_last_n_days", [Filter("o_orderdate", "last_n_days", 30)], "o_orderdate >= DATE '1998-08-02' - INTERVAL 30 DAY", as_of=dt.date(1998, 8, 2))
_filtered("c19_last_n_months", [Filter("o_orderdate", "last_n_months", 3)], "o_orderdate >= DATE '1998-08-02' - INTERVAL 3 MONTH", as_of=dt.date(1998, 8, 2))
_filtered("c20_conjunction", [Filter("o_orderstatus", "=", "F"), Filter("o_totalprice", "<", 50_000)], "o_orderstatus = 'F' AND o_totalprice < 50000")


@query("SELECT l_suppkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 15000", "quantity")
def c21_having(t, spark, sf_dir):
    return spec(t("lineitem"), [Dimension("l_suppkey")], [Metric("sum", "l_quantity", "quantity")], [Filter("quantity", ">", 15_000)])


@query("SELECT p_brand, p_size, count(*) AS row_count FROM part GROUP BY 1, 2 ORDER BY row_count DESC, p_brand, p_size LIMIT 40")
def c22_sort_keys(t, spark, sf_dir):
    return spec(t("part"), [Dimension("p_brand"), Dimension("p_size")], [Metric("count")], sort=[Sort("row_count", True), Sort("P_BRAND"), Sort("p_size")], limit=40)


@query("SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS l_shipdate_month, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 12", "revenue")
def c23_default_order(t, spark, sf_dir):
    return spec(t("lineitem"), [Dimension("l_shipdate", "month")], [Metric("sum", "l_extendedprice", "revenue")], limit=12)


@query("SELECT l_orderkey, sum(l_extendedprice) AS revenue FROM lineitem GROUP BY 1 ORDER BY revenue DESC, l_orderkey LIMIT 25", "revenue")
def c24_top_k(t, spark, sf_dir):
    return spec(t("lineitem"), [Dimension("l_orderkey")], [Metric("sum", "l_extendedprice", "revenue")], sort=[Sort("revenue", True), Sort("l_orderkey")], limit=25)


_ADHOC = """SELECT n_name, count(*) AS orders, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' GROUP BY n_name"""
_WINDOWED = """SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) ranked WHERE place <= 3"""
_SETS = "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000"


@query(_ADHOC, "total")
def c28_adhoc_join(t, spark, sf_dir):
    return adhoc(spark, _ADHOC, {n: t(n) for n in ("orders", "customer", "nation")}, cap=None)


@query(_WINDOWED)
def c28_adhoc_window(t, spark, sf_dir):
    return adhoc(spark, _WINDOWED, {"customer": t("customer")}, cap=None)


@query(_SETS)
def c28_adhoc_set_operation(t, spark, sf_dir):
    return adhoc(spark, _SETS, {n: t(n) for n in ("customer", "supplier")}, cap=None)


# Report packs


@query(f"""SELECT "column", (row_number() OVER (ORDER BY semantic <> 'currency', place))::INT AS rank FROM ({sql_profile('lineitem')})
    WHERE semantic IN ('currency', 'numeric') AND NOT regexp_matches("column", '(?i)pct|percent|rate|ratio|price|score|days|avg|average')""")
def d1_measure_ranking(t, spark, sf_dir):
    facts = [r.asDict() for r in columns.profile_columns(t("lineitem")).select("column", "place", "semantic").collect()]
    return spark.createDataFrame([(c, k + 1) for k, c in enumerate(columns.rank_measures(facts))], "column string, rank int")


@query(f"""SELECT "column", (row_number() OVER (ORDER BY CASE WHEN n_unique BETWEEN 3 AND 12 THEN 0 WHEN n_unique BETWEEN 13 AND 30 THEN 1 ELSE 2 END, n_unique, place))::INT AS rank
    FROM ({sql_profile('lineitem')}) WHERE semantic = 'categorical' AND n_unique BETWEEN 2 AND 30 QUALIFY rank <= 3""")
def d2_dimension_ranking(t, spark, sf_dir):
    return columns.rank_dimensions(columns.profile_columns(t("lineitem")))


@query("SELECT sum(o_totalprice) AS total, count(*) AS records, avg(o_totalprice) AS average FROM orders", "total", "average")
def d3_headline(t, spark, sf_dir):
    return report.headline(t("orders"), "o_totalprice")


@query("SELECT sum(value) AS total, count(*) AS records, avg(value) AS average, count(DISTINCT user_id) AS distinct_keys FROM events", "total", "average")
def d4_headline_keys(t, spark, sf_dir):
    return report.headline(t("events"), "value", key="user_id")


@query("SELECT o_orderstatus AS value, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1", "total")
def d5_headline_by_value(t, spark, sf_dir):
    return report.headline_by_value(t("orders"), "o_totalprice", "o_orderstatus", ["O", "F"])


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate_month, sum(o_totalprice) AS sum_o_totalprice FROM orders GROUP BY 1", "sum_o_totalprice")
def d7_trend(t, spark, sf_dir):
    return report.trend(t("orders"), "o_totalprice", "o_orderdate")


@query("SELECT o_orderpriority, sum(o_totalprice) AS sum_o_totalprice FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", "sum_o_totalprice")
def d8_breakdown(t, spark, sf_dir):
    return report.breakdown(t("orders"), "o_totalprice", "o_orderpriority")


@query("""SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate_month, o_orderstatus, o_orderpriority, sum(o_totalprice) AS sum_o_totalprice
    FROM orders GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2, 3 LIMIT 200""", "sum_o_totalprice")
def d9_detail(t, spark, sf_dir):
    return report.detail(t("orders"), ["o_totalprice"], ["o_orderstatus", "o_orderpriority"], "o_orderdate")


@query("""SELECT 'total' AS tile, NULL::VARCHAR AS key, sum(o_totalprice) AS total FROM orders
    UNION ALL SELECT 'trend', strftime(date_trunc('month', o_orderdate), '%Y-%m-%d'), sum(o_totalprice) FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderstatus', o_orderstatus, sum(o_totalprice) FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, sum(o_totalprice) FROM orders GROUP BY 2""", "total")
def d10_whole_pack(t, spark, sf_dir):
    return report.grouping_pack(t("orders"), "o_totalprice", "o_orderdate", ["o_orderstatus", "o_orderpriority"])


_DETAIL = """SELECT sum(o_totalprice) AS s FROM orders GROUP BY date_trunc('month', o_orderdate), o_orderstatus, o_orderpriority ORDER BY s DESC LIMIT 200"""


@query(f"""SELECT 'kpi' AS tile, 1::BIGINT AS n_rows, sum(o_totalprice) AS total FROM orders
    UNION ALL SELECT 'trend', count(DISTINCT date_trunc('month', o_orderdate)), sum(o_totalprice) FROM orders
    UNION ALL SELECT 'breakdown_o_orderstatus', count(DISTINCT o_orderstatus), sum(o_totalprice) FROM orders
    UNION ALL SELECT 'breakdown_o_orderpriority', count(DISTINCT o_orderpriority), sum(o_totalprice) FROM orders
    UNION ALL SELECT 'detail', count(*), sum(s) FROM ({_DETAIL})""", "total")
def d10_pack(t, spark, sf_dir):
    """Every tile of a pack by its rows and the total of its first measure."""
    found = report.pack(t("orders"), measure="o_totalprice", n_kpis=3)
    total = lambda d: "total" if "total" in d.columns else "sum_o_totalprice"
    tiles = [d.agg(F.lit(n).alias("tile"), F.count(F.lit(1)).alias("n_rows"), F.sum(total(d)).alias("total")) for n, d in found.tiles.items()]
    return reduce(DataFrame.unionByName, tiles)


@query("""SELECT 'events' AS "table", 'value' AS measure, sum(value) AS total, count(*) AS records, avg(value) AS average FROM events
    UNION ALL SELECT 'customer', 'c_custkey', sum(c_custkey), count(*), avg(c_custkey) FROM customer""", "total", "average")
def d11_several_tables(t, spark, sf_dir):
    return report.packs({"events": t("events"), "customer": t("customer")})


@query("SELECT l_returnflag, sum(l_quantity) AS quantity, max(l_tax) AS tax FROM lineitem GROUP BY 1", "quantity", "tax")
def d13_roll_up(t, spark, sf_dir):
    fine = spec(t("lineitem"), [Dimension("l_returnflag"), Dimension("l_linestatus")], [Metric("sum", "l_quantity", "quantity"), Metric("max", "l_tax", "tax")])
    return roll_up(fine, ["l_returnflag"], {"quantity": "sum", "tax": "max"})[0]


@query("SELECT l_returnflag, avg(l_quantity) AS avg_l_quantity FROM lineitem GROUP BY 1", "avg_l_quantity")
def d13_roll_up_exact_average(t, spark, sf_dir):
    return roll_up_exactly(t("lineitem"), ["l_returnflag", "l_linestatus"], ["l_returnflag"], "l_quantity")


# Profiles


@query(f"""SELECT "column", n_rows - n AS n_missing, (n_rows - n) / n_rows AS pct_missing, n_unique, n_unique / n_rows AS pct_unique, n_unique <= 1 AS is_constant FROM ({sql_profile('events')})""", "pct_missing", "pct_unique")
def e1_missing_distinct(t, spark, sf_dir):
    return profile.profile(t("events"), numbers=False).select("column", "n_missing", "pct_missing", "n_unique", "pct_unique", "is_constant")


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS median,
    quantile_cont({c}, 0.75) AS p75, max({c}) AS max FROM lineitem""" for c in _NUMBERS), "mean", "std", "min", "p25", "median", "p75", "max")
def e2_moments_quantiles(t, spark, sf_dir):
    return profile.number_statistics(t("lineitem"), _NUMBERS).select("column", "mean", "std", "min", "p25", "median", "p75", "max")


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", skewness({c}) AS skewness, kurtosis({c}) AS kurtosis FROM lineitem""" for c in _NUMBERS), "skewness", "kurtosis")
def e3_skewness_kurtosis(t, spark, sf_dir):
    return profile.number_statistics(t("lineitem"), _NUMBERS, statistics=("skewness", "kurtosis"))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", avg(({c} = 0)::INT) AS pct_zero, avg(({c} < 0)::INT) AS pct_negative FROM {t}""" for t in ("lineitem",) for c, kind in TABLES["lineitem"] if kind in ("integer", "real")), "pct_zero", "pct_negative")
def e4_zero_negative(t, spark, sf_dir):
    return profile.number_statistics(t("lineitem"), statistics=("pct_zero", "pct_negative"))


@query(" UNION ALL ".join(f"""SELECT "column", value AS top_value, n / (SELECT count(*) FROM orders) AS top_share FROM ({SQL_TOP.format(c=c, t='orders')}) WHERE rank = 1""" for c in ("o_orderstatus", "o_orderpriority")), "top_share")
def e5_top_value(t, spark, sf_dir):
    return profile.profile(t("orders"), numbers=False).filter("top_value IS NOT NULL").select("column", "top_value", "top_share")


@query(f"""SELECT "column", semantic IN ('categorical', 'text', 'identifier') AND n_unique > 50 AND n_unique > 0.1 * n AS high_cardinality FROM ({sql_profile('customer')})""")
def e6_high_cardinality(t, spark, sf_dir):
    return profile.profile(t("customer"), numbers=False).select("column", "high_cardinality")


@query(f"""SELECT bucket, string_agg("column", ',' ORDER BY "column") AS columns FROM (SELECT "column", CASE WHEN semantic IN ('numeric', 'currency') THEN 'numeric'
    WHEN semantic IN ('categorical', 'geo', 'boolean') THEN 'categorical' WHEN semantic IN ('temporal', 'text') THEN semantic END AS bucket FROM ({sql_profile('lineitem')})) WHERE bucket IS NOT NULL GROUP BY 1""")
def e7_buckets(t, spark, sf_dir):
    return profile.buckets(columns.profile_columns(t("lineitem")))


@query(f"""SELECT "column" FROM ({sql_profile('part')}) WHERE n_unique >= 0.99 * n_rows AND n = n_rows""")
def e8_candidate_keys(t, spark, sf_dir):
    return profile.profile(t("part"), numbers=False).filter("candidate_key").select("column")


@query("SELECT count(*) + count_if(l_quantity < 3) AS n_rows, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_quantity < 3))) + (SELECT count(*) FROM lineitem WHERE l_quantity < 3) AS n_duplicates FROM lineitem")
def e9_duplicate_rows(t, spark, sf_dir):
    """lineitem with some of its rows a second time."""
    return profile.duplicate_rows(t("lineitem").unionByName(t("lineitem").filter("l_quantity < 3")))


@query("SELECT sum(32 + strlen(o_orderstatus) + strlen(o_orderpriority)) / 1e6 AS size_mb FROM orders", "size_mb")
def e10_size(t, spark, sf_dir):
    return profile.row_bytes(t("orders"))


@query(f"""SELECT "column" FROM ({sql_profile('lineitem')}) WHERE kind IN ('integer', 'real') AND n_unique > 2""")
def e11_numeric_matrix(t, spark, sf_dir):
    return profile.numeric_matrix_columns(columns.profile_columns(t("lineitem")))


_SQL_GAPS = "SELECT epoch({c} - lag({c}) OVER (ORDER BY {c})) / 86400 AS g FROM {t}"


@query(f"""SELECT median(g) AS median_gap_days, CASE WHEN median(g) <= 1.5 THEN 'D' WHEN median(g) <= 9 THEN 'W' WHEN median(g) <= 45 THEN 'MS' WHEN median(g) <= 120 THEN 'QS' ELSE 'YS' END AS freq
    FROM ({_SQL_GAPS.format(c='ts', t='events')}) WHERE g IS NOT NULL""", "median_gap_days")
def e12_frequency(t, spark, sf_dir):
    return series.frequency(t("events"), "ts")


_SQL_WEEKS = """SELECT 'all' AS entity, s.t, coalesce(v.value, 0) AS value, row_number() OVER (ORDER BY s.t) - 1 AS idx FROM (
    SELECT unnest(generate_series(min(w), max(w), INTERVAL 7 DAY)) AS t FROM (SELECT date_trunc('week', o_orderdate)::TIMESTAMP + INTERVAL 6 DAY AS w FROM orders)) s
    LEFT JOIN (SELECT date_trunc('week', o_orderdate)::TIMESTAMP + INTERVAL 6 DAY AS t, sum(o_custkey)::DOUBLE AS value FROM orders GROUP BY 1) v USING (t)"""
_SQL_DAYS = """SELECT 'all' AS entity, s.t, coalesce(v.value, 0) AS value, row_number() OVER (ORDER BY s.t) - 1 AS idx FROM (
    SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS t FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS d FROM events)) s
    LEFT JOIN (SELECT date_trunc('day', ts)::TIMESTAMP AS t, sum(value)::DOUBLE AS value FROM events GROUP BY 1) v USING (t)"""


@query(_SQL_WEEKS, "value")
def e13_regular_series(t, spark, sf_dir):
    return series.regular_series(t("orders"), "o_orderdate", "o_custkey", "W")


@query(f"""SELECT 'all' AS entity, count(*) AS n, regr_slope(value, idx) AS slope, regr_r2(value, idx) AS r2,
    sqrt(regr_r2(value, idx) * (count(*) - 2) / (1 - regr_r2(value, idx))) * sign(regr_slope(value, idx)) AS t FROM ({_SQL_DAYS})""", "slope", "r2", "t")
def e14_trend(t, spark, sf_dir):
    return series.trend(series.regular_series(t("events"), "ts", "value", "D"))


# Findings: kind, severity, columns and the statistic


def found(frame: DataFrame) -> DataFrame:
    return frame.select("kind", "severity", F.array_join("columns", ",").alias("columns"), "statistic")


def with_gaps(t) -> DataFrame:
    """lineitem with gaps that go together, by its own values."""
    late = F.col("l_linenumber") >= 5
    return t("lineitem").select("l_orderkey", F.when(~late, F.col("l_tax")).alias("a"), F.when(~late, F.col("l_discount")).alias("b"), F.when(F.col("l_quantity") > 4, F.col("l_quantity")).alias("c"))


_SQL_GAPPED = "SELECT l_orderkey, CASE WHEN l_linenumber < 5 THEN l_tax END AS a, CASE WHEN l_linenumber < 5 THEN l_discount END AS b, CASE WHEN l_quantity > 4 THEN l_quantity END AS c FROM lineitem"


@query(" UNION ALL ".join(f"""SELECT 'missing_data' AS kind, CASE WHEN p >= 0.3 THEN 'strong' ELSE 'notable' END AS severity, '{c}' AS columns, p AS statistic
    FROM (SELECT 1 - count({c}) / count(*) AS p FROM ({_SQL_GAPPED})) WHERE p >= 0.05""" for c in "abc"), "statistic")
def f1_missing_data(t, spark, sf_dir):
    return found(patterns.missing_data(profile.profile(with_gaps(t), numbers=False)))


@query(f"""SELECT 'structured_missingness' AS kind, 'notable' AS severity, 'a,b' AS columns, corr((a IS NULL)::INT, (b IS NULL)::INT) AS statistic FROM ({_SQL_GAPPED})""", "statistic")
def f2_structured_missingness(t, spark, sf_dir):
    return found(patterns.structured_missingness(with_gaps(t), ["a", "b", "c"]))


@query("SELECT 'constant_columns' AS kind, 'notable' AS severity, 'k' AS columns, 1.0::DOUBLE AS statistic FROM region HAVING count(*) > 0")
def f3_constant_columns(t, spark, sf_dir):
    return found(patterns.constant_columns(profile.profile(t("region").withColumn("k", F.length("r_name") * 0), numbers=False)))


_DUP = "(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem))) / count(*)"


@query(f"SELECT 'duplicate_rows' AS kind, CASE WHEN {_DUP} > 0.05 THEN 'strong' ELSE 'notable' END AS severity, '' AS columns, {_DUP} AS statistic FROM lineitem", "statistic")
def f4_duplicate_rows(t, spark, sf_dir):
    return found(patterns.duplicates(t("lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")))


@query(f"""SELECT 'high_cardinality' AS kind, 'notable' AS severity, "column" AS columns, n_unique::DOUBLE AS statistic FROM ({sql_profile('customer')}) WHERE semantic IN ('categorical', 'text', 'identifier') AND n_unique > 50 AND n_unique > 0.1 * n""")
def f5_high_cardinality(t, spark, sf_dir):
    return found(patterns.high_cardinality(profile.profile(t("customer"), numbers=False)))


@query(f"""SELECT 'free_text' AS kind, 'info' AS severity, "column" AS columns, mean_length AS statistic FROM ({sql_profile('customer')}) WHERE semantic = 'text'""", "statistic")
def f6_free_text(t, spark, sf_dir):
    return found(patterns.free_text(profile.profile(t("customer"), numbers=False)))


_CUBED = "SELECT o_orderkey, o_totalprice * o_totalprice * o_totalprice AS cubed, o_totalprice AS plain, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS closed FROM orders"


def cubed(t) -> DataFrame:
    p = F.col("o_totalprice")
    return t("orders").select("o_orderkey", (p * p * p).alias("cubed"), p.alias("plain"), F.when(F.col("o_orderstatus") == "F", p).otherwise(0.0).alias("closed"))


@query(" UNION ALL ".join(f"SELECT 'skewed_distribution' AS kind, CASE WHEN abs(s) >= 2 THEN 'strong' ELSE 'notable' END AS severity, '{c}' AS columns, s AS statistic FROM (SELECT skewness({c}) AS s FROM ({_CUBED})) WHERE abs(s) >= 1" for c in ("o_orderkey", "cubed", "plain", "closed")), "statistic")
def f7_skewed(t, spark, sf_dir):
    return found(patterns.skewed(profile.profile(cubed(t))))


@query(f"SELECT 'zero_inflation' AS kind, 'notable' AS severity, 'closed' AS columns, avg((closed = 0)::INT) AS statistic FROM ({_CUBED}) HAVING avg((closed = 0)::INT) > 0.5", "statistic")
def f8_zero_inflation(t, spark, sf_dir):
    return found(patterns.zero_inflation(profile.profile(cubed(t))))


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", any_value(q1 - 1.5 * (q3 - q1)) AS low, any_value(q3 + 1.5 * (q3 - q1)) AS high, count(*) AS n, count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS n_out
    FROM (SELECT {c} FROM ({_CUBED})), (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM ({_CUBED})) WHERE q3 > q1""" for c in ("plain", "closed")), "low", "high")
def f9_outliers(t, spark, sf_dir):
    return patterns.outlier_counts(cubed(t), ["plain", "closed"])


_PAIRS = (("plain", "cubed"), ("plain", "closed"), ("cubed", "closed"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS value, count(*) AS n FROM ({_CUBED})" for a, b in _PAIRS), "value")
def f10_correlation(t, spark, sf_dir):
    return patterns.correlations(cubed(t), ["plain", "cubed", "closed"]).drop("p_value")


@query(f"""WITH r AS (SELECT plain, closed, rank() OVER (ORDER BY plain) + (count(*) OVER (PARTITION BY plain) - 1) / 2 AS x, rank() OVER (ORDER BY closed) + (count(*) OVER (PARTITION BY closed) - 1) / 2 AS y FROM ({_CUBED}))
    SELECT 'plain' AS a, 'closed' AS b, corr(x, y) AS rho, corr(plain, closed) AS r, count(*) AS n FROM r""", "rho", "r")
def f11_rank_correlation(t, spark, sf_dir):
    return patterns.rank_correlation(cubed(t), "plain", "closed")


@query(f"""SELECT 'correlation' AS kind, 'strong' AS severity, a || ',' || b AS columns, value AS statistic, 0.0::DOUBLE AS p_value FROM (SELECT 'plain' AS a, 'cubed' AS b, corr(plain, cubed) AS value FROM ({_CUBED})
    UNION ALL SELECT 'plain', 'closed', corr(plain, closed) FROM ({_CUBED}) UNION ALL SELECT 'cubed', 'closed', corr(cubed, closed) FROM ({_CUBED})) WHERE abs(value) >= 0.85
    UNION ALL SELECT 'correlation', 'notable', a || ',' || b, value, 0.0 FROM (SELECT 'plain' AS a, 'cubed' AS b, corr(plain, cubed) AS value FROM ({_CUBED})
    UNION ALL SELECT 'plain', 'closed', corr(plain, closed) FROM ({_CUBED}) UNION ALL SELECT 'cubed', 'closed', corr(cubed, closed) FROM ({_CUBED})) WHERE abs(value) >= 0.6 AND abs(value) < 0.85""", "statistic")
def f10_correlation_findings(t, spark, sf_dir):
    return patterns.correlation(cubed(t), ["plain", "cubed", "closed"]).select("kind", "severity", F.array_join("columns", ",").alias("columns"), "statistic", "p_value")


_POWERS = "SELECT l_quantity AS quantity, power(l_quantity, 8) AS power, l_tax AS tax, CASE WHEN l_linenumber < 5 THEN power(l_quantity, 12) END AS gappy FROM lineitem"
_RANKED = """SELECT '{a},{b}' AS columns, corr(x, y) AS rho, corr(p, q) AS r FROM (SELECT {a} AS p, {b} AS q, rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS x,
    rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS y FROM ({t}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"""
_POWER_PAIRS = (("quantity", "power"), ("quantity", "tax"), ("quantity", "gappy"), ("power", "tax"), ("power", "gappy"), ("tax", "gappy"))


def powers(t) -> DataFrame:
    q = F.col("l_quantity")
    return t("lineitem").select(q.alias("quantity"), F.pow(q, F.lit(8)).alias("power"), F.col("l_tax").alias("tax"), F.when(F.col("l_linenumber") < 5, F.pow(q, F.lit(12))).alias("gappy"))


@query(" UNION ALL ".join(f"SELECT 'nonlinear_relationship' AS kind, CASE WHEN abs(rho) - abs(r) >= 0.2 THEN 'notable' ELSE 'info' END AS severity, columns, rho AS statistic FROM ({_RANKED.format(a=a, b=b, t=_POWERS)}) WHERE abs(rho) >= 0.6 AND abs(rho) - abs(r) >= 0.1" for a, b in _POWER_PAIRS), "statistic")
def f11_nonlinear(t, spark, sf_dir):
    """Ranks of four columns, one with gaps, and the pairs that go together along a curve."""
    return found(patterns.nonlinear(powers(t), ["quantity", "power", "tax", "gappy"]))


_VIF = f"""WITH m AS (SELECT count(*) AS n, corr(plain, cubed) AS p, corr(plain, closed) AS q, corr(cubed, closed) AS s FROM ({_CUBED})),
    d AS (SELECT *, 1 + 2 * p * q * s - p * p - q * q - s * s AS det FROM m)
    SELECT 'plain' AS "column", (1 - s * s) / det AS vif, 1 - det / (1 - s * s) AS r2, n FROM d
    UNION ALL SELECT 'cubed', (1 - q * q) / det, 1 - det / (1 - q * q), n FROM d UNION ALL SELECT 'closed', (1 - p * p) / det, 1 - det / (1 - p * p), n FROM d"""


@query(_VIF, "vif", "r2")
def f12_multicollinearity(t, spark, sf_dir):
    return patterns.inflation_factors(cubed(t), ["plain", "cubed", "closed"])


_NETS = "SELECT l_tax AS tax, l_quantity AS quantity, l_extendedprice * (1 - l_discount) AS net, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS total FROM lineitem"


@query(f"""WITH m AS (SELECT corr(tax, net) AS p, corr(tax, total) AS q, corr(net, total) AS s FROM ({_NETS})), d AS (SELECT *, 1 + 2 * p * q * s - p * p - q * q - s * s AS det FROM m),
    v AS (SELECT 'tax' AS columns, (1 - s * s) / det AS v FROM d UNION ALL SELECT 'net', (1 - q * q) / det FROM d UNION ALL SELECT 'total', (1 - p * p) / det FROM d)
    SELECT 'multicollinearity' AS kind, CASE WHEN v >= 30 THEN 'strong' ELSE 'notable' END AS severity, columns, v AS statistic FROM v WHERE v >= 10""", "statistic")
def f12_multicollinearity_findings(t, spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return found(patterns.multicollinearity(t("lineitem").select(F.col("l_tax").alias("tax"), net.alias("net"), (net * (1 + F.col("l_tax"))).alias("total")), ["tax", "net", "total"]))


@query("SELECT 'temporal_coverage' AS kind, 'info' AS severity, 'ts' AS columns, date_diff('day', min(ts), max(ts))::DOUBLE AS statistic FROM events")
def f13_temporal_coverage(t, spark, sf_dir):
    return found(patterns.temporal(t("events"), "ts").filter("kind = 'temporal_coverage'"))


_WEEKDAYS = "SELECT DISTINCT date_trunc('day', o_orderdate)::TIMESTAMP AS o_orderdate FROM orders WHERE month(o_orderdate) NOT IN (5, 6)"


@query(f"""WITH g AS ({_SQL_GAPS.format(c='o_orderdate', t=f'({_WEEKDAYS})')}) SELECT 'temporal_gaps' AS kind, 'notable' AS severity, 'o_orderdate' AS columns, count(*)::DOUBLE AS statistic
    FROM g WHERE g > 5 * (SELECT median(g) FROM g)""")
def f14_temporal_gaps(t, spark, sf_dir):
    days = t("orders").filter(~F.month("o_orderdate").isin(5, 6)).select(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("o_orderdate")).distinct()
    return found(patterns.temporal(days, "o_orderdate").filter("kind = 'temporal_gaps'"))


_RAMP = "SELECT o_orderdate, o_orderpriority, (o_totalprice * date_diff('month', TIMESTAMP '1995-01-01', o_orderdate))::DOUBLE AS amount FROM orders WHERE o_orderdate < TIMESTAMP '2001-08-01'"
_SQL_SUMS = f"SELECT o_orderpriority AS entity, date_trunc('month', o_orderdate)::TIMESTAMP AS t, sum(amount) AS value FROM ({_RAMP}) GROUP BY 1, 2"
_SQL_MONTHS = f"""SELECT s.entity, s.t, coalesce(v.value, 0) AS value, row_number() OVER (PARTITION BY s.entity ORDER BY s.t) - 1 AS idx
    FROM (SELECT entity, unnest(generate_series(min(t), max(t), INTERVAL 1 MONTH)) AS t FROM ({_SQL_SUMS}) GROUP BY 1) s LEFT JOIN ({_SQL_SUMS}) v USING (entity, t)"""


def ramp(t) -> DataFrame:
    months = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    return t("orders").filter(F.col("o_orderdate") < F.lit(dt.datetime(2001, 8, 1)).cast("timestamp_ntz")).select("o_orderdate", "o_orderpriority", (F.col("o_totalprice") * months).alias("amount"))


@query(f"""SELECT 'trend' AS kind, CASE WHEN r2 >= 0.6 THEN 'strong' ELSE 'notable' END AS severity, 'amount' AS columns, r2 AS statistic
    FROM (SELECT entity, regr_r2(value, idx) AS r2, count(*) AS n FROM ({_SQL_MONTHS}) GROUP BY 1) WHERE r2 >= 0.25 AND sqrt(r2 * (n - 2) / (1 - r2)) > 2""", "statistic")
def f15_trend(t, spark, sf_dir):
    return found(patterns.series_findings(ramp(t), "o_orderdate", "amount", "MS", "o_orderpriority").filter("kind = 'trend'"))


@query(f"""WITH l AS (SELECT *, regr_slope(value, idx) OVER w AS a, regr_intercept(value, idx) OVER w AS b FROM ({_SQL_MONTHS}) WINDOW w AS (PARTITION BY entity)),
    e AS (SELECT entity, idx, value - a * idx - b AS e FROM l), d AS (SELECT entity, idx, e - avg(e) OVER (PARTITION BY entity) AS d FROM e)
    SELECT x.entity, count(*) AS n, sum(x.d * y.d) / sum(x.d * x.d) AS acf FROM d x LEFT JOIN d y ON x.entity = y.entity AND y.idx = x.idx - 12 GROUP BY 1""", "acf")
def f16_seasonality(t, spark, sf_dir):
    return series.autocorrelation(series.regular_series(ramp(t), "o_orderdate", "amount", "MS", "o_orderpriority"), 12)


@query()
def f17_changepoint(t, spark, sf_dir):
    step = F.when(F.col("l_shipdate") >= F.lit(dt.datetime(1998, 6, 1)).cast("timestamp_ntz"), 1.4).otherwise(1.0)
    rows = t("lineitem").select("l_shipdate", "l_returnflag", (F.col("l_quantity") * step).alias("moved"))
    return found(patterns.series_findings(rows, "l_shipdate", "moved", "MS", "l_returnflag").filter("kind = 'changepoint'"))


@query(f"""SELECT *, greatest(first_std, second_std) / least(first_std, second_std) AS ratio FROM (SELECT entity, stddev_pop(value) FILTER (idx < n // 2) AS first_std, stddev_pop(value) FILTER (idx >= n // 2) AS second_std
    FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n FROM ({_SQL_MONTHS})) GROUP BY 1)""", "first_std", "second_std", "ratio")
def f18_variance_drift(t, spark, sf_dir):
    return series.half_spread(series.regular_series(ramp(t), "o_orderdate", "amount", "MS", "o_orderpriority"))


@query("""SELECT 'class_imbalance' AS kind, CASE WHEN r >= 20 THEN 'strong' ELSE 'notable' END AS severity, 'quality' AS columns, r AS statistic
    FROM (SELECT max(n) / min(n) AS r, count(*) AS k FROM (SELECT quality, count(*) AS n FROM labels GROUP BY 1)) WHERE r >= 5 AND k BETWEEN 2 AND 50""", "statistic")
def f19_class_imbalance(t, spark, sf_dir):
    return found(patterns.class_findings(t("labels"), "quality").filter("kind = 'class_imbalance'"))


@query("SELECT count(*) AS n_classes, max(n) AS largest, min(n) AS smallest, sum(n)::BIGINT AS n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)")
def f20_class_sizes(t, spark, sf_dir):
    return patterns.class_sizes(t("part"), "p_brand")


@query("""SELECT 'rare_classes' AS kind, 'notable' AS severity, 'kind' AS columns, min(n)::DOUBLE AS statistic FROM (SELECT CASE WHEN p_partkey <= 7 THEN 'rare' ELSE p_brand END AS kind, count(*) AS n FROM part GROUP BY 1) HAVING min(n) < 10 AND count(*) >= 2""")
def f20_rare_classes(t, spark, sf_dir):
    kind = F.when(F.col("p_partkey") <= 7, "rare").otherwise(F.col("p_brand"))
    return found(patterns.class_findings(t("part").select(kind.alias("kind")), "kind").filter("kind = 'rare_classes'"))


@query(f"SELECT 'target_leakage' AS kind, 'strong' AS severity, 'restated,plain' AS columns, corr(plain * 1.0001 + o_orderkey % 7, plain) AS statistic FROM ({_CUBED})", "statistic")
def f21_target_leakage(t, spark, sf_dir):
    rows = cubed(t).withColumn("restated", F.col("plain") * 1.0001 + F.col("o_orderkey") % 7)
    return found(patterns.target_findings(rows, "plain", ["restated", "o_orderkey"]).filter("kind = 'target_leakage'"))


@query(f"SELECT 'predictive_feature' AS kind, 'info' AS severity, 'cubed,plain' AS columns, corr(cubed, plain) AS statistic FROM ({_CUBED}) HAVING abs(corr(cubed, plain)) BETWEEN 0.4 AND 0.9499999", "statistic")
def f22_predictive_feature(t, spark, sf_dir):
    return found(patterns.target_findings(cubed(t), "plain", ["cubed"]).filter("kind = 'predictive_feature'"))


@query(" UNION ALL ".join(f"""SELECT '{g}' AS "column", 1 - sum(n * v) / (any_value(tn) * any_value(tv)) AS eta2, sum(n)::BIGINT AS n, count(*) AS n_groups
    FROM (SELECT {g}, count(*) AS n, var_pop(l_extendedprice) AS v FROM lineitem GROUP BY 1), (SELECT count(*) AS tn, var_pop(l_extendedprice) AS tv FROM lineitem)""" for g in ("l_returnflag", "l_linestatus", "l_linenumber")), "eta2")
def f23_group_effect(t, spark, sf_dir):
    return patterns.variance_explained(t("lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus", "l_linenumber"])


@query()
def f24_cluster_structure(t, spark, sf_dir):
    return found(patterns.cluster_structure(t("part"), ["p_size", "p_retailprice"]))


_OFFERS = f"SELECT o_orderpriority, plain, cubed, closed, CASE WHEN plain > 100000 THEN o_orderkey % 7 END AS late, CASE WHEN plain > 100000 THEN o_orderkey % 11 END AS later, 1 AS same FROM (SELECT o_orderpriority, o.o_orderkey, plain, cubed, closed FROM orders o JOIN ({_CUBED}) c ON o.o_orderkey = c.o_orderkey)"
_OFFER_NUMBERS = ("plain", "cubed", "closed", "late", "later")


def offers(t) -> DataFrame:
    some = F.col("o_totalprice") > 100_000
    rows = t("orders").select("o_orderkey", "o_orderpriority", F.when(some, F.col("o_orderkey") % 7).alias("late"), F.when(some, F.col("o_orderkey") % 11).alias("later"), F.lit(1).alias("same"))
    return cubed(t).join(rows, "o_orderkey").select("o_orderpriority", "plain", "cubed", "closed", "late", "later", "same")


def sql_all_findings() -> str:
    """The single findings about one table without times, put together. Detectors that find nothing there stay in."""
    t, pairs = f"({_OFFERS})", [(a, b) for k, a in enumerate(_OFFER_NUMBERS) for b in _OFFER_NUMBERS[k + 1 :]]
    row = lambda kind, level, columns, statistic, source: f"SELECT '{kind}' AS kind, {level} AS severity, {columns} AS columns, ({statistic})::DOUBLE AS statistic FROM ({source})"
    of = lambda v, notable, strong: f"CASE WHEN {v} >= {strong} THEN 'strong' WHEN {v} >= {notable} THEN 'notable' END"
    both = lambda a, b: f"SELECT '{a},{b}' AS c, corr({a}, {b}) AS v, count(*) AS n FROM {t} WHERE {a} IS NOT NULL AND {b} IS NOT NULL"
    out = [row("missing_data", of("v", 0.05, 0.3), f"'{c}'", "v", f"SELECT 1 - count({c}) / count(*) AS v FROM {t}") for c in (*_OFFER_NUMBERS, "o_orderpriority", "same")]
    out.append(row("structured_missingness", "CASE WHEN v > 0.8 THEN 'notable' END", "'late,later'", "v", f"SELECT corr((late IS NULL)::INT, (later IS NULL)::INT) AS v FROM {t}"))
    out.append(row("constant_columns", "'notable'", "'same'", "v", f"SELECT count(DISTINCT same) AS v FROM {t}"))
    out.append(row("duplicate_rows", "CASE WHEN v > 0.05 THEN 'strong' WHEN v > 0.001 THEN 'notable' END", "''", "v", f"SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t}))) / count(*) AS v FROM {t}"))
    for c in _OFFER_NUMBERS:
        out.append(row("skewed_distribution", of("abs(v)", 1, 2), f"'{c}'", "v", f"SELECT skewness({c}) AS v FROM {t}"))
        out.append(row("zero_inflation", "CASE WHEN v > 0.5 THEN 'notable' END", f"'{c}'", "v", f"SELECT avg(({c} = 0)::INT) AS v FROM {t}"))
        out.append(row("outliers", of("v", 0.01, 0.05), f"'{c}'", "v", f"SELECT avg(({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1))::INT) AS v FROM {t}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {t}) WHERE q3 > q1 HAVING count({c}) >= 20"))
    for a, b in pairs:
        out.append(row("correlation", of("abs(v)", 0.6, 0.85), "c", "v", both(a, b)))
        out.append(row("nonlinear_relationship", "CASE WHEN abs(rho) >= 0.6 AND abs(rho) - abs(r) >= 0.2 THEN 'notable' WHEN abs(rho) >= 0.6 AND abs(rho) - abs(r) >= 0.1 THEN 'info' END", "columns", "rho", _RANKED.format(a=a, b=b, t=_OFFERS)))
    for a in _OFFER_NUMBERS[1:]:
        pair = both(a, "plain")
        out.append(row("target_leakage", "CASE WHEN abs(v) >= 0.95 AND n >= 10 THEN 'strong' END", "c", "v", pair))
        out.append(row("predictive_feature", "CASE WHEN abs(v) >= 0.4 AND abs(v) < 0.95 AND n >= 10 THEN 'info' END", "c", "v", pair))
    out.append(row("group_effect", of("v", 0.15, 0.5), "'o_orderpriority,plain'", "v", f"SELECT 1 - sum(n * s) / (any_value(tn) * any_value(ts)) AS v FROM (SELECT count(*) AS n, var_pop(plain) AS s FROM {t} GROUP BY o_orderpriority), (SELECT count(*) AS tn, var_pop(plain) AS ts FROM {t})"))
    return f"SELECT * FROM ({' UNION ALL '.join(out)}) WHERE severity IS NOT NULL"


@query(sql_all_findings(), "statistic")
def f26_detect_all(t, spark, sf_dir):
    """All findings about orders with some derived columns. What five columns say of each other jointly has a query of its own."""
    frame = offers(t)
    return found(patterns.detect_all(frame, profile.profile(frame), "plain").filter("kind <> 'multicollinearity'"))


@query()
def f26_detect_all_series(t, spark, sf_dir):
    frame = t("orders").select("o_orderdate", "o_totalprice", "o_orderstatus")
    return found(patterns.detect_all(frame, profile.profile(frame)))


# Model readiness


@query(f"""SELECT "column", CASE WHEN semantic = 'text' THEN 'text_classification' WHEN kind IN ('integer', 'real') AND n_unique = 2 THEN 'binary_classification'
    WHEN kind IN ('integer', 'real') AND n_unique <= 15 AND n_unique / n_rows < 0.05 THEN 'multiclass_classification' WHEN kind IN ('integer', 'real') THEN 'regression'
    WHEN n_unique = 2 THEN 'binary_classification' WHEN n_unique BETWEEN 3 AND 100 THEN 'multiclass_classification' ELSE 'none' END AS task FROM ({sql_profile('lineitem')})""")
def g1_task_inference(t, spark, sf_dir):
    return readiness.tasks(t("lineitem"))


@query("SELECT date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) >= 60 AS forecastable, date_diff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE)::INT AS span_days FROM orders")
def g2_forecastable(t, spark, sf_dir):
    return readiness.forecastable(profile.profile(t("orders"), numbers=False))


@query()
def g3_ranked_advice(t, spark, sf_dir):
    out = None
    for name, task, target in (("events", "forecasting", "value"), ("customer", "regression", "c_acctbal")):
        p = profile.profile(t(name))
        facts = readiness.facts_of(patterns.detect_all(t(name), p, target), p)
        rows = readiness.advise(facts.withColumn("table", F.lit(name)).withColumn("task", F.lit(task)))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""SELECT "column", CASE WHEN kind IN ('integer', 'real') THEN 'number' ELSE 'category' END AS use FROM ({sql_profile('orders')}) WHERE "column" <> 'o_totalprice' AND semantic NOT IN ('text', 'temporal')
    AND (kind IN ('integer', 'real') OR n_unique <= 30)""")
def g4_feature_selection(t, spark, sf_dir):
    return readiness.feature_columns(profile.profile(t("orders"), numbers=False), "o_totalprice")


@query(f"SELECT 'restated' AS \"column\", corr(plain * 1.0001 + o_orderkey % 7, plain) AS r FROM ({_CUBED})", "r")
def g5_leakage_removal(t, spark, sf_dir):
    return readiness.leaking(cubed(t).withColumn("restated", F.col("plain") * 1.0001 + F.col("o_orderkey") % 7), "plain", ["restated", "closed"])


@query("SELECT o_orderpriority AS label, row_number() OVER (ORDER BY n DESC, o_orderpriority) - 1 AS code FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1)")
def g6_label_encoding(t, spark, sf_dir):
    return readiness.label_codes(t("orders"), "o_orderpriority")


@query("SELECT l_orderkey, c FROM (SELECT l_orderkey, CASE WHEN l_quantity > 45 THEN l_quantity END AS c FROM lineitem) WHERE c IS NOT NULL")
def g7_row_preparation(t, spark, sf_dir):
    return readiness.prepared_rows(t("lineitem").select("l_orderkey", F.when(F.col("l_quantity") > 45, F.col("l_quantity")).alias("c")), "c")


@query("""WITH f AS (SELECT o_orderkey % 4 AS fold, o_totalprice AS y FROM orders), s AS (SELECT fold, sum(y) AS s, count(*) AS c FROM f GROUP BY 1),
    g AS (SELECT fold, ((SELECT sum(s) FROM s) - s) / ((SELECT sum(c) FROM s) - c) AS guess FROM s)
    SELECT fold, count(*) AS n, avg(abs(y - guess)) AS mae, sqrt(avg((y - guess) ** 2)) AS rmse, 1 - avg((y - guess) ** 2) / var_pop(y) AS r2 FROM f JOIN g USING (fold) GROUP BY 1""", "mae", "rmse", "r2")
def g10_trivial_baseline(t, spark, sf_dir):
    return readiness.trivial_regression(t("orders").withColumn("fold", F.col("o_orderkey") % 4), "o_totalprice")


_KINDS = "CASE WHEN l_orderkey % 400 = 0 THEN 'rare' WHEN l_orderkey % 3 > 0 THEN l_returnflag END"


@query(f"""WITH k AS (SELECT {_KINDS} AS kind FROM lineitem), c AS (SELECT kind, count(*) AS n, count(*) >= 0.01 * (SELECT count(*) FROM k) AS known FROM k WHERE kind IS NOT NULL GROUP BY 1)
    SELECT CASE WHEN known THEN v ELSE '(others)' END AS kind, count(*) AS n FROM (SELECT coalesce(kind, (SELECT kind FROM c ORDER BY n DESC, kind LIMIT 1)) AS v FROM k) LEFT JOIN c ON v = c.kind GROUP BY 1""")
def g8_rare_and_missing_categories(t, spark, sf_dir):
    rows = t("lineitem").select(F.expr(_KINDS).alias("kind"))
    done = readiness.with_categories(rows, readiness.known_categories(rows, ["kind"]))
    return done.groupBy(F.when(F.col("kind") == readiness.OTHERS, "(others)").otherwise(F.col("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderpriority, f AS fold, n // 5 + (f < n % 5)::INT AS n FROM (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), (SELECT unnest(range(5))::INT AS f)""")
def g11_folds(t, spark, sf_dir):
    """Rows of each class in each of five folds: no two folds differ by more than one."""
    dealt = readiness.stratified_folds(t("orders"), "o_orderpriority", ["o_orderkey"], 5)
    return dealt.groupBy("o_orderpriority", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS n_keys, 6 AS n_folds, true AS in_order FROM orders")
def g11_time_folds(t, spark, sf_dir):
    """Every row lies in one fold, and each fold begins after the one before it has ended."""
    dealt = readiness.time_folds(t("orders"), "o_orderdate", 5)
    per = dealt.groupBy("fold").agg(F.min("o_orderdate").alias("low"), F.max("o_orderdate").alias("high"), F.count(F.lit(1)).alias("n"))
    later = per.alias("a").join(per.alias("b"), F.col("a.fold") + 1 == F.col("b.fold")).agg(F.coalesce(F.bool_and(F.col("a.high") < F.col("b.low")), F.lit(False)).alias("in_order"))  # six rows
    counts = dealt.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("n_keys"), F.count_distinct("fold").cast("int").alias("n_folds"))
    return counts.join(F.broadcast(later))


@query("SELECT avg(abs(0.1 * o_totalprice - 900)) AS mae, sqrt(avg((0.1 * o_totalprice - 900) ** 2)) AS rmse, 1 - avg((0.1 * o_totalprice - 900) ** 2) / var_pop(o_totalprice) AS r2 FROM orders", "mae", "rmse", "r2")
def g12_regression_metrics(t, spark, sf_dir):
    guessed = t("orders").select(F.col("o_totalprice").alias("label"), (0.9 * F.col("o_totalprice") + 900).alias("prediction"))
    m = readiness.regression_metrics(guessed)
    return spark.createDataFrame([(m["mae"], m["rmse"], m["r2"])], "mae double, rmse double, r2 double")


@query("""WITH g AS (SELECT (o_custkey % 3)::INT AS y, CASE WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 3)::INT ELSE (o_custkey % 3)::INT END AS p FROM orders),
    c AS (SELECT k, count_if(y = k AND p = k) AS hit, count_if(y = k) AS own, count_if(p = k) AS said FROM g, (SELECT unnest(range(3)) AS k) GROUP BY 1)
    SELECT avg(hit / own) AS balanced_accuracy, avg(2 * hit / (own + said)) AS macro_f1 FROM c""", "balanced_accuracy", "macro_f1")
def g12_class_metrics(t, spark, sf_dir):
    own = F.col("o_custkey") % 3
    guessed = t("orders").select(own.cast("double").alias("label"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey") % 3).otherwise(own).cast("double").alias("prediction"))
    m = readiness.class_metrics(guessed)
    return spark.createDataFrame([(m["balanced_accuracy"], m["macro_f1"])], "balanced_accuracy double, macro_f1 double")


_SCORED = "SELECT (o_totalprice > 150000)::INT AS label, round(o_totalprice / 50000 + o_orderkey % 7, 1) AS score FROM orders"


@query(f"""WITH s AS (SELECT score, count(*) AS n, sum(label) AS p FROM ({_SCORED}) GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY score) - n AS below, sum(n) OVER (ORDER BY score DESC) AS seen,
    sum(p) OVER (ORDER BY score DESC) AS hits, sum(p) OVER () AS tp, sum(n) OVER () AS tn FROM s)
    SELECT (sum(p * (below + (n + 1) / 2)) - any_value(tp) * (any_value(tp) + 1) / 2) / (any_value(tp) * (any_value(tn) - any_value(tp))) AS roc_auc, sum(p / tp * hits / seen) AS average_precision FROM r""", "roc_auc", "average_precision")
def g12_ranking_metrics(t, spark, sf_dir):
    """Scores with many ties against a class of about half the rows."""
    scored = t("orders").select((F.col("o_totalprice") > 150_000).cast("int").alias("label"), F.round(F.col("o_totalprice") / 50_000 + F.col("o_orderkey") % 7, 1).alias("score"))
    m = readiness.ranking_metrics(scored)
    return spark.createDataFrame([(m["roc_auc"], m["average_precision"])], "roc_auc double, average_precision double")


@query()
def g14_baseline_regression(t, spark, sf_dir):
    frame = t("part").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    done = readiness.baseline(frame, profile.profile(frame, numbers=False), "p_retailprice", key=["p_partkey"])
    return spark.createDataFrame(sorted((k, float(v)) for k, v in done.metrics.items()), "metric string, value double")


@query()
def g13_permutation_importance(t, spark, sf_dir):
    frame = t("part").select("p_partkey", "p_size", "p_retailprice")
    return readiness.baseline(frame, profile.profile(frame, numbers=False), "p_retailprice", folds=2, rounds=5, key=["p_partkey"]).importance


@query()
def g14_baseline_binary(t, spark, sf_dir):
    frame = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment", (F.col("c_acctbal") > 4000).alias("rich"))
    done = readiness.baseline(frame, profile.profile(frame, numbers=False), "rich", folds=5, rounds=5, repeats=1, key=["c_custkey"])
    return spark.createDataFrame(sorted((k, float(v)) for k, v in done.metrics.items()), "metric string, value double")


@query()
def g15_analyze(t, spark, sf_dir):
    return analyze(t("supplier"), name="supplier").advice


# Activity


@query("SELECT event_id, sha256(lower(trim(event_type)) || chr(31) || user_id::VARCHAR) AS key FROM events")
def h1_stable_key(t, spark, sf_dir):
    return t("events").select("event_id", activity.stable_key(t("events"), "event_type", "user_id").alias("key"))


@query("""SELECT event_id, sha256(coalesce(lower(trim(event_type)), '') || chr(31) || CASE WHEN user_id % 3 = 0 THEN '' WHEN event_type < 'm' THEN event_type || ',' || 'p' || user_id ELSE CASE WHEN event_type < 'p' || user_id
    THEN event_type || ',p' || user_id ELSE 'p' || user_id || ',' || event_type END END) AS key FROM (SELECT event_id, user_id, CASE WHEN user_id % 5 > 0 THEN event_type END AS event_type FROM events) WHERE event_type IS NOT NULL OR user_id % 3 = 0""")
def h1_stable_key_lists(t, spark, sf_dir):
    """Keys with nulls and with arrays, whose items come in any order."""
    rows = t("events").withColumn("event_type", F.when(F.col("user_id") % 5 > 0, F.col("event_type"))).filter("event_type IS NOT NULL OR user_id % 3 = 0")
    items = F.array(F.concat(F.lit(" P"), F.col("user_id").cast("string")), "event_type")
    rows = rows.select("event_id", "event_type", F.when(F.col("user_id") % 3 > 0, items).alias("items"))
    return rows.select("event_id", activity.stable_key(rows, "event_type", "items").alias("key"))


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def h2_latest_per_key(t, spark, sf_dir):
    return activity.latest_per_key(t("events"), ["user_id", "event_type"], "ts", "event_id")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def h3_newest_per_user(t, spark, sf_dir):
    return activity.newest_per_user(t("events"), "user_id", "ts", "event_id", 5).select("event_id", "user_id")


@query("SELECT event_id, ts FROM events")
def h4_history(t, spark, sf_dir):
    return activity.history(t("events"), "ts", "event_id").select("event_id", "ts")
