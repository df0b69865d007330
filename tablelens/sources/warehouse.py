"""The warehouse: writing tables, ingesting sources, the catalogue, looking at tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from tablelens.functions.dates import parsed_time
from tablelens.functions.names import TIME_NAME, suggests, table_name
from tablelens.operators.columns import grain, profile_columns
from tablelens.sources.readers import tidy_names

PROMOTED_SHARE = 0.9
PREVIEW_ROWS, SAMPLE_ROWS, FRAME_ROWS = 500, 1_000, 50_000


class NothingToIngest(ValueError):
    pass


def promote_dates(frame: DataFrame) -> DataFrame:
    """Text columns as timestamps where more than nine in ten of all rows, nulls against it, are dates."""
    texts = [f.name for f in frame.schema if isinstance(f.dataType, T.StringType)]
    if not texts:
        return frame
    shares = frame.agg(*[F.avg(parsed_time(F.col(c)).isNotNull().cast("double")).alias(c) for c in texts]).first()
    return frame.withColumns({c: parsed_time(F.col(c)) for c in texts if (shares[c] or 0) > PROMOTED_SHARE})


def may_be_time(name: str) -> bool:
    return suggests(TIME_NAME, name)


def replace(frame: DataFrame, table: str) -> int:
    """Write a table anew; its rows are counted while they are written."""
    seen = F.count(F.lit(1)).alias("n")
    from pyspark.sql import Observation

    watch = Observation()
    frame.observe(watch, seen).write.mode("overwrite").saveAsTable(table)
    return watch.get["n"]


def append(frame: DataFrame, table: str) -> int:
    """Add rows by column name, making the table if it is missing; the table's rows afterwards. An empty append does nothing."""
    spark = frame.sparkSession
    there = spark.catalog.tableExists(table)
    if frame.isEmpty():
        return spark.table(table).count() if there else 0
    if there:
        frame = frame.select(*spark.table(table).columns)
    frame.write.mode("append").saveAsTable(table)
    return spark.table(table).count()


def ingest(frame: DataFrame, table: str) -> DataFrame:
    """Tidy, promote, write and profile: the table's catalogue rows, with `dataset` and `grain`."""
    if frame.isEmpty():
        raise NothingToIngest(f"{table} has no rows")
    name = table_name(table)
    replace(promote_dates(tidy_names(frame)), name)
    columns = profile_columns(frame.sparkSession.table(name))
    return columns.crossJoin(F.broadcast(grain(columns))).withColumn("dataset", F.lit(name))  # the grain is one row


#: Objects of a source that are ingested at once.
AT_ONCE = 8


def ingest_all(spark: SparkSession, objects: dict[str, Callable[[], DataFrame]], prefix: str = "", at_once: int = AT_ONCE) -> DataFrame:
    """(object, table, n_rows, problem): every object of a source, in order; one that fails is named with ! and the rest go on.

    Objects are read side by side by threads that inherit the session's properties, each in a scheduler pool of its own, so
    that with fair scheduling a large one doesn't hold up the others. Two objects of one table name follow each other.
    """

    def one(name: str, read: Callable[[], DataFrame]) -> tuple:
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"ingest {name}")
            table = table_name(prefix, name)
            ingest(read(), table)
            return name, table, spark.table(table).count(), None
        except (ValueError, AnalysisException) as problem:
            return f"!{name}", None, None, str(problem)

    by_table: dict[str, list[str]] = {}
    for name in objects:
        by_table.setdefault(table_name(prefix, name), []).append(name)
    work = lambda names: [(name, one(name, objects[name])) for name in names]
    with ThreadPoolExecutor(max(1, min(at_once, len(by_table)))) as pool:
        found = dict(pair for pairs in pool.map(inheritable_thread_target(spark)(work), by_table.values()) for pair in pairs)
    return spark.createDataFrame([found[name] for name in objects], "object string, table string, n_rows long, problem string")


def look(spark: SparkSession, table: str, rows: int = FRAME_ROWS) -> DataFrame:
    return spark.table(table).limit(rows)


def preview(spark: SparkSession, table: str, rows: int = 25) -> DataFrame:
    return look(spark, table, min(rows, PREVIEW_ROWS))


def tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS `{table}`")


def remove_source(sources: DataFrame, datasets: DataFrame, gone: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The catalogue without some sources and without their datasets."""
    left = sources.filter(~F.col("name").isin(list(gone)))
    return left, datasets.join(left.select(F.col("name").alias("source")), "source", "left_semi")


def write_path(frame: DataFrame, path: str, mode: str = "overwrite") -> int:
    """Parquet files instead of a named table; the rows written."""
    from pyspark.sql import Observation

    watch = Observation()
    frame.observe(watch, F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(path)
    return watch.get["n"]
