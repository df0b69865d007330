"""Statistical profile of a table: one row per column, from the shared column pass and one wide aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.stats import corrected_kurtosis, corrected_skewness
from tablelens.operators.ranks import exact_quantiles
from tablelens.operators.columns import catalogued, storage_kind, tidy, value_counts

QUARTILES = (0.25, 0.5, 0.75)
STATISTICS = ("mean", "std", "min", "p25", "median", "p75", "max", "skewness", "kurtosis", "pct_zero", "pct_negative")


def numeric_columns(frame: DataFrame) -> list[str]:
    return [f.name for f in frame.schema if storage_kind(f.dataType) in ("integer", "real")]


def number_statistics(frame: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, statistics: Sequence[str] = STATISTICS) -> DataFrame:
    """column and its moments, quantiles and shares, or those of them in `statistics`. Quantiles are selected by jobs of
    their own; exact=False takes them from sketches of bounded size within the one aggregate."""
    frame, columns = tidy(frame), list(columns or numeric_columns(frame))
    q = {"p25": 0, "median": 1, "p75": 2}
    ranked = bool(q.keys() & set(statistics))
    found = exact_quantiles(frame, {c: QUARTILES for c in columns}) if exact and ranked else {}
    quantile = lambda name, c: F.array(*[F.lit(v).cast("double") for v in found[name]]) if exact else F.percentile_approx(c, list(QUARTILES), 10_000).cast("array<double>")
    structs = []
    for k, name in enumerate(columns):
        c = F.col(name).cast("double")
        made = {
            "mean": F.avg(c),
            "std": F.when(F.count(c) > 1, F.stddev_samp(c)).otherwise(F.lit(0.0)),
            "min": F.min(c),
            "max": F.max(c),
            "skewness": corrected_skewness(c),
            "kurtosis": corrected_kurtosis(c),
            "pct_zero": F.avg((c == 0).cast("double")),
            "pct_negative": F.avg((c < 0).cast("double")),
        }
        structs.append(F.struct(*[x.alias(s) for s, x in made.items() if s in statistics], *([quantile(name, c).alias("q")] if ranked else [])).alias(f"_{k}"))
    if not structs:
        return frame.sparkSession.createDataFrame([], "column string, " + ", ".join(f"{s} double" for s in statistics))
    per = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_{k}").alias("s")) for k, n in enumerate(columns)])
    rows = frame.agg(*structs).select(F.explode(per).alias("c"))
    pick = lambda s: F.col(f"c.s.{s}")
    return rows.select("c.column", *[(pick("q")[q[s]] if s in q else pick(s)).alias(s) for s in statistics])


def profile(frame: DataFrame, exact: bool = True, numbers: bool = True) -> DataFrame:
    """One row per column: the catalogue's facts, missing and distinct shares, statistics, the top value and its share.

    numbers=False leaves the columns of STATISTICS out: whoever doesn't look at them needn't pay for exact quantiles.
    """
    out = catalogued(frame, value_counts(frame))
    if numbers:
        out = out.join(number_statistics(frame, exact=exact), "column", "left")
    named = F.col("semantic").isin("categorical", "boolean", "geo", "identifier", "text")
    return out.withColumns(
        {
            "n_missing": F.col("n_rows") - F.col("n"),
            "pct_missing": F.col("null_fraction"),
            "pct_unique": F.when(F.col("n_rows") > 0, F.col("n_unique") / F.col("n_rows")).otherwise(0.0),
            "is_constant": F.col("n_unique") <= 1,
            "high_cardinality": F.col("semantic").isin("categorical", "text", "identifier") & (F.col("n_unique") > 50) & (F.col("n_unique") > 0.1 * F.col("n")),
            "candidate_key": (F.col("n_unique") >= 0.99 * F.col("n_rows")) & (F.col("n") == F.col("n_rows")) & (F.col("n_rows") > 0),
            "top_value": F.when(named, F.col("top_value")),
            "top_share": F.when(named & (F.col("n") > 0), F.col("top_n") / F.col("n")),
        }
    ).drop("top_n")


def buckets(profiled: DataFrame) -> DataFrame:
    """bucket, columns: the columns of each kind, joined by commas in order of name."""
    kind = (
        F.when(F.col("semantic").isin("numeric", "currency"), "numeric")
        .when(F.col("semantic").isin("categorical", "geo", "boolean"), "categorical")
        .when(F.col("semantic").isin("temporal", "text"), F.col("semantic"))
    )
    return profiled.withColumn("bucket", kind).filter("bucket IS NOT NULL").groupBy("bucket").agg(F.array_join(F.array_sort(F.collect_list("column")), ",").alias("columns"))


def row_hashes(frame: DataFrame) -> list[Column]:
    """Two hashes of a row's columns. What is null is hashed too, as hashes pass over nulls."""
    parts = [x for f in frame.schema for x in (F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name), F.col(f.name).isNull())]
    return [F.xxhash64(F.lit(seed), *parts) for seed in (0, 1)]


def duplicate_rows(frame: DataFrame, hashes: Callable[[DataFrame], list[Column]] = row_hashes) -> DataFrame:
    """n_rows, n_duplicates: rows beyond the first of equal ones, nulls equal.

    Rows are counted by hashes. Only rows whose hashes repeat are compared by their values, and equal ones of a task are one
    row before they are dealt out, so that many copies of a row are no burden. Without repeating hashes the values aren't
    looked at.
    """
    a, b = hashes(frame)
    counts = frame.select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("repeating"))
    n_rows, repeating = total.first()
    n_duplicates = 0
    if repeating:
        again = counts.filter("n > 1").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
        names = {f.name: f"_{k}" for k, f in enumerate(frame.schema)}
        values = [(F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f.name)).alias(names[f.name]) for f in frame.schema]
        rows = frame.select(*values, a.alias("a"), b.alias("b")).join(again, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left_semi")
        n_duplicates = rows.groupBy(*names.values()).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return frame.sparkSession.createDataFrame([(n_rows, n_duplicates)], "n_rows long, n_duplicates long")


#: Bytes of a value of fixed width; texts have their length, and nested values that of their JSON.
WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def row_bytes(frame: DataFrame) -> DataFrame:
    """size_mb: what the values of all cells take; nulls take nothing."""

    def size(f) -> Column:
        kind = f.dataType.simpleString()
        width = WIDTHS.get(kind, 16 if kind.startswith("decimal") else None)
        if width:
            return F.when(F.col(f.name).isNotNull(), width)
        return F.octet_length(F.col(f.name) if kind in ("string", "binary") else F.to_json(F.col(f.name)))

    total = sum((F.coalesce(size(f), F.lit(0)) for f in frame.schema), F.lit(0))
    return frame.agg((F.sum(total) / 1e6).alias("size_mb"))


def numeric_matrix_columns(profiled: DataFrame) -> DataFrame:
    """The numeric columns that vary: more than two values."""
    return profiled.filter(F.col("kind").isin("integer", "real") & (F.col("n_unique") > 2)).select("column")
