"""What each column holds: counts, evidence, semantic types, values, the catalogue. One row per column.

A table is read twice at most: once for a wide aggregate of all columns, once for the counts of (column, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tablelens.functions.dates import parsed_time
from tablelens.functions.names import CURRENCY_NAME, GEO_NAME, ID_NAME, TIME_NAME, suggests
from tablelens.operators.query import is_numeric, is_temporal

SAMPLES, CLIP = 10, 60
#: Characters of a text that stand for it in counts, beside a digest if it has more.
HEAD = CLIP + 1
#: Sketches of numbers of values have 2^SKETCH_SIZE registers, which err by 0.8 %, and are taken to be off by ten times that.
SKETCH_SIZE, SKETCH_MARGIN = 14, 0.08
#: Numbers of values, and their shares of the rows, around which types and tasks turn.
TURNS, TURN_SHARES = (2, 3, 12, 15, 50, 100, 200), (0.05, 0.2, 0.6, 0.8)
#: A column's values are ranked in so many parts first, so that no task ranks them all.
RANK_PARTS = 64
PARSED_SHARE = 0.9


def storage_kind(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if is_temporal(kind) or isinstance(kind, T.DayTimeIntervalType):
        return "temporal"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if is_numeric(kind):
        return "real"
    if isinstance(kind, T.StringType | T.BinaryType):
        return "text"
    return "nested"


def tidy(frame: DataFrame) -> DataFrame:
    """NaN as null, as elsewhere in this library."""
    return frame.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in frame.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})


def as_text(f: T.StructField) -> Column:
    return F.to_json(f.name) if storage_kind(f.dataType) == "nested" else F.col(f.name).cast("string")


def cells(frame: DataFrame) -> DataFrame:
    """(place, number, real, head, digest): a row per cell that isn't null, without long texts.

    Integers and doubles stand as they are, other values as text, of which the first HEAD characters and, if there are
    more, a digest of 128 bits are kept.
    """

    def cell(place: int, f: T.StructField) -> Column:
        c, kind, none = F.col(f.name), storage_kind(f.dataType), F.lit(None)
        whole, real = isinstance(f.dataType, T.IntegralType | T.BooleanType), isinstance(f.dataType, T.DoubleType)
        text = as_text(f)
        long = kind in ("text", "nested")
        head = none if whole or real else F.substring(text, 1, HEAD) if long else text
        digest = F.when(F.length(text) > HEAD, F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(1), text)))) if long else none
        cell = F.struct(
            F.lit(place).alias("place"), (c.cast("long") if whole else none.cast("long")).alias("number"), (c if real else none.cast("double")).alias("real"),
            head.cast("string").alias("head"), digest.cast("string").alias("digest"),
        )
        return F.when(c.isNotNull(), cell)

    every = F.array_compact(F.array(*[cell(k, f) for k, f in enumerate(frame.schema)]))
    return frame.select(F.explode(every).alias("cell")).select("cell.*")


def value_counts(frame: DataFrame) -> DataFrame:
    """(column, value, n) over all columns: one shuffle of partial counts of `cells`. A value is its text; of more than HEAD
    characters the first, and those of one beginning are told apart by their digests."""
    frame = tidy(frame)
    counts = cells(frame).groupBy("place", "number", "real", "head", "digest").agg(F.count(F.lit(1)).alias("n"))
    flags = [k for k, f in enumerate(frame.schema) if isinstance(f.dataType, T.BooleanType)]
    number = F.when(F.col("place").isin(flags), F.col("number").cast("boolean").cast("string")).otherwise(F.col("number").cast("string"))
    name = F.array(*[F.lit(f.name) for f in frame.schema])[F.col("place")]
    return counts.select(name.alias("column"), F.coalesce(number, F.col("real").cast("string"), "head").alias("value"), "n")


def top_values(counts: DataFrame, k: int = SAMPLES) -> DataFrame:
    """(column, value, n, rank): the k commonest values of each column, ties by value."""
    order = [F.desc("n"), F.asc("value")]
    part = F.pmod(F.xxhash64("value"), F.lit(RANK_PARTS))
    first = counts.withColumn("rank", F.row_number().over(Window.partitionBy("column", part).orderBy(*order))).filter(F.col("rank") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("column").orderBy(*order))).filter(F.col("rank") <= k)


def basics(frame: DataFrame, sketched: bool = False) -> DataFrame:
    """column, place, dtype, kind, n_rows, n (known), mean_length, time_share, min_number, max_number, min_time, max_time;
    with `sketched` also n_sketched, the number of values by a sketch."""
    frame = tidy(frame)
    aggs, null = [F.count(F.lit(1)).alias("rows")], F.lit(None)
    for k, f in enumerate(frame.schema):
        c, kind = F.col(f.name), storage_kind(f.dataType)
        text, number, time = kind == "text", kind in ("integer", "real"), is_temporal(f.dataType)
        known = parsed_time(c.cast("string")).isNotNull()
        # numbers and times by a hash, as writing them as text takes far longer
        drawn = c.cast("long") if kind == "integer" else F.when(c.isNotNull(), F.xxhash64(c)) if kind in ("real", "temporal") else as_text(f)
        sketch = [F.hll_sketch_estimate(F.hll_sketch_agg(drawn, SKETCH_SIZE)).alias("n_sketched")] if sketched else []
        aggs.append(
            F.struct(
                F.count(c).alias("n"),
                (F.avg(F.length(as_text(f))) if kind in ("text", "nested") else null.cast("double")).alias("mean_length"),
                (F.avg(F.when(c.isNotNull(), known.cast("double"))) if text else null.cast("double")).alias("time_share"),
                (F.min(c).cast("double") if number else null.cast("double")).alias("min_number"),
                (F.max(c).cast("double") if number else null.cast("double")).alias("max_number"),
                (F.min(c).cast("date").cast("string") if time else null.cast("string")).alias("min_time"),
                (F.max(c).cast("date").cast("string") if time else null.cast("string")).alias("max_time"),
                *sketch,
            ).alias(f"_{k}")
        )
    one = frame.agg(*aggs)
    per = F.array(
        *[
            F.struct(F.lit(f.name).alias("column"), F.lit(k).alias("place"), F.lit(f.dataType.simpleString()).alias("dtype"), F.lit(storage_kind(f.dataType)).alias("kind"), F.col("rows").alias("n_rows"), F.col(f"_{k}").alias("s"))
            for k, f in enumerate(frame.schema)
        ]
    )
    return one.select(F.explode(per).alias("c")).select("c.column", "c.place", "c.dtype", "c.kind", "c.n_rows", "c.s.*")


def semantic_type(column: Column, kind: Column, n: Column, u: Column, mean_length: Column, time_share: Column) -> Column:
    """The semantic type by ordered rules; the first that holds decides."""
    says = lambda pattern: column.rlike(f"(?i){pattern}")
    number, integer = kind.isin("integer", "real"), kind == "integer"
    share = F.when(n > 0, u / n).otherwise(F.lit(0.0))
    looks_temporal = F.coalesce(time_share > PARSED_SHARE, F.lit(False))
    length = F.coalesce(mean_length, F.lit(0.0))
    return (
        F.when(kind == "boolean", "boolean")
        .when(kind == "temporal", "temporal")
        .when(kind == "nested", "unknown")
        .when(number & integer & says(ID_NAME), "identifier")
        .when(number & says(CURRENCY_NAME), "currency")
        .when(number & integer & (u <= 12) & (n > 50), "categorical")
        .when(number & says(TIME_NAME) & (u < 200), "categorical")
        .when(number, "numeric")
        .when(says(TIME_NAME) & looks_temporal, "temporal")
        .when(says(ID_NAME) & (share > 0.8), "identifier")
        .when(says(GEO_NAME), "geo")
        .when(looks_temporal, "temporal")
        .when((length > 60) | ((share > 0.6) & (length > 40)), "text")
        .when(u <= F.greatest(F.lit(50.0), 0.2 * n), "categorical")
        .otherwise("text")
    )


def type_of_facts() -> Column:
    """The semantic type from the columns of `basics` and n_unique."""
    return semantic_type(*[F.col(c) for c in ("column", "kind", "n", "n_unique", "mean_length", "time_share")])


def decided(frame: DataFrame, answer: Column) -> DataFrame:
    """(column, place, answer) of a table's columns, without counting what needn't be counted.

    `answer` is worked out from the columns of `basics` and n_unique, the number of values. One aggregate gives the
    evidence and a sketch of that number. The answer is worked out for the least and the greatest number that the sketch
    allows and for those between at which it may turn; only columns for which answers differ are counted exactly.
    """
    known = basics(frame, sketched=True)
    low, high = F.floor(F.col("n_sketched") * (1 - SKETCH_MARGIN)), F.ceil(F.col("n_sketched") * (1 + SKETCH_MARGIN))
    turns = [F.lit(u) for u in TURNS] + [F.floor(F.lit(share) * F.col(n)) for share in TURN_SHARES for n in ("n", "n_rows")]
    tried = F.array_distinct(F.array(low, high, *[F.greatest(low, F.least(u + d, high)).cast("long") for u in turns for d in (-1, 0, 1)]))
    facts = ["column", "place", "kind", "n_rows", "n", "mean_length", "time_share"]
    tries = known.select(*facts, F.explode(tried).alias("n_unique")).withColumn("answer", answer)
    rows = tries.groupBy(*facts).agg(F.min("answer").alias("answer"), (F.min("answer") != F.max("answer")).alias("open")).collect()  # a row per column
    near = [f for f in frame.schema if any(r["open"] and r["column"] == f.name for r in rows)]
    values = [as_text(f) if storage_kind(f.dataType) == "nested" else F.col(f.name) for f in near]
    exact = dict(zip([f.name for f in near], tidy(frame).agg(*[F.count_distinct(v) for v in values]).first(), strict=True)) if near else {}
    spark = frame.sparkSession
    counted = spark.createDataFrame([(*r[:8], exact.get(r["column"])) for r in rows], "column string, place int, kind string, n_rows long, n long, mean_length double, time_share double, settled string, n_unique long")
    return counted.select("column", "place", F.when(F.col("n_unique").isNull(), F.col("settled")).otherwise(answer).alias("answer")).orderBy("place")


def semantic_types(frame: DataFrame) -> DataFrame:
    """(column, semantic) of a table's columns, in order, without counting what needn't be counted."""
    return decided(frame, type_of_facts()).select("column", F.col("answer").alias("semantic"))


def profile_columns(frame: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """The catalogue's entries for a table: basics plus n_unique, semantic, null_fraction, sample_values, pct_top_value.

    `counts` are its `value_counts`, if they are at hand.
    """
    return catalogued(frame, value_counts(frame) if counts is None else counts).drop("top_value", "top_n")


def catalogued(frame: DataFrame, counts: DataFrame) -> DataFrame:
    """`profile_columns` with top_value and top_n, the commonest value and its count; values are ranked once."""
    distinct = counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    top = top_values(counts).withColumn("shown", F.when(F.length("value") > CLIP, F.concat(F.substring("value", 1, CLIP), F.lit("..."))).otherwise(F.col("value")))
    top = top.groupBy("column").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda s: s["shown"]).alias("sample_values"), F.min_by("value", "rank").alias("top_value"), F.max("n").alias("top_n"))
    out = basics(frame).join(distinct, "column", "left").join(top, "column", "left").fillna({"n_unique": 0})
    out = out.withColumn("semantic", type_of_facts())
    number = F.col("semantic").isin("numeric", "currency")
    return out.withColumns(
        {
            "null_fraction": F.when(F.col("n_rows") > 0, 1 - F.col("n") / F.col("n_rows")).otherwise(0.0),
            "pct_top_value": F.when(F.col("n") > 0, F.col("top_n") / F.col("n")),
            "min_number": F.when(number, F.col("min_number")),
            "max_number": F.when(number, F.col("max_number")),
        }
    )


def grain(columns: DataFrame) -> DataFrame:
    """One row, `grain`: what a row of the table stands for. `columns` is the profile of one table, a row per column."""
    first = lambda cond: F.min(F.when(cond, F.struct("place", "column")))["column"]
    found = columns.agg(
        first(F.col("n_unique") >= 0.98 * F.col("n_rows")).alias("key"),
        first(F.col("semantic") == "identifier").alias("id"),
        first(F.col("semantic") == "temporal").alias("time"),
    )
    return found.select(
        F.when(F.col("key").isNotNull(), F.concat(F.lit("one row per "), "key"))
        .when(F.col("id").isNotNull() & F.col("time").isNotNull(), F.concat(F.lit("one row per "), "id", F.lit(" and "), "time"))
        .when(F.col("id").isNotNull(), F.concat("id", F.lit(" (repeating)")))
        .otherwise("unspecified")
        .alias("grain")
    )


def dictionary(columns: DataFrame) -> DataFrame:
    """column, entry: one line of text per column."""
    null = F.when(F.col("null_fraction") > 0, F.concat(F.round(100 * F.col("null_fraction"), 1).cast("string"), F.lit("% null")))
    low, high = (F.coalesce(F.col(f"{m}_number").cast("string"), F.col(f"{m}_time")) for m in ("min", "max"))
    reach = F.when(low.isNotNull(), F.concat(low, F.lit(" to "), high))
    values = F.concat(F.lit("e.g. "), F.array_join(F.slice("sample_values", 1, 8), ", "))
    return columns.select("column", F.concat_ws("; ", F.concat_ws("/", "semantic", "dtype"), F.concat(F.col("n_unique").cast("string"), F.lit(" distinct")), null, reach, values).alias("entry"))


def quality_facts(columns: DataFrame) -> DataFrame:
    """column, n_unique, completeness, low, high, samples."""
    complete = F.when(F.col("null_fraction") == 0, "complete").otherwise(F.concat(F.round(100 * F.col("null_fraction"), 1).cast("string"), F.lit("% null")))
    return columns.select("column", "n_unique", complete.alias("completeness"), F.coalesce(F.col("min_number").cast("string"), "min_time").alias("low"), F.coalesce(F.col("max_number").cast("string"), "max_time").alias("high"), F.array_join(F.slice("sample_values", 1, 5), "|").alias("samples"))


def top_of(frame: DataFrame, column: str, k: int = 200) -> DataFrame:
    """value, n of one column, commonest first."""
    return frame.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("value")).limit(k)


def named_metric(frame: DataFrame, name: str, expression: str) -> DataFrame:
    return frame.agg(F.expr(expression).alias(name))


def rank_measures(profiled: list[dict]) -> list[str]:
    """Columns to add up: currency before numeric, without rates, prices and the like."""
    from tablelens.functions.names import NOT_ADDED_UP

    fit = [c for c in profiled if c["semantic"] in ("currency", "numeric") and not suggests(NOT_ADDED_UP, c["column"])]
    return [c["column"] for c in sorted(fit, key=lambda c: (c["semantic"] != "currency", c["place"]))]


def rank_dimensions(columns: DataFrame, k: int = 3) -> DataFrame:
    """column, rank: columns to break a measure down by."""
    fit = columns.filter(F.col("semantic").isin("categorical", "geo", "boolean") & F.col("n_unique").between(2, 30) & (F.col("pct_top_value") <= 0.9))
    band = F.when(F.col("n_unique").between(3, 12), 0).when(F.col("n_unique").between(13, 30), 1).otherwise(2)
    return fit.select("column", F.row_number().over(Window.orderBy(band, "n_unique", "place")).alias("rank")).filter(F.col("rank") <= k)  # a row per column of one table
