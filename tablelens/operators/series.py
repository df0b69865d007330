"""Time series built from rows: spacing, regular series, trend, seasonality, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelens.functions.names import RATE_NAME, suggests
from tablelens.functions.stats import range_part
from tablelens.operators.ranks import running_counts
from tablelens.sources.scratch import written

#: Frequency by the median gap in days, and the periods that are looked for at each.
GAPS = ((1.5, "D"), (9.0, "W"), (45.0, "MS"), (120.0, "QS"))
PERIODS = {"D": (7, 30, 365), "W": (4, 13, 52), "MS": (3, 6, 12), "QS": (4,), "YS": ()}
STEPS = {"D": "interval 1 day", "W": "interval 7 day", "MS": "interval 1 month", "QS": "interval 3 month", "YS": "interval 1 year"}


def time_gaps(frame: DataFrame, time: str) -> DataFrame:
    """(t, n, gap_days): distinct times, their rows, and the gap to the time before.

    Rows are counted per time first. Times are cut into ranges at quantiles; the gap is taken within each, and the first
    time of a range looks to the last of the ranges before, so that no task sorts all times. Counted times are written:
    the rows are read once, and no condition on ranges is worked out row by row below the counts.
    """
    times = frame.filter(F.col(time).isNotNull()).groupBy(F.col(time).cast("timestamp_ntz").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    times = written(times.withColumn("micros", F.unix_micros(F.col("t").cast("timestamp")).cast("double")), "times")
    times = times.withColumn("part", range_part(times, "micros"))
    last = times.groupBy("part").agg(F.max("t").alias("last"))
    before = last.select("part", F.lag("last").over(Window.orderBy("part")).alias("before"))  # a row per range
    prior = F.lag("t").over(Window.partitionBy("part").orderBy("t"))
    joined = times.join(F.broadcast(before), "part").withColumn("prior", F.coalesce(prior, "before"))
    seconds = F.unix_micros(F.col("t").cast("timestamp")) - F.unix_micros(F.col("prior").cast("timestamp"))
    return joined.select("t", "n", (seconds / 86_400e6).alias("gap_days"))


def frequency(frame: DataFrame, time: str, gaps: DataFrame | None = None) -> DataFrame:
    """median_gap_days, freq over all rows: equal times count as gaps of zero. `gaps` are its `time_gaps`, if at hand."""
    gaps = time_gaps(frame, time) if gaps is None else gaps
    zeros = gaps.filter("n > 1").select(F.lit(0.0).alias("g"), (F.col("n") - 1).alias("w"))
    weighted = gaps.filter("gap_days IS NOT NULL").select(F.col("gap_days").alias("g"), F.lit(1).cast("long").alias("w")).unionByName(zeros).groupBy("g").agg(F.sum("w").alias("w"))
    # a weighted median: the gaps of the two middle places, by running counts
    ranked = running_counts(weighted.withColumn("all", F.lit(0)), ["all"], "g", "w")
    last = F.col("total") - 1
    holds = lambda k: F.when((F.col("before") <= k) & (k < F.col("before") + F.col("w")), F.col("g"))
    out = ranked.agg(((F.max(holds(F.floor(last / 2))) + F.max(holds(F.ceil(last / 2)))) / 2).alias("median_gap_days"), F.max("total").alias("gaps"))
    freq = F.when(F.coalesce(F.col("gaps"), F.lit(0)) < 2, "D")
    for most, name in GAPS:
        freq = freq.when(F.col("median_gap_days") <= most, name)
    return out.select("median_gap_days", freq.otherwise("YS").alias("freq"))


def period_start(time: str, freq: str):
    """The label of a row's period; weeks are labelled by the Sunday that ends them."""
    c = F.col(time)
    if freq == "W":
        return F.date_add(F.date_trunc("week", c).cast("date"), 6).cast("timestamp_ntz")
    return F.date_trunc({"D": "day", "MS": "month", "QS": "quarter", "YS": "year"}[freq], c).cast("timestamp_ntz")


def adds_up(column: str) -> bool:
    return not suggests(RATE_NAME, column)


def regular_series(frame: DataFrame, time: str, column: str, freq: str, entity: str | None = None) -> DataFrame:
    """(entity, t, value, idx): one value for each period from first to last. Sums fill empty periods with 0; means leave them out."""
    total = adds_up(column)
    keys = [F.col(entity).cast("string").alias("entity") if entity else F.lit("all").alias("entity")]
    per = frame.filter(F.col(time).isNotNull()).groupBy(*keys, period_start(time, freq).alias("t")).agg((F.sum if total else F.avg)(F.col(column).cast("double")).alias("value"))
    spine = per.groupBy("entity").agg(F.min("t").alias("a"), F.max("t").alias("b")).select("entity", F.explode(F.expr(f"sequence(a, b, {STEPS[freq]})")).alias("t"))
    full = spine.join(per, ["entity", "t"], "left")
    full = full.fillna({"value": 0.0}) if total else full.filter("value IS NOT NULL")
    return full.withColumn("idx", (F.row_number().over(Window.partitionBy("entity").orderBy("t")) - 1).cast("long"))


def trend(series: DataFrame) -> DataFrame:
    """entity, n, slope, r2, t: least squares of value on idx."""
    x = F.col("idx").cast("double")
    out = series.groupBy("entity").agg(F.count("value").alias("n"), F.regr_slope("value", x).alias("slope"), F.when(F.var_pop("value") > 0, F.regr_r2("value", x)).otherwise(F.lit(0.0)).alias("r2"))
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.greatest(F.lit(1e-12), 1 - F.col("r2"))) * F.signum("slope")
    return out.withColumn("t", t)


def autocorrelation(series: DataFrame, period: int) -> DataFrame:
    """entity, n, acf: of the detrended values at one lag."""
    w = Window.partitionBy("entity")
    x = F.col("idx").cast("double")
    line = series.withColumns({"slope": F.regr_slope("value", x).over(w), "icept": F.regr_intercept("value", x).over(w)})
    rest = line.withColumn("e", F.col("value") - F.col("slope") * x - F.col("icept"))
    rest = rest.withColumn("d", F.col("e") - F.avg("e").over(w)).withColumn("l", F.lag("d", period).over(w.orderBy("idx")))
    return rest.groupBy("entity").agg(F.count("value").alias("n"), F.try_divide(F.sum(F.col("d") * F.col("l")), F.sum(F.col("d") * F.col("d"))).alias("acf"))


def half_spread(series: DataFrame) -> DataFrame:
    """entity, first_std, second_std, ratio: population spread of the two halves."""
    n = F.count(F.lit(1)).over(Window.partitionBy("entity"))
    halves = series.withColumn("late", F.col("idx") >= F.floor(n / 2))
    out = halves.groupBy("entity").agg(F.stddev_pop(F.when(~F.col("late"), F.col("value"))).alias("first_std"), F.stddev_pop(F.when(F.col("late"), F.col("value"))).alias("second_std"))
    return out.withColumn("ratio", F.try_divide(F.greatest("first_std", "second_std"), F.least("first_std", "second_std")))
