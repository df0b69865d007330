"""Pattern detectors. Each gives rows of one shape: kind, severity, columns, statistic, p_value, description, evidence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.stats import correlation_p, t_tail
from tablelens.operators import series as S
from tablelens.operators.columns import tidy
from tablelens.operators.moments import Moments, moments, rank_correlations
from tablelens.operators.profile import duplicate_rows
from tablelens.operators.ranks import exact_quantiles
from tablelens.operators.steps import best_steps
from tablelens.sources.scratch import evenly, side_by_side, written

FINDING = "kind string, severity string, columns array<string>, statistic double, p_value double, description string, evidence map<string,string>"
SEVERITIES = ("strong", "notable", "info")
OUTLIER_ROWS = 20


def severity(value: Column, notable: float | None = None, strong: float | None = None, otherwise: str | None = None) -> Column:
    out = F.when(F.lit(False), "")
    if strong is not None:
        out = out.when(value >= strong, "strong")
    if notable is not None:
        out = out.when(value >= notable, "notable")
    return out.otherwise(F.lit(otherwise)) if otherwise else out


def finding(frame: DataFrame, kind: str, level: Column, columns: Column, statistic: Column, description: Column, p: Column | None = None, **evidence: Column) -> DataFrame:
    """Rows of findings; rows without a severity are none."""
    cells = [x for name, c in evidence.items() for x in (F.lit(name), c.cast("string"))]
    return frame.select(
        F.lit(kind).alias("kind"), level.alias("severity"), columns.alias("columns"), statistic.cast("double").alias("statistic"),
        (F.lit(None) if p is None else p).cast("double").alias("p_value"), description.alias("description"),
        (F.create_map(*cells) if cells else F.create_map()).cast("map<string,string>").alias("evidence"),
    ).filter("severity IS NOT NULL")


def _one() -> Column:
    return F.array(F.col("column"))


def missing_data(profiled: DataFrame) -> DataFrame:
    return finding(profiled, "missing_data", severity(F.col("pct_missing"), 0.05, 0.30), _one(), F.col("pct_missing"), F.concat(F.col("column"), F.lit(" lacks values")), n_missing=F.col("n_missing"))


def structured_missingness(frame: DataFrame, columns: Sequence[str], m: Moments | None = None) -> DataFrame:
    """Columns whose gaps go together."""
    m = m or moments(frame, [], columns)
    at = {c: m.columns.index(c) for c in columns}
    rows = [(a, b, m.gap_correlation(at[a], at[b])) for a, b in combinations(columns, 2)]
    found = frame.sparkSession.createDataFrame(rows, "a string, b string, value double").filter(F.abs("value") > 0.8)
    return finding(found, "structured_missingness", F.lit("notable"), F.array("a", "b"), F.col("value"), F.concat("a", F.lit(" and "), "b", F.lit(" are missing together")))


def constant_columns(profiled: DataFrame) -> DataFrame:
    return finding(profiled.filter("is_constant"), "constant_columns", F.lit("notable"), _one(), F.col("n_unique"), F.concat(F.col("column"), F.lit(" never varies")))


def duplicates(frame: DataFrame) -> DataFrame:
    share = F.try_divide(F.col("n_duplicates"), F.col("n_rows"))
    level = F.when(share > 0.05, "strong").when(share > 0.001, "notable")
    return finding(duplicate_rows(frame), "duplicate_rows", level, F.array().cast("array<string>"), share, F.concat(F.col("n_duplicates").cast("string"), F.lit(" rows repeat others")), n=F.col("n_duplicates"))


def high_cardinality(profiled: DataFrame) -> DataFrame:
    return finding(profiled.filter("high_cardinality"), "high_cardinality", F.lit("notable"), _one(), F.col("n_unique"), F.concat(F.col("column"), F.lit(" has very many values")))


def free_text(profiled: DataFrame) -> DataFrame:
    return finding(profiled.filter("semantic = 'text'"), "free_text", F.lit("info"), _one(), F.col("mean_length"), F.concat(F.col("column"), F.lit(" holds free text")))


def skewed(profiled: DataFrame) -> DataFrame:
    advice = F.when(F.col("min") >= 0, "log transform").otherwise("signed power transform")
    return finding(profiled, "skewed_distribution", severity(F.abs("skewness"), 1, 2), _one(), F.col("skewness"), F.concat(F.col("column"), F.lit(" is skewed")), advice=advice)


def zero_inflation(profiled: DataFrame) -> DataFrame:
    return finding(profiled.filter("pct_zero > 0.5"), "zero_inflation", F.lit("notable"), _one(), F.col("pct_zero"), F.concat(F.col("column"), F.lit(" is mostly zero")))


def fences_of(quartiles: dict[str, Sequence[float | None]]) -> dict[str, tuple[float, float]]:
    """The bounds beyond which values are outliers; columns whose quartiles are one value have none."""
    return {c: (a - 1.5 * (b - a), b + 1.5 * (b - a)) for c, (a, b) in quartiles.items() if a is not None and b > a}


def outlier_counts(frame: DataFrame, columns: Sequence[str], m: Moments | None = None, fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """column, low, high, n, n_out: values outside the quartiles by 1.5 times their distance."""
    if m is None:
        fences = fences_of(exact_quantiles(frame.select(*columns), {c: (0.25, 0.75) for c in columns}))
        m = moments(frame, list(fences), means={}, fences=fences)
    rows = [(c, *fences[c], int(m.n[k, k]), int(m.outside[k])) for k, c in enumerate(m.numbers) if c in fences and c in columns]
    return frame.sparkSession.createDataFrame(rows, "column string, low double, high double, n long, n_out long")


def outliers(frame: DataFrame, columns: Sequence[str], m: Moments | None = None, fences: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    share = F.try_divide(F.col("n_out"), F.col("n"))
    found = outlier_counts(frame, columns, m, fences).filter(F.col("n") >= OUTLIER_ROWS)
    return finding(found, "outliers", severity(share, 0.01, 0.05), _one(), share, F.concat(F.col("column"), F.lit(" has outliers")), low=F.col("low"), high=F.col("high"), n=F.col("n_out"))


def correlations(frame: DataFrame, columns: Sequence[str], m: Moments | None = None, pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """a, b, value (Pearson's r over rows where both are known), n, p_value."""
    m = m or moments(frame, columns)
    at, rows = {c: k for k, c in enumerate(m.numbers)}, []
    for a, b in combinations(columns, 2) if pairs is None else pairs:
        r, n = m.correlation(at[a], at[b])
        rows.append((a, b, r, n, correlation_p(r, n) if r is not None and n > 2 else None))
    return frame.sparkSession.createDataFrame(rows, "a string, b string, value double, n long, p_value double")


def correlation(frame: DataFrame, columns: Sequence[str], m: Moments | None = None) -> DataFrame:
    found = correlations(frame, columns, m).filter(F.abs("value") >= 0.6)
    return finding(found, "correlation", severity(F.abs("value"), 0.6, 0.85), F.array("a", "b"), F.col("value"), F.concat("a", F.lit(" and "), "b", F.lit(" go together")), F.col("p_value"), n=F.col("n"))


def rank_correlation(frame: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, rho, r, n of one pair, ranks taken over the rows where both are known."""
    return rank_correlations(frame, [a, b])


def nonlinear(frame: DataFrame, columns: Sequence[str], m: Moments | None = None) -> DataFrame:
    found = rank_correlations(frame, columns, m).withColumn("gain", F.abs("rho") - F.abs("r")).filter((F.abs("rho") >= 0.6) & (F.col("gain") >= 0.1))
    return finding(found, "nonlinear_relationship", severity(F.col("gain"), 0.2, None, "info"), F.array("a", "b"), F.col("rho"), F.concat("a", F.lit(" and "), "b", F.lit(" go together, not along a line")), r=F.col("r"))


def inflation_factors(frame: DataFrame, columns: Sequence[str], m: Moments | None = None) -> DataFrame:
    """column, vif, r2, n over the rows where all columns are known."""
    m = m or moments(frame, columns)
    return frame.sparkSession.createDataFrame(m.inflation(), "column string, vif double, r2 double, n long")


def multicollinearity(frame: DataFrame, columns: Sequence[str], m: Moments | None = None) -> DataFrame:
    exact = F.when(F.col("r2") > 0.9999, "exact").otherwise("near")
    return finding(inflation_factors(frame, columns, m), "multicollinearity", severity(F.col("vif"), 10, 30), _one(), F.col("vif"), F.concat(F.col("column"), F.lit(" follows from the others")), dependence=exact)


def temporal(frame: DataFrame, time: str, gaps: DataFrame | None = None, middle: DataFrame | None = None) -> DataFrame:
    """temporal_coverage, and temporal_gaps if any gap is more than five times the median. `gaps` and `middle` are the
    time's `time_gaps` and `frequency`, if they are at hand."""
    gaps = S.time_gaps(frame, time) if gaps is None else gaps
    middle = (S.frequency(frame, time, gaps) if middle is None else middle).select("median_gap_days")
    one = gaps.join(F.broadcast(middle)).agg(
        F.datediff(F.max("t"), F.min("t")).alias("days"), F.first("median_gap_days").alias("median"),
        F.count_if((F.col("gap_days") > 5 * F.col("median_gap_days")) & (F.col("median_gap_days") > 0)).alias("large"), F.max("gap_days").alias("largest"),
    )
    column = F.array(F.lit(time))
    covered = finding(one, "temporal_coverage", F.lit("info"), column, F.col("days"), F.concat(F.lit(f"{time} spans "), F.col("days").cast("string"), F.lit(" days")), median_gap_days=F.col("median"), large_gaps=F.col("large"))
    holes = finding(one.filter("large > 0"), "temporal_gaps", F.lit("notable"), column, F.col("large"), F.lit(f"{time} has gaps"), largest_days=F.col("largest"))
    return covered.unionByName(holes)


def series_findings(frame: DataFrame, time: str, column: str, freq: str, entity: str | None = None) -> DataFrame:
    """trend, seasonality, changepoint and variance_drift of one value column, for all its series at once."""
    series = written(S.regular_series(frame, time, column, freq, entity), "series")  # read by every detector below
    name = F.array(F.lit(column))
    t = S.trend(series).filter("n >= 12")
    moved = F.abs("t") > 2

    @F.pandas_udf("double")
    def p(t: pd.Series, n: pd.Series) -> pd.Series:  # one value for each series
        return pd.Series([t_tail(x, k - 2) for x, k in zip(t, n, strict=True)], dtype=float)

    out = [finding(t.filter(moved), "trend", severity(F.col("r2"), 0.25, 0.6), name, F.col("r2"), F.lit(f"{column} has a trend"), p("t", "n"), slope=F.col("slope"), entity=F.col("entity"))]
    hits = []
    for place, period in enumerate(S.PERIODS[freq]):
        a = S.autocorrelation(series, period).filter((F.col("n") >= 2 * period + 2) & (F.col("acf") >= F.greatest(F.lit(0.3), 2 / F.sqrt("n"))))
        hits.append(a.select("entity", F.lit(place).alias("place"), F.lit(period).alias("period"), "acf"))
    if hits:
        first = reduce(DataFrame.unionByName, hits).groupBy("entity").agg(F.min(F.struct("place", "period", "acf")).alias("s")).select("entity", "s.*")
        out.append(finding(first, "seasonality", severity(F.col("acf"), None, 0.5, "notable"), name, F.col("acf"), F.lit(f"{column} repeats"), period=F.col("period"), entity=F.col("entity")))
    steps = best_steps(series, S.PERIODS[freq])
    level = F.when((F.col("p") < 1e-4) & (F.col("size") >= 0.15), "strong").when((F.col("p") < 1e-4) & (F.col("size") >= 0.05), "notable")
    out.append(finding(steps, "changepoint", level, name, F.col("at"), F.lit(f"{column} steps to another level"), F.col("p"), size=F.col("size"), entity=F.col("entity")))
    drift = S.half_spread(series).filter("ratio > 2")
    out.append(finding(drift, "variance_drift", F.lit("notable"), name, F.col("ratio"), F.lit(f"{column} varies more in one half"), entity=F.col("entity")))
    return reduce(DataFrame.unionByName, out)


def class_sizes(frame: DataFrame, target: str) -> DataFrame:
    """n_classes, largest, smallest, n."""
    per = frame.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.count(F.lit(1)).alias("n_classes"), F.max("n").alias("largest"), F.min("n").alias("smallest"), F.sum("n").alias("n"))


def class_findings(frame: DataFrame, target: str) -> DataFrame:
    """class_imbalance and rare_classes of a target that isn't a number or has at most 20 values."""
    one = class_sizes(frame, target)
    number = dict(frame.dtypes)[target].split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
    one = one.filter(F.col("n_classes") <= 20) if number else one
    ratio, column = F.try_divide(F.col("largest"), F.col("smallest")), F.array(F.lit(target))
    uneven = finding(one.filter("n_classes BETWEEN 2 AND 50"), "class_imbalance", severity(ratio, 5, 20), column, ratio, F.lit(f"classes of {target} are uneven"), largest=F.col("largest"), smallest=F.col("smallest"))
    rare = finding(one.filter("n_classes >= 2 AND smallest < 10"), "rare_classes", F.lit("notable"), column, F.col("smallest"), F.lit(f"a class of {target} is rare"))
    return uneven.unionByName(rare)


def target_findings(frame: DataFrame, target: str, columns: Sequence[str], m: Moments | None = None) -> DataFrame:
    """target_leakage and predictive_feature of a numeric target."""
    others = [c for c in columns if c != target]
    found = correlations(frame, [*others, target], m, [(c, target) for c in others]).filter(F.col("n") >= 10)
    leak = finding(found.filter(F.abs("value") >= 0.95), "target_leakage", F.lit("strong"), F.array("a", "b"), F.col("value"), F.concat("a", F.lit(f" gives {target} away")))
    good = finding(found.filter((F.abs("value") >= 0.4) & (F.abs("value") < 0.95)), "predictive_feature", F.lit("info"), F.array("a", "b"), F.col("value"), F.concat("a", F.lit(f" tells about {target}")))
    return leak.unionByName(good)


def variance_explained(frame: DataFrame, target: str, groups: Sequence[str]) -> DataFrame:
    """column, eta2, n, n_groups: one unpivoted pass over all columns."""
    cells = F.array(*[F.struct(F.lit(g).alias("column"), F.col(g).cast("string").alias("g")) for g in groups])
    rows = tidy(frame).filter(F.col(target).isNotNull()).select(F.col(target).cast("double").alias("y"), F.explode(cells).alias("c")).select("y", "c.*").filter("g IS NOT NULL")
    per = rows.groupBy("column", "g").agg(F.count("y").alias("n"), F.avg("y").alias("m"), F.coalesce(F.var_pop("y"), F.lit(0.0)).alias("v"))
    whole = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum("n") * whole * whole
    return per.groupBy("column").agg(F.try_divide(between, between + F.sum(F.col("n") * F.col("v"))).alias("eta2"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_groups"))


def group_effect(frame: DataFrame, target: str, groups: Sequence[str]) -> DataFrame:
    if not groups:
        return none(frame.sparkSession)
    found = variance_explained(frame, target, groups).filter("n >= 20 AND n_groups BETWEEN 2 AND 30")
    return finding(found, "group_effect", severity(F.col("eta2"), 0.15, 0.5), F.array(F.col("column"), F.lit(target)), F.col("eta2"), F.concat(F.col("column"), F.lit(f" sets {target} apart")))


def cluster_structure(frame: DataFrame, columns: Sequence[str], seeds: int = 3) -> DataFrame:
    """The best number of clusters of the standardised columns by silhouette.

    KMeans is fitted on all complete rows and the silhouette is taken over all of them. Its distances are squared, so
    that sums per cluster are enough.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    spark = frame.sparkSession
    rows = tidy(frame).select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop("any")
    n = rows.count()
    if n < 50 or len(columns) < 2:
        return none(spark)
    rows = evenly(rows, n)
    features = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True)]).fit(rows).transform(rows).select("features")
    prepared = written(features, "features")  # each fit keeps its own rows in memory, unless its input is kept already

    def fitted(job: tuple[int, int]):
        model = KMeans(k=job[0], seed=job[1], maxIter=30).fit(prepared)
        return model.summary.trainingCost, model

    def score(model) -> float:
        clusters = model.transform(prepared)
        return ClusteringEvaluator().evaluate(clusters) if clusters.select("prediction").distinct().count() > 1 else 0.0

    sizes = range(2, min(6, n // 10) + 1)
    fits = side_by_side(spark, fitted, [(k, s) for k in sizes for s in range(seeds)])
    models = [min(fits[at : at + seeds], key=lambda f: f[0])[1] for at in range(0, len(fits), seeds)]
    best = max([(-1.0, 0), *zip(side_by_side(spark, score, models), sizes, strict=True)])
    one = spark.createDataFrame([best], "score double, k int")
    return finding(one, "cluster_structure", severity(F.col("score"), 0.25, 0.5, "info"), F.array(*[F.lit(c) for c in columns]), F.col("score"), F.lit("rows fall into clusters"), k=F.col("k"))


def none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDING)


def ordered(findings: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return findings.orderBy(rank, "kind", F.array_join("columns", ","))


def detect_all(frame: DataFrame, profiled: DataFrame, target: str | None = None, times: Sequence[str] | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """All findings, most severe first. Detectors about a target run only with one, clusters only without.

    Pairs of columns, outliers and gaps share one scan, ranks of all columns take a second, duplicates a third, a target's
    groups a fourth. Series are looked at for every temporal column and every number that varies, unless `times` and
    `values` name fewer.
    """
    profiled = written(profiled, "profile")  # every detector about single columns reads it
    names = ["column", "place", "kind", "semantic", "n_unique", "n_missing", "mean", "p25", "p75"]
    facts = sorted((r.asDict() for r in profiled.select(*names).collect()), key=lambda f: f["place"])  # a row per column
    numeric = [f for f in facts if f["kind"] in ("integer", "real") and f["n_unique"] > 2 and f["semantic"] != "identifier"]
    means, quartiles = {f["column"]: f["mean"] for f in numeric}, {f["column"]: (f["p25"], f["p75"]) for f in numeric}
    numeric = [f["column"] for f in numeric]
    lacking = [f["column"] for f in facts if f["n_missing"] > 0]
    temporal_ = [f["column"] for f in facts if f["semantic"] == "temporal" and f["kind"] == "temporal"]
    groups = [f["column"] for f in facts if f["semantic"] in ("categorical", "geo", "boolean") and 2 <= f["n_unique"] <= 30]
    fences = fences_of(quartiles)
    m = moments(frame, numeric, [c for c in lacking if c not in numeric], means, fences)
    out = [missing_data(profiled), structured_missingness(frame, lacking, m), constant_columns(profiled), duplicates(frame), high_cardinality(profiled), free_text(profiled), skewed(profiled.filter("semantic <> 'identifier'")), zero_inflation(profiled)]
    if numeric:
        out += [outliers(frame, numeric, m, fences), correlation(frame, numeric, m), nonlinear(frame, numeric, m), multicollinearity(frame, numeric, m)]
    for time in temporal_ if times is None else times:
        gaps = written(S.time_gaps(frame, time), "gaps")
        middle = written(S.frequency(frame, time, gaps), "frequency")
        freq = middle.first()["freq"]
        out += [temporal(frame, time, gaps, middle), *[series_findings(frame, time, c, freq) for c in (numeric if values is None else values)]]
    if target:
        out.append(class_findings(frame, target))
        if target in numeric:
            out += [target_findings(frame, target, numeric, m), group_effect(frame, target, [g for g in groups if g != target])]
    elif len(numeric) >= 2:
        out.append(cluster_structure(frame, numeric))
    return ordered(reduce(DataFrame.unionByName, out))
