"""Model readiness: which task a column makes, what to try, and a cross-validated baseline with Spark ML."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelens.functions.stats import safe_corr
from tablelens.operators.columns import decided, tidy, type_of_facts
from tablelens.operators.ranks import running_counts
from tablelens.sources.scratch import evenly, side_by_side, written

LEAK = 0.95
#: Folds, rounds of boosting, and repeats of each permutation.
FOLDS, ROUNDS, REPEATS = 5, 200, 5
#: Sizes of tables by rows.
SIZES = ((500, "small"), (10_000, "medium"), (500_000, "large"))

# Advice by task: item, confidence, and the condition under which it is given, over a table's facts.
RULES = (
    ("regression", 1, "predict the mean", "'high'", "true"),
    ("regression", 2, "gradient boosting", "'high'", "size <> 'small'"),
    ("regression", 3, "ridge or elastic net", "if(collinear, 'high', 'medium')", "collinear OR size = 'small' OR NOT nonlinear"),
    ("regression", 4, "Huber or quantile regression", "'medium'", "strong_outliers"),
    ("regression", 5, "hurdle or Tweedie model", "'medium'", "zero_inflated"),
    ("regression", 6, "boosting with native categories", "'medium'", "high_cardinality AND n_rows >= 10000"),
    ("classification", 1, "predict the prior", "'high'", "true"),
    ("classification", 2, "gradient boosting", "'high'", "true"),
    ("classification", 3, "logistic regression", "if(size = 'small', 'high', 'medium')", "true"),
    ("classification", 4, "reframe as anomaly detection", "'medium'", "imbalance >= 20"),
    ("text", 1, "TF-IDF and a linear SVM", "'high'", "true"),
    ("text", 2, "embeddings and logistic regression", "'medium'", "true"),
    ("forecasting", 1, "seasonal naive forecast", "'high'", "true"),
    ("forecasting", 2, "SARIMA", "'high'", "seasonal AND span_days > 730"),
    ("forecasting", 3, "exponential smoothing", "if(span_days > 365, 'high', 'medium')", "seasonal OR trending"),
    ("forecasting", 4, "additive model with changepoints", "'medium'", "changes"),
    ("forecasting", 5, "boosting on lags", "'medium'", "n_numeric > 2 OR n_categorical > 0"),
    ("clustering", 1, "KMeans", "if(separated, 'high', 'low')", "true"),
    ("clustering", 2, "DBSCAN", "'medium'", "strong_outliers OR NOT separated"),
    ("clustering", 3, "Gaussian mixture", "'medium'", "true"),
    ("anomaly", 1, "isolation forest", "'medium'", "strong_outliers OR changes"),
    ("reduction", 1, "PCA", "'medium'", "collinear OR n_numeric >= 15"),
    ("association", 1, "FP-Growth", "'low'", "repeating_id AND n_categorical > 0"),
)
FACTS = ("n_rows", "size", "collinear", "nonlinear", "strong_outliers", "zero_inflated", "high_cardinality", "imbalance", "seasonal", "trending", "changes", "separated", "span_days", "n_numeric", "n_categorical", "repeating_id")


def _task(semantic: Column, pct_unique: Column) -> Column:
    u, number = F.col("n_unique"), F.col("kind").isin("integer", "real")
    return (
        F.when(semantic == "text", "text_classification")
        .when(number & (u == 2), "binary_classification")
        .when(number & (u <= 15) & (pct_unique < 0.05), "multiclass_classification")
        .when(number, "regression")
        .when(u == 2, "binary_classification")
        .when(u.between(3, 100), "multiclass_classification")
        .otherwise("none")
    )


def task_of(profiled: DataFrame) -> DataFrame:
    """column, task: what predicting each column would be."""
    return profiled.select("column", _task(F.col("semantic"), F.col("pct_unique")).alias("task"))


def tasks(frame: DataFrame) -> DataFrame:
    """`task_of` a table's profile, of which it takes no more than tasks ask for: no quantiles, and values are counted only
    where their number decides."""
    share = F.when(F.col("n_rows") > 0, F.col("n_unique") / F.col("n_rows")).otherwise(0.0)
    return decided(frame, _task(type_of_facts(), share)).select("column", F.col("answer").alias("task"))


def forecastable(profiled: DataFrame) -> DataFrame:
    """One row: forecastable, span_days. A time, a number, and a span that isn't known to be under 60 days."""
    span = F.datediff(F.col("max_time").cast("date"), F.col("min_time").cast("date"))
    one = profiled.agg(F.count_if(F.col("semantic") == "temporal").alias("times"), F.count_if(F.col("semantic").isin("numeric", "currency")).alias("numbers"), F.max(F.when(F.col("semantic") == "temporal", span)).alias("span_days"))
    return one.select(((F.col("times") > 0) & (F.col("numbers") > 0) & (F.coalesce("span_days", F.lit(60)) >= 60)).alias("forecastable"), "span_days")


def size_name(rows: Column) -> Column:
    out = F.when(F.lit(False), "")
    for most, name in SIZES:
        out = out.when(rows < most, name)
    return out.otherwise("very_large")


def facts_of(findings: DataFrame, profiled: DataFrame) -> DataFrame:
    """One row of FACTS about a table, from its findings and profile."""
    has = lambda kind, strong=False: F.coalesce(F.bool_or((F.col("kind") == kind) & ((F.col("severity") == "strong") | F.lit(not strong))), F.lit(False))
    f = findings.agg(
        has("multicollinearity").alias("collinear"), has("nonlinear_relationship").alias("nonlinear"), has("outliers", True).alias("strong_outliers"), has("zero_inflation").alias("zero_inflated"),
        F.coalesce(F.max(F.when(F.col("kind") == "class_imbalance", F.col("statistic"))), F.lit(1.0)).alias("imbalance"), has("seasonality").alias("seasonal"), has("trend").alias("trending"), has("changepoint").alias("changes"),
        F.coalesce(F.bool_or((F.col("kind") == "cluster_structure") & F.col("severity").isin("notable", "strong")), F.lit(False)).alias("separated"),
    )
    p = profiled.agg(
        F.max("n_rows").alias("n_rows"), size_name(F.max("n_rows")).alias("size"), F.coalesce(F.bool_or("high_cardinality"), F.lit(False)).alias("high_cardinality"),
        F.count_if(F.col("semantic").isin("numeric", "currency")).alias("n_numeric"), F.count_if(F.col("semantic").isin("categorical", "geo", "boolean")).alias("n_categorical"),
        F.coalesce(F.bool_or((F.col("semantic") == "identifier") & (F.col("pct_unique") > 0) & (F.col("pct_unique") < 0.5)), F.lit(False)).alias("repeating_id"),
    )
    return f.join(F.broadcast(p)).join(F.broadcast(forecastable(profiled).select(F.coalesce("span_days", F.lit(0)).alias("span_days"))))  # one row each


def advise(facts: DataFrame) -> DataFrame:
    """table, task, rank, item, confidence for many tables at once. `facts` has table, task and the columns of FACTS."""
    rules = facts.sparkSession.createDataFrame([(t, k, i) for t, k, i, _, _ in RULES], "task string, rule int, item string")
    fires, confidence = F.lit(False), F.lit(None).cast("string")
    for task, k, _, level, when in RULES:
        own = (F.col("task") == task) & (F.col("rule") == k)
        fires, confidence = F.when(own, F.expr(when)).otherwise(fires), F.when(own, F.expr(level)).otherwise(confidence)
    found = facts.join(F.broadcast(rules), "task").withColumn("confidence", confidence).filter(fires)  # RULES is a fixed list
    rank = F.row_number().over(Window.partitionBy("table", "task").orderBy("rule"))
    return found.select("table", "task", rank.alias("rank"), "item", "confidence")


def feature_columns(profiled: DataFrame, target: str) -> DataFrame:
    """column, use: number or category."""
    fit = profiled.filter((F.col("column") != target) & ~F.col("is_constant") & ~F.col("semantic").isin("text", "temporal", "unknown") & ~((F.col("semantic") == "identifier") & (F.col("pct_unique") > 0.5)))
    return fit.withColumn("use", F.when(F.col("kind").isin("integer", "real"), "number").when(F.col("n_unique") <= 30, "category")).filter("use IS NOT NULL").select("column", "use")


def leaking(frame: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """column, r of the numeric columns that give the target away."""
    if not columns:
        return frame.sparkSession.createDataFrame([], "column string, r double")
    one = frame.agg(*[safe_corr(F.col(c), F.col(target)).alias(f"_{k}") for k, c in enumerate(columns)])
    per = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_{k}").alias("r")) for k, c in enumerate(columns)])
    return one.select(F.explode(per).alias("s")).select("s.*").filter(F.abs("r") >= LEAK)


def label_codes(frame: DataFrame, target: str) -> DataFrame:
    """label, code: 0 for the commonest, ties by name."""
    per = frame.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("label", (F.row_number().over(Window.orderBy(F.desc("n"), "label")) - 1).cast("long").alias("code"))  # a row per class


def prepared_rows(frame: DataFrame, target: str) -> DataFrame:
    """The rows whose target is known; NaN counts as unknown. No rows are left out for their number."""
    return tidy(frame).filter(F.col(target).isNotNull())


#: Parts of hashes in which rows are numbered on their own.
HASH_PARTS = 256


def stratified_folds(frame: DataFrame, label: str, key: Sequence[str], folds: int, seed: int = 7) -> DataFrame:
    """Adds fold: each class is dealt over the folds in the order of its rows' hashes, so that no two folds differ by
    more than one row of a class. A class of fewer rows than folds makes them fewer, two at least.

    Rows are numbered within parts of the hashes, and each part goes on where those before it ended, so that no task
    sorts a whole class.
    """
    smallest = frame.groupBy(label).count().agg(F.min("count")).first()[0] or folds
    folds = max(2, min(folds, smallest))
    rows = frame.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_p", F.pmod("_h", F.lit(HASH_PARTS)))
    sizes = rows.groupBy(F.col(label).alias("_l"), F.col("_p").alias("_q")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy("_l").orderBy("_q")) - F.col("_n"))  # a row per class and part
    place = F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", *key)) - 1
    joined = rows.withColumn("_place", place).join(before, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_p") == F.col("_q")))
    return joined.withColumn("fold", F.pmod(F.col("_place") + F.col("_before"), F.lit(folds)).cast("int")).select(*frame.columns, "fold")


def fold_of(key: Column, folds: int, seed: int = 7) -> Column:
    """A fold for each row by the hash of its key: no sort, no shuffle, the same at every run."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int")


def time_folds(frame: DataFrame, time: str, folds: int) -> DataFrame:
    """Adds fold 0..folds: contiguous in time, of about equal size. Fold k is tested after training on those before it."""
    t = F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    bounds = frame.select(t.alias("t")).approxQuantile("t", [k / (folds + 1) for k in range(1, folds + 1)], 0.001)
    return frame.withColumn("fold", sum(((t > F.lit(b)).cast("int") for b in bounds), F.lit(0)))


def trivial_regression(frame: DataFrame, target: str, fold: str = "fold") -> DataFrame:
    """fold, n, mae, rmse, r2 of predicting the mean of the other folds."""
    y = F.col(target).cast("double")
    per = frame.filter(y.isNotNull()).groupBy(fold).agg(F.sum(y).alias("s"), F.count(y).alias("c"))
    whole = per.agg(F.sum("s").alias("ts"), F.sum("c").alias("tc"))
    mean = per.join(F.broadcast(whole)).select(fold, F.try_divide(F.col("ts") - F.col("s"), F.col("tc") - F.col("c")).alias("guess"))  # a row per fold
    e = y - F.col("guess")
    joined = frame.filter(y.isNotNull()).join(F.broadcast(mean), fold)
    return joined.groupBy(fold).agg(F.count(y).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.var_pop(y))).alias("r2"))


@dataclass
class Baseline:
    task: str
    metrics: dict[str, float]
    importance: DataFrame
    notes: list[str] = field(default_factory=list)


#: A category of less than this share of the training rows is one of the others.
RARE = 0.01
OTHERS = "\u0000others"


def known_categories(train: DataFrame, categories: Sequence[str]) -> dict[str, list[str]]:
    """The categories of each column that aren't rare, the commonest first."""
    if not categories:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in categories])
    counts = train.select(F.explode(cells).alias("s")).select("s.*").filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    total = train.count()
    rows = counts.filter(F.col("n") >= RARE * total).orderBy(F.desc("n"), "value").collect()  # 100 of a column at most
    return {c: [r["value"] for r in rows if r["column"] == c] for c in categories}


def with_categories(rows: DataFrame, known: dict[str, list[str]]) -> DataFrame:
    """Missing categories become the commonest one, rare and unknown ones the others."""
    out = {}
    for c, values in known.items():
        filled = F.coalesce(F.col(c), F.lit(values[0] if values else OTHERS))
        out[c] = F.when(filled.isin(values), filled).otherwise(F.lit(OTHERS)) if values else F.lit(OTHERS)
    return rows.withColumns(out) if out else rows


def _features(numbers: Sequence[str], categories: Sequence[str]) -> list:
    stages: list = []
    if numbers:
        stages.append(Imputer(strategy="median", inputCols=list(numbers), outputCols=[f"{c}__n" for c in numbers]))
    for c in categories:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__h", handleInvalid="keep", dropLast=False)]
    return [*stages, VectorAssembler(inputCols=[f"{c}__n" for c in numbers] + [f"{c}__h" for c in categories], outputCol="features")]


def regression_metrics(scored: DataFrame) -> dict[str, float]:
    e = F.col("label") - F.col("prediction")
    row = scored.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.avg(e * e), F.var_pop("label"))).alias("r2")).first()
    return {k: float(row[k]) if row[k] is not None else float("nan") for k in ("mae", "rmse", "r2")}


def class_metrics(scored: DataFrame) -> dict[str, float]:
    """Balanced accuracy and macro F1 from one confusion count; for two classes also ROC-AUC and average precision."""
    table = scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per pair of classes
    classes = sorted({r["label"] for r in table})
    hit = {c: sum(r["n"] for r in table if r["label"] == c == r["prediction"]) for c in classes}
    true = {c: sum(r["n"] for r in table if r["label"] == c) for c in classes}
    said = {c: sum(r["n"] for r in table if r["prediction"] == c) for c in classes}
    f1 = {c: 2 * hit[c] / max(1, true[c] + said[c]) for c in classes}
    out = {"balanced_accuracy": sum(hit[c] / true[c] for c in classes) / len(classes), "macro_f1": sum(f1.values()) / len(classes)}
    if len(classes) == 2 and "probability" in scored.columns:
        out |= ranking_metrics(scored.select("label", vector_to_array("probability")[1].alias("score"))) | {"f1": f1[1.0]}
    return out


def ranking_metrics(scored: DataFrame) -> dict[str, float]:
    """roc_auc and average_precision of (label 0 or 1, score), exact: rows of one score are one step. Scores are counted and
    summed up by ranges, so that no task sorts them all. NaN where a class is missing."""
    steps = scored.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("label").cast("long")).alias("p")).withColumn("all", F.lit(0))
    ranked = running_counts(steps, ["all"], "score", "n", ["p"])
    found, seen = F.col("total_p") - F.col("before_p"), F.col("total") - F.col("before")  # at this score or above
    row = ranked.agg(
        F.sum(F.col("p") * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"), F.sum(F.col("p") / F.col("total_p") * found / seen).alias("precision"),
        F.max("total_p").alias("p"), F.max("total").alias("n"),
    ).first()
    p, n = row["p"] or 0, row["n"] or 0
    if not p or p == n:
        return {"roc_auc": math.nan, "average_precision": math.nan}
    return {"roc_auc": (row["ranks"] - p * (p + 1) / 2) / (p * (n - p)), "average_precision": row["precision"]}


def baseline(frame: DataFrame, profiled: DataFrame, target: str, folds: int = FOLDS, rounds: int = ROUNDS, repeats: int = REPEATS, time: str | None = None, key: Sequence[str] | None = None) -> Baseline:
    """Gradient boosting under cross-validation beside the trivial guess; columns that leak the target are dropped first.

    With `time`, folds follow each other in time and each is tested after training on those before. Else classes are
    dealt evenly over the folds, and a regression's rows by the hashes of their keys, as rows have no order.
    """
    profiled = written(profiled, "profile")  # read more than once below
    task = task_of(profiled).filter(F.col("column") == target).first()["task"]
    notes: list[str] = []
    chosen = {r["column"]: r["use"] for r in feature_columns(profiled, target).collect()}  # a row per column
    numbers = [c for c, use in chosen.items() if use == "number"]
    categories = [c for c, use in chosen.items() if use == "category"]
    rows = prepared_rows(frame, target)
    if task == "regression":
        gone = [r["column"] for r in leaking(rows, target, numbers).collect()]
        numbers = [c for c in numbers if c not in gone]
        notes += [f"{c} left out: it gives {target} away" for c in gone]
        rows = rows.withColumn("label", F.col(target).cast("double"))
    elif task in ("binary_classification", "multiclass_classification"):
        codes = F.broadcast(label_codes(rows, target))  # a row per class, at most 100
        rows = rows.join(codes, F.col(target).cast("string") == codes["label"]).drop("label").withColumn("label", F.col("code").cast("double"))
    else:
        raise ValueError(f"no baseline for {task}")
    keys = list(key or [c for c in frame.columns if c != target])
    if time:
        rows = time_folds(rows, time, folds)
    elif task == "regression":
        rows = rows.withColumn("fold", fold_of(F.struct(*keys), folds))
    else:
        rows = stratified_folds(rows, "label", keys, folds)
        folds = rows.agg(F.max("fold")).first()[0] + 1
    rows = rows.select("label", "fold", *[F.col(c).cast("double").alias(c) for c in numbers], *[F.col(c).cast("string").alias(c) for c in categories])
    rows = evenly(rows, rows.count()).persist()
    tests = range(1, folds + 1) if time else range(folds)

    def tested(k: int):
        train = rows.filter(F.col("fold") < k if time else F.col("fold") != k)
        test = rows.filter(F.col("fold") == k)
        known = known_categories(train, categories)
        model = Pipeline(stages=[*_features(numbers, categories), _learner(task, rounds)]).fit(_weighted(with_categories(train, known), task))
        scored = model.transform(with_categories(test, known))
        m = regression_metrics(scored) if task == "regression" else class_metrics(scored)
        guess = train.agg(F.avg("label")).first()[0] if task == "regression" else 0.0
        trivial = test.withColumn("prediction", F.lit(float(guess)))
        base = regression_metrics(trivial) if task == "regression" else class_metrics(trivial)
        return m | {f"baseline_{n}": v for n, v in base.items()}, model, known, test

    try:
        done = side_by_side(frame.sparkSession, tested, tests)
        measured, (_, model, known, test) = [d[0] for d in done], done[-1]
        metrics = {n: sum(m[n] for m in measured) / len(measured) for n in measured[0]}
        importance = permutation_importance(lambda d: model.transform(with_categories(d, known)), test, [*numbers, *categories], task, repeats)
    finally:
        rows.unpersist()
    return Baseline(task, metrics, importance, notes)


def _learner(task: str, rounds: int):
    if task == "regression":
        return GBTRegressor(maxIter=rounds, stepSize=0.08, seed=7)
    if task == "binary_classification":
        return GBTClassifier(maxIter=rounds, stepSize=0.08, weightCol="weight", seed=7)
    return OneVsRest(classifier=GBTClassifier(maxIter=rounds, stepSize=0.08, seed=7), weightCol="weight")


def _weighted(train: DataFrame, task: str) -> DataFrame:
    """Rows of each class weigh alike in total."""
    if task == "regression":
        return train
    per = train.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    whole = per.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("k"))
    weights = per.join(F.broadcast(whole)).select("label", (F.col("t") / (F.col("k") * F.col("n"))).alias("weight"))  # a row per class
    return train.join(F.broadcast(weights), "label")


def numbered(frame: DataFrame, place: str) -> DataFrame:
    """Adds the numbers 0, 1, 2, ... to rows, by the rows of the partitions before. The rows are written, as numbers that
    were given twice need not agree."""
    kept = written(frame.withColumns({"_part": F.spark_partition_id(), "_in": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    before, seen = {}, 0
    for r in kept.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect():  # a row per partition
        before[r["_part"]], seen = seen, seen + r["n"]
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")] if before else F.lit(0)
    return kept.withColumn(place, F.col("_in") + offset).select(*frame.columns, place)


def permutation_importance(transform, test: DataFrame, columns: Sequence[str], task: str, repeats: int = 5, top: int = 15, seed: int = 7) -> DataFrame:
    """column, importance: how much the score falls, on average, when a column's values are dealt to other rows.

    In repeat k row i gets the values of row (a i + b) mod n, with another a, coprime to n, and b each time. One join brings
    a row the values it gets in all repeats; the row is then stacked once for each column and repeat, with that column's
    value replaced, and all versions are scored in one pass and grouped. Importances are divided by the sum of their
    absolute values.
    """
    spark, rng = test.sparkSession, random.Random(seed)
    rows = numbered(test, "_at")
    n = max(1, rows.count())
    steps = []
    for k in range(repeats):
        a = next(x for x in iter(lambda: rng.randrange(1, max(2, n)), None) if math.gcd(x, n) == 1)
        steps.append((k, a, rng.randrange(n)))
    wanted = F.array(*[F.struct(F.lit(k).alias("repeat"), F.pmod(F.col("_at").cast("decimal(38,0)") * F.lit(a).cast("decimal(19,0)") + F.lit(b), F.lit(n)).cast("long").alias("_wanted")) for k, a, b in steps])
    asked = rows.select("*", F.explode(wanted).alias("_w")).select(*test.columns, "_w.*")
    dealt = rows.select(F.col("_at").alias("_from"), F.struct(*columns).alias("_other"))
    both = asked.join(dealt, F.col("_wanted") == F.col("_from"))
    # version -1 is the row as it is, in the first repeat only
    versions = F.concat(F.array(*[F.lit(k) for k in range(len(columns))]), F.when(F.col("repeat") == 0, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    stacked = both.withColumn("version", F.explode(versions))
    stacked = stacked.withColumns({c: F.when(F.col("version") == k, F.col("_other")[c]).otherwise(F.col(c)) for k, c in enumerate(columns)})
    scored = transform(stacked.select(*test.columns, "version", "repeat"))
    scores = _scores(scored, task)
    whole = scores.get((-1, 0), 0.0)
    drops = [(c, sum(whole - scores[k, r] for r in range(repeats)) / repeats) for k, c in enumerate(columns)] if scores else [(c, 0.0) for c in columns]
    total = sum(abs(d) for _, d in drops) or 1.0
    return spark.createDataFrame([(c, d / total) for c, d in drops], "column string, importance double").orderBy(F.desc("importance"), "column").limit(top)


def _scores(scored: DataFrame, task: str) -> dict[tuple[int, int], float]:
    """R2 or balanced accuracy of each version and repeat."""
    by = ("version", "repeat")
    if task == "regression":
        e = F.col("label") - F.col("prediction")
        rows = scored.groupBy(*by).agg((1 - F.try_divide(F.avg(e * e), F.var_pop("label"))).alias("score")).collect()  # a row per column and repeat
        return {(r["version"], r["repeat"]): r["score"] or 0.0 for r in rows}
    hits = scored.groupBy(*by, "label").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("hit"))
    return {(r["version"], r["repeat"]): r["score"] for r in hits.groupBy(*by).agg(F.avg("hit").alias("score")).collect()}
