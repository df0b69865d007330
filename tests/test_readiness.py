"""Folds, categories, weights and importances beside plain computations."""

import inspect
import random
from collections import Counter, defaultdict

import pytest

from tablelens import queries
from tablelens.operators.profile import profile
from tablelens.plans import readiness


def test_folds_are_even_in_each_class(spark):
    rows = [(k, "abbbcc"[k % 6]) for k in range(601)]
    dealt = readiness.stratified_folds(spark.createDataFrame(rows, "k long, label string"), "label", ["k"], 5).collect()
    assert sorted((r["k"], r["label"]) for r in dealt) == sorted(rows)
    sizes = defaultdict(Counter)
    for r in dealt:
        sizes[r["label"]][r["fold"]] += 1
    assert all(len(c) == 5 and max(c.values()) - min(c.values()) <= 1 for c in sizes.values())
    again = readiness.stratified_folds(spark.createDataFrame(rows[::-1], "k long, label string"), "label", ["k"], 5).collect()
    assert {r["k"]: r["fold"] for r in again} == {r["k"]: r["fold"] for r in dealt}


def test_rare_classes_make_fewer_folds(spark):
    rows = [(k, "a" if k < 50 else "b") for k in range(53)]
    dealt = readiness.stratified_folds(spark.createDataFrame(rows, "k long, label string"), "label", ["k"], 5)
    assert {r["fold"] for r in dealt.collect()} == {0, 1, 2}
    lone = spark.createDataFrame(rows[:51], "k long, label string")
    assert {r["fold"] for r in readiness.stratified_folds(lone, "label", ["k"], 5).collect()} == {0, 1}


def test_categories(spark):
    train = spark.createDataFrame([("x",)] * 150 + [("y",)] * 60 + [("rare",)] * 2 + [(None,)] * 5, "c string")
    known = readiness.known_categories(train, ["c"])
    assert known == {"c": ["x", "y"]}
    test = spark.createDataFrame([("y",), (None,), ("rare",), ("never seen",)], "c string")
    assert [r["c"] for r in readiness.with_categories(test, known).collect()] == ["y", "x", readiness.OTHERS, readiness.OTHERS]


def test_classes_weigh_alike(spark):
    train = spark.createDataFrame([(float(k % 10 > 0) + float(k % 10 > 6),) for k in range(200)], "label double")
    rows = readiness._weighted(train, "multiclass_classification").collect()
    total = Counter()
    for r in rows:
        total[r["label"]] += r["weight"]
    assert len(total) == 3 and all(w == pytest.approx(200 / 3) for w in total.values())


def test_importance_of_the_column_that_counts(spark):
    rng = random.Random(1)
    frame = spark.createDataFrame([(k, rng.random(), rng.random(), 0.0) for k in range(400)], "k long, a double, b double, label double").selectExpr("a", "b", "a * 10 AS label")
    plain = lambda d: d.selectExpr("*", "a * 10 AS prediction")
    found = {r["column"]: r["importance"] for r in readiness.permutation_importance(plain, frame, ["a", "b"], "regression", repeats=3).collect()}
    assert found == {"a": pytest.approx(1), "b": pytest.approx(0)}


def test_numbers_of_rows(spark):
    frame = spark.range(0, 57, numPartitions=5).filter("id % 3 > 0")
    assert [r["n"] for r in readiness.numbered(frame, "n").orderBy("n").collect()] == list(range(38))


@pytest.mark.parametrize("target", ["kind", "yes"])
def test_baseline_of_classes(spark, target):
    rng = random.Random(3)
    rows = [(k, rng.random(), ["red", "green", "blue"][k % 3]) for k in range(240)]
    frame = spark.createDataFrame(rows, "k_id long, x double, colour string").selectExpr("k_id", "x", "colour", "CASE WHEN x < 0.3 THEN 'low' WHEN x < 0.7 THEN 'mid' ELSE 'high' END AS kind", "x > 0.6 AS yes")
    frame = frame.drop("kind" if target == "yes" else "yes")
    done = readiness.baseline(frame, profile(frame), target, folds=2, rounds=4, repeats=1, key=["k_id"])
    assert done.metrics["balanced_accuracy"] > 0.8 > done.metrics["baseline_balanced_accuracy"]
    assert done.importance.first()["column"] == "x"


def test_registered_regression_baseline_is_whole(spark, monkeypatch):
    """The survey's folds, rounds of boosting and repeats of each permutation."""
    asked = {}

    def spied(*given, **named):
        asked.update(inspect.signature(whole).bind(*given, **named).arguments)
        return readiness.Baseline("regression", {"r2": 0.5}, None)

    whole = readiness.baseline
    monkeypatch.setattr(readiness, "baseline", spied)
    queries.QUERIES["g14_baseline_regression"](spark, "/root/testdata/sf0.001")
    assert asked["target"] == "p_retailprice"
    assert [asked.get(k, v) for k, v in (("folds", 5), ("rounds", 200), ("repeats", 5))] == [5, 200, 5]
    assert (readiness.FOLDS, readiness.ROUNDS, readiness.REPEATS) == (5, 200, 5)
