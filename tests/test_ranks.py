"""Exact quantiles, ranks, and sums over pairs of columns, against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.operators import patterns, ranks
from tablelens.operators.activity import stable_key
from tablelens.operators.columns import profile_columns, semantic_types, top_values, value_counts
from tablelens.operators.moments import moments, rank_correlations
from tablelens.operators.profile import number_statistics, profile
from tablelens.operators.ranks import exact_quantiles, grouped_quantiles, running_counts

SHARES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_quantiles_of_a_million_distinct_values(spark):
    n = 1_000_003
    frame = spark.range(n).select((F.col("id") * 7919 % n / 7.0).alias("x"))
    got = exact_quantiles(frame, {"x": SHARES}, few=50, accuracy=100)["x"]
    assert got == pytest.approx(np.quantile(np.arange(n) / 7.0, SHARES), rel=1e-12)


@pytest.mark.parametrize("few", [0, 3, 10_000])
def test_quantiles_with_ties_and_gaps(spark, few):
    rng = random.Random(few)
    rows = [(rng.choice([None, 0, 0, 0, 1]), rng.gauss(0, 1) if rng.random() < 0.9 else float("nan"), None, 5, rng.choice([-1.5, 2.5])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "a int, b double, c double, d long, e float")
    got = exact_quantiles(frame, dict.fromkeys("abcde", SHARES), few=few, accuracy=20)
    for k, c in enumerate("abcde"):
        known = [r[k] for r in rows if r[k] is not None and r[k] == r[k]]
        assert got[c] == ([None] * len(SHARES) if not known else pytest.approx(np.quantile(known, SHARES), abs=1e-12))
    assert exact_quantiles(frame.limit(0), {"a": [0.5]}) == {"a": [None]}


def test_quantiles_of_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["x", None, "z"]), rng.choice([1, 2]), rng.choice([None, float(rng.randint(0, 9)), rng.random()])) for _ in range(500)] + [("alone", 1, None)]
    frame = spark.createDataFrame(rows, "g string, h int, v double")
    got = {(r.g, r.h): r.m for r in grouped_quantiles(frame, ["g", "h"], "v", 0.3, "m").collect()}
    want = {k: np.quantile(v, 0.3) for k in {r[:2] for r in rows} if (v := [r[2] for r in rows if r[:2] == k and r[2] is not None])}
    assert got == pytest.approx(want)


def test_running_counts_over_many_ranges(spark):
    counts = spark.range(5000).selectExpr("id % 3 AS k", "CAST(id AS double) AS v", "id % 5 + 1 AS n").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = running_counts(counts, ["k"]).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 5000
    for k in range(3):
        seen = 0
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.v):
            assert r.before == seen
            seen += r.n
        assert {r.total for r in got if r.k == k} == {seen}


def spearman(x, y):
    rank = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    return np.corrcoef(rank(x), rank(y))[0, 1]


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 4))
    x[:, 1] = np.round(x[:, 0] ** 3 + 0.1 * x[:, 1], 1)
    x[:, 3] = x[:, 0] + x[:, 1]
    x[rng.random(300) < 0.2, 2] = np.nan
    x[rng.random(300) < 0.3, 1] = np.nan
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return x, spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)


def test_moments_and_ranks(spark, numbers):
    x, frame = numbers
    m = moments(frame.withColumn("t", F.expr("IF(b IS NULL, NULL, 'x')")), list("abcd"), ["t"])
    assert m.gap_correlation(1, 4) == pytest.approx(1.0) and m.gap_correlation(0, 1) is None
    got = {(r.a, r.b): r for r in rank_correlations(frame, list("abcd"), m).collect()}
    for i in range(4):
        for j in range(i + 1, 4):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            p, q, r = x[both, i], x[both, j], got["abcd"[i], "abcd"[j]]
            assert r.n == both.sum() and r.r == pytest.approx(np.corrcoef(p, q)[0, 1]) and r.rho == pytest.approx(spearman(p, q))
            assert m.correlation(i, j)[0] == pytest.approx(r.r)


def test_inflation(numbers):
    x, frame = numbers
    whole = x[~np.isnan(x[:, :3]).any(axis=1)][:, :3]
    want = np.diag(np.linalg.inv(np.corrcoef(whole.T)))
    assert [v for _, v, _, _ in moments(frame, list("abc")).inflation()] == pytest.approx(list(want))
    assert {c: v for c, v, _, _ in moments(frame.withColumn("e", frame.a - 2 * frame.d), list("ade")).inflation()} == dict.fromkeys("ade", pytest.approx(1e6))
    wide = frame.select("a", *[(frame.a * k + frame.d * k * k + frame.c).alias(f"c{k}") for k in range(45)])
    assert len(moments(wide, wide.columns).inflation()) == 46


def test_constant_and_empty_columns(spark):
    frame = spark.createDataFrame([(1.0, 1e9, None), (1.0, 1e9, None), (2.0, 1e9, None)], "a double, b double, c double")
    m = moments(frame, ["a", "b", "c"])
    assert m.correlation(0, 1) == (None, 3) and m.correlation(0, 2) == (None, 0)
    assert patterns.correlations(frame.limit(0), ["a", "b"]).count() == 1


def test_semantic_types_agree_with_whole_profiles(spark):
    rows = [(k, k % 12, f"name {k % 55}", "2024-01-%02d" % (k % 28 + 1), "x" * (k % 90 + 30) + str(k), k % 190, f"K{k}") for k in range(300)]
    frame = spark.createDataFrame(rows, "row_id int, few int, kind string, made string, prose string, week_no_of int, part_key string")
    assert [tuple(r) for r in semantic_types(frame).collect()] == [tuple(r) for r in profile_columns(frame).orderBy("place").select("column", "semantic").collect()]


def test_long_values_are_told_apart(spark):
    long = "a" * 61
    frame = spark.createDataFrame([(long + "b", [1]), (long + "c", None), (long + "b", [2]), (long, [1]), (None, [1])], "t string, l array<int>")
    assert {(r.column, r.value): r.n for r in top_values(value_counts(frame)).filter("column = 'l'").collect()} == {("l", "[1]"): 3, ("l", "[2]"): 1}
    assert {r.column: r.n_unique for r in profile(frame).select("column", "n_unique").collect()} == {"t": 3, "l": 2}


def test_stable_keys(spark):
    frame = spark.createDataFrame([("x", None, ["a", "b"]), (None, "x", ["b ", None, " A"]), ("X\t", None, ["B", "a"]), ("x", None, None), ("x", "", [])], "p string, q string, l array<string>")
    plain = [r.k for r in frame.select(stable_key(frame, "p", "q").alias("k")).collect()]
    assert plain[0] == plain[2] == plain[3] == plain[4] != plain[1]
    lists = [r.k for r in frame.select(stable_key(frame, "l").alias("k")).collect()]
    assert lists[0] == lists[1] == lists[2] != lists[3] and lists[3] == lists[4]


def test_statistics_that_need_no_ranks_run_no_selection(spark, monkeypatch):
    frame = spark.createDataFrame([(0, -1.5), (2, 0.0), (0, float("nan")), (None, 3.0)], "a int, b double")
    monkeypatch.setattr("tablelens.operators.profile.exact_quantiles", None)
    got = {r["column"]: r for r in number_statistics(frame, statistics=("pct_zero", "pct_negative")).collect()}
    assert {c: r["pct_zero"] for c, r in got.items()} == pytest.approx({"a": 2 / 3, "b": 1 / 3})
    assert {c: r["pct_negative"] for c, r in got.items()} == pytest.approx({"a": 0, "b": 1 / 3})


def test_values_are_counted_in_arrays(spark, monkeypatch):
    frame = spark.createDataFrame([(x,) for x in (float("-inf"), -1.0, None, 0.0, 0.0, 2.0, float("inf"))], "x double")
    wanted = [ranks._Wanted("x", 2, 6), ranks._Wanted("x", 2, 4, low=float("-inf"), high=float("inf"), before=1)]
    monkeypatch.setattr(ranks._Wanted, "narrowed", lambda w, *counts: setattr(w, "value", counts))
    ranks._narrow(frame.repartition(3), wanted, [(0.0, 2.0), (-1.0, -1.0)])
    assert [w.value for w in wanted] == [(0.0, 2.0, 2, 2, 0, 1), (-1.0, -1.0, 0, 1, 0, 0)]
