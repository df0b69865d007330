"""Detectors beside plain computations, on data whose structure is known by construction."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.functions.stats import correlation_p, t_tail
from tablelens.operators import patterns, series
from tablelens.operators.profile import profile
from tablelens.operators.steps import best_steps


def refitted(values, periods):
    """(place, F) of the best step, by fitting every candidate from scratch."""
    n = len(values)
    y = np.log(values) if (values > 0).all() else values
    x, k = np.linspace(-1, 1, n), np.arange(n)
    base = [np.ones(n), x, x**2]
    for period in periods:
        for harmonic in (1, 2):
            base += [np.sin(2 * np.pi * harmonic * k / period), np.cos(2 * np.pi * harmonic * k / period)]
    base = np.stack(base, axis=1)
    rest = lambda m: float(((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum())
    without, edge = rest(base), max(8, n // 10)
    found = []
    for at in range(edge, n - edge + 1):
        within = rest(np.column_stack([base, (k >= at).astype(float)]))
        found.append(((without - within) / (within / (n - base.shape[1] - 1)), at))
    return max(found)[1], max(found)[0]


def made(size, place, periods):
    rng = np.random.default_rng(len(periods) + place)
    k = np.arange(110)
    return (40 + 0.1 * k + 4 * np.sin(2 * np.pi * k / 12)) * (1 + size * (k >= place)) + rng.normal(0, 0.6, 110)


def steps(spark, series, periods):
    rows = [(name, int(k), float(v)) for name, values in series.items() for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "entity string, idx long, value double").repartition(5)
    return {r["entity"]: (r["at"], r["size"], r["p"]) for r in best_steps(frame, periods).collect()}


@pytest.mark.parametrize("periods", [(), (12,), (7, 12, 60)])
def test_steps_equal_those_of_fitting_every_candidate(spark, periods):
    kinds = {"none": (0.0, 50), "up": (0.5, 70), None: (-0.3, 61), "small": (0.2, 40)}
    series = {name: made(size, place, periods) for name, (size, place) in kinds.items()}
    long = 40 + 4.0 * (np.arange(3000) >= 900) + np.random.default_rng(1).normal(0, 0.5, 3000)
    found = steps(spark, series | {"long": long, "short": [1.0] * 20, "flat": [5.0] * 60}, periods)
    assert {"short", "flat"}.isdisjoint(found)
    fit = [p for p in periods if p <= 55]  # longer seasons aren't seen twice
    for name, values in series.items():
        at, size, p = found[name]
        want, f = refitted(values, fit)
        assert at == want and p == pytest.approx(t_tail(math.sqrt(f), 110 - 3 - 4 * len(fit) - 1), rel=1e-5, abs=1e-12)
        if 12 in periods and name in ("up", None):
            assert abs(at - kinds[name][1]) <= 2 and size == pytest.approx(abs(kinds[name][0]), abs=0.1) and p < 1e-6
    assert abs(found["long"][0] - 900) <= 3


def test_size_of_a_step_between_signs_is_taken_of_the_whole_level(spark):
    values = np.concatenate([np.full(50, -2.0), np.full(50, 6.0)]) + np.tile([0.1, -0.1], 50)
    at, size, p = steps(spark, {"x": values}, ())["x"]
    assert at == 50 and p < 1e-6 and size == pytest.approx(8 / np.abs(values).mean(), rel=0.05)


def monthly(spark, values, name):
    start = dt.datetime(2010, 1, 1)
    rows = [(start.replace(year=2010 + k // 12, month=1 + k % 12), float(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"month timestamp_ntz, {name} double")


def test_series_findings_of_closed_forms(spark):
    k = np.arange(96)
    kinds = lambda values: {r["kind"]: r for r in patterns.series_findings(monthly(spark, values, "made"), "month", "made", "MS").collect()}
    line = kinds(400.0 + 2 * k + np.where(k % 2, 0.5, -0.5))
    assert line["trend"]["severity"] == "strong" and float(line["trend"]["evidence"]["slope"]) == pytest.approx(2, abs=0.01) and "changepoint" not in line
    wave = kinds(80 + 10 * np.cos(np.pi * k / 3) + np.where(k % 5 == 0, 1.0, 0))
    assert wave["seasonality"]["evidence"]["period"] == "6" and "trend" not in wave
    louder = kinds(np.where(k < 48, 1, 5) * np.where(k % 2, 1.0, -1.0) + 100)
    assert louder["variance_drift"]["statistic"] == pytest.approx(5)


def test_shapes_of_columns(spark):
    rows = [(float(2 ** (k % 12)), float(k % 50), 0.0 if k % 5 < 3 else float(k)) for k in range(1_000)]
    frame = spark.createDataFrame(rows, "doubling double, even double, mostly_none double")
    p = profile(frame)
    skewed = {r["columns"][0] for r in patterns.skewed(p).collect()}
    assert "doubling" in skewed and "even" not in skewed
    assert [r["columns"][0] for r in patterns.zero_inflation(p).collect()] == ["mostly_none"]
    out = {r["column"]: r for r in patterns.outlier_counts(frame, ["doubling", "even"]).collect()}
    q1, q3 = np.percentile([r[0] for r in rows], [25, 75])
    assert out["doubling"]["n_out"] == sum(r[0] > q3 + 1.5 * (q3 - q1) for r in rows) > 0 and out["even"]["n_out"] == 0


def test_pairs_of_columns(spark):
    rng = random.Random(31)
    rows = []
    for _ in range(700):
        a = rng.randint(1, 40)
        rows.append((float(a), 4.0 - a / 2, math.exp(a / 2), float(rng.choice([-1, 1]))))
    frame = spark.createDataFrame(rows, "a double, down double, steep double, coin double")
    found = {tuple(r["columns"]): r for r in patterns.correlation(frame, ["a", "down", "coin"]).collect()}
    assert set(found) == {("a", "down")} and found["a", "down"]["statistic"] == pytest.approx(-1) and found["a", "down"]["severity"] == "strong" and found["a", "down"]["p_value"] == pytest.approx(0, abs=1e-9)
    assert {tuple(r["columns"]) for r in patterns.nonlinear(frame, ["a", "steep", "coin"]).collect()} == {("a", "steep")}


def test_findings_about_a_target(spark):
    rows = [(float(k), k * 3.0 + 1, "xyz"[k % 3], [5.0, 50.0, 500.0][k % 3] + k % 2, int(k % 40 == 0)) for k in range(1_200)]
    frame = spark.createDataFrame(rows, "goal double, copied double, kind string, level double, rare int")
    assert [(r["kind"], r["columns"]) for r in patterns.target_findings(frame, "goal", ["copied", "level"]).collect()] == [("target_leakage", ["copied", "goal"])]
    assert patterns.group_effect(frame, "level", ["kind"]).first()["statistic"] == pytest.approx(1, abs=1e-3)
    uneven = patterns.class_findings(frame, "rare").filter("kind = 'class_imbalance'").first()
    assert uneven["severity"] == "strong" and uneven["statistic"] == pytest.approx(39)


def test_clusters(spark):
    rng = random.Random(12)
    rows = [(x + rng.random(), y + rng.random()) for x, y in ((0, 0), (9, 0), (0, 9), (9, 9)) for _ in range(40)]
    found = patterns.cluster_structure(spark.createDataFrame(rows, "a double, b double"), ["a", "b"], seeds=2).first()
    assert found["severity"] == "strong" and found["evidence"]["k"] == "4"


def test_clusters_count_copies_of_a_row(spark):
    frame = spark.range(5_000).selectExpr("double(id % 2) AS a", "double(id % 2) AS b")
    found = patterns.cluster_structure(frame, ["a", "b"], seeds=1).first()
    assert found["severity"] == "strong" and found["statistic"] > 0.99


def test_series_skip_empty_periods_only_for_means(spark):
    frame = spark.createDataFrame([(dt.datetime(2024, 1, 1), 2.0, 2.0), (dt.datetime(2024, 1, 3), 4.0, 4.0)], "d timestamp_ntz, amount double, price double")
    assert [r["value"] for r in series.regular_series(frame, "d", "amount", "D").orderBy("idx").collect()] == [2.0, 0.0, 4.0]
    assert [r["value"] for r in series.regular_series(frame, "d", "price", "D").orderBy("idx").collect()] == [2.0, 4.0]


def test_gaps_across_ranges(spark):
    rng = random.Random(2)
    times = sorted({dt.datetime(2020, 1, 1) + dt.timedelta(minutes=rng.randrange(400_000)) for _ in range(900)})
    frame = spark.createDataFrame([(x,) for x in times + times[:50]], "t timestamp_ntz")
    found = {r["t"]: r["gap_days"] for r in series.time_gaps(frame, "t").collect()}
    want = {b: (b - a).total_seconds() / 86_400 for a, b in zip(times, times[1:], strict=False)}
    assert len(found) == len(times) and found[times[0]] is None and all(found[t] == pytest.approx(g) for t, g in want.items())


def test_tails():
    assert abs(t_tail(2.228, 10) - 0.05) < 1e-4
    assert abs(correlation_p(0.5, 20) - 0.02478) < 1e-4


def test_times_are_counted_once(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("timestamp")
    def counted(day):
        seen.add(1)
        return dt.datetime(2024, 1, 1) + dt.timedelta(days=day)

    frame = spark.createDataFrame([(d,) for d in (0, 1, 2, 3, 4, 30, 31)], "day int").select(counted.asNondeterministic()("day").alias("t"))
    found = {r["kind"]: r["statistic"] for r in patterns.temporal(frame, "t").collect()}
    assert found == {"temporal_coverage": 31, "temporal_gaps": 1} and seen.value == 7


def test_small_jobs_run_side_by_side_on_even_parts(spark):
    from tablelens.sources.scratch import evenly, side_by_side

    assert side_by_side(spark, lambda n: spark.range(n).count(), range(9)) == list(range(9))
    parts = evenly(spark.range(0, 250_000, 1, 1), 250_000).groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == 3 and max(r["count"] for r in parts) <= 100_000
