"""Sums of products of all pairs of columns, from one pass: what correlations, gaps that go together, collinearity and
outlier counts are worked out from. Each task multiplies its batches' matrices; only sums by pair of columns leave it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.operators.columns import tidy
from tablelens.operators.ranks import running_counts
from tablelens.sources.scratch import written

SUMS = "name string, at long, value double"
#: Variances below this share of the mean square are rounding errors.
NO_SPREAD = 1e-13


def _added(total: dict[str, np.ndarray], x: np.ndarray) -> None:
    """Adds the sums of a batch; x has a row per row and NaN where a value isn't known."""
    known = ~np.isnan(x)
    m, x = known.astype(float), np.where(known, x, 0.0)
    whole = known.all(axis=1)
    for name, value in (("n", m.T @ m), ("sum", x.T @ m), ("square", (x * x).T @ m), ("product", x.T @ x), ("whole_n", np.array([whole.sum()])), ("whole_sum", x[whole].sum(axis=0)), ("whole_product", x[whole].T @ x[whole])):
        total[name] = total.get(name, 0) + value


def _given(total: dict[str, np.ndarray]) -> pa.RecordBatch:
    names = [n for n, v in total.items() for _ in range(v.size)]
    at = np.concatenate([np.arange(v.size) for v in total.values()]) if total else np.zeros(0, np.int64)
    values = np.concatenate([np.asarray(v, float).reshape(-1) for v in total.values()]) if total else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(at, pa.int64()), pa.array(values, pa.float64())], ["name", "at", "value"])


def _summed(batches: Iterator[pa.RecordBatch], numbers: int, shift: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Columns are the numbers, as doubles, and then whether each of the other columns is null."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        x = np.stack([c.astype(float) for c in columns[:numbers]], axis=1) if numbers else np.zeros((batch.num_rows, 0))
        gaps = np.concatenate([np.isnan(x), *[c.astype(bool)[:, None] for c in columns[numbers:]]], axis=1).astype(float)
        total["rows"] = total.get("rows", 0) + np.array([float(len(x))])
        total["gaps"] = total.get("gaps", 0) + gaps.T @ gaps
        with np.errstate(invalid="ignore"):
            total["outside"] = total.get("outside", 0) + ((x < low) | (x > high)).sum(axis=0)
        _added(total, x - shift)
    yield _given(total)


@dataclass
class Moments:
    """Sums over pairs (a, b) of `numbers`, over rows where both are known, with `shift` taken off each column: n, sum (of
    a), square (of a), product; the same over rows where all are known; and for all `columns`: rows where a and b are null."""

    numbers: list[str]
    columns: list[str]
    rows: int
    gaps: np.ndarray
    outside: np.ndarray
    n: np.ndarray
    sum: np.ndarray
    square: np.ndarray
    product: np.ndarray
    whole_n: int
    whole_sum: np.ndarray
    whole_product: np.ndarray

    def correlation(self, i: int, j: int) -> tuple[float | None, int]:
        """Pearson's r of two numbers over the rows where both are known, and how many those are; None without spread."""
        n = self.n[i, j]
        if n == 0:
            return None, 0
        a, b = self.sum[i, j] / n, self.sum[j, i] / n
        va, vb = self.square[i, j] / n - a * a, self.square[j, i] / n - b * b
        if va <= NO_SPREAD * self.square[i, j] / n or vb <= NO_SPREAD * self.square[j, i] / n:
            return None, int(n)
        return float((self.product[i, j] / n - a * b) / np.sqrt(va * vb)), int(n)

    def gap_correlation(self, i: int, j: int) -> float | None:
        """Pearson's r of two columns' null indicators; None where one is never or always null."""
        n, a, b, both = self.rows, self.gaps[i, i], self.gaps[j, j], self.gaps[i, j]
        if not 0 < a < n or not 0 < b < n:
            return None
        return float((both / n - a * b / n / n) / np.sqrt(a / n * (1 - a / n) * b / n * (1 - b / n)))

    def inflation(self) -> list[tuple[str, float, float, int]]:
        """(column, vif, r2, n) over the rows where all numbers are known; none if these are too few or columns under three.
        A column that follows from the others exactly has the factor 1e6. Columns without spread are left out."""
        n = self.whole_n
        if not n:
            return []
        mean = self.whole_sum / n
        cov = self.whole_product / n - np.outer(mean, mean)
        fit = [k for k in range(len(self.numbers)) if cov[k, k] > NO_SPREAD * self.whole_product[k, k] / n]
        if len(fit) < 3 or n < len(fit) + 5:
            return []
        spread = np.sqrt(np.diag(cov)[fit])
        r = cov[np.ix_(fit, fit)] / np.outer(spread, spread)
        values, vectors = np.linalg.eigh(r)
        # small eigenvalues are dependences: they weigh on the columns that take part in them
        inverse = (vectors**2 / np.maximum(values, 1e-12)).sum(axis=1)
        factors = np.clip(inverse, 1, 1e6)
        return [(self.numbers[k], float(v), float(1 - 1 / v), int(n)) for k, v in zip(fit, factors, strict=True)]


def _collected(sums: DataFrame, numbers: Sequence[str], columns: Sequence[str]) -> Moments:
    table = sums.groupBy("name", "at").agg(F.sum("value").alias("value")).toArrow()  # by pair of columns
    k, c = len(numbers), len(columns)
    shapes = {"rows": (1,), "gaps": (c, c), "outside": (k,), "n": (k, k), "sum": (k, k), "square": (k, k), "product": (k, k), "whole_n": (1,), "whole_sum": (k,), "whole_product": (k, k)}
    out = {name: np.zeros(int(np.prod(shape))) for name, shape in shapes.items()}
    for name, at, value in zip(*(x.to_pylist() for x in table.select(["name", "at", "value"]).columns), strict=True):
        out[name][at] += value
    made = {name: out[name].reshape(shape) for name, shape in shapes.items()}
    return Moments(list(numbers), list(columns), rows=int(made.pop("rows")[0]), whole_n=int(made.pop("whole_n")[0]), **made)


def moments(frame: DataFrame, numbers: Sequence[str], others: Sequence[str] = (), means: dict[str, float] | None = None, fences: dict[str, tuple[float, float]] | None = None) -> Moments:
    """The sums of all pairs of `numbers`, and of the gaps of these and the `others`, in one scan. `means`, about which
    sums are taken so that they keep their digits, cost a scan if they aren't given. outside: values beyond `fences`."""
    numbers, others = list(numbers), list(others)
    if not numbers and not others:
        return _collected(frame.sparkSession.createDataFrame([], SUMS), [], [])
    frame = tidy(frame)
    plain = frame.select(*[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(numbers)], *[F.col(c).isNull().alias(f"g{k}") for k, c in enumerate(others)])
    if means is None:
        row = plain.agg(F.count(F.lit(1)), *[F.avg(f"_{k}") for k in range(len(numbers))]).first()
        means = {c: row[k + 1] for k, c in enumerate(numbers)}
    fences = fences or {}
    shift = np.array([means.get(c) or 0.0 for c in numbers])
    low, high = (np.array([fences[c][side] if c in fences else sign * np.inf for c in numbers]) for side, sign in ((0, -1), (1, 1)))
    return _collected(plain.mapInArrow(partial(_summed, numbers=len(numbers), shift=shift, low=low, high=high), SUMS), numbers, [*numbers, *others])


def _rank_sums(batches: Iterator[pa.RecordBatch], width: int, shift: float) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        cells = batch.column(0)
        counts = np.diff(cells.offsets.to_numpy())
        x = np.full((len(cells), width), np.nan)
        flat = cells.flatten()
        x[np.repeat(np.arange(len(cells)), counts), flat.field("k").to_numpy()] = flat.field("rank").to_numpy() - shift
        _added(total, x)
    total = {name: v for name, v in total.items() if not name.startswith("whole")}
    yield _given(total)


def rank_correlations(frame: DataFrame, columns: Sequence[str], m: Moments | None = None) -> DataFrame:
    """a, b, rho, r, n of all pairs of columns: Spearman's and Pearson's coefficients over the rows where both are known.

    Ranks of all columns come from one shuffle of (column, value) by ranges, and go back to their rows by another; the rows'
    ranks are multiplied as in `moments`. Ranks are average ranks. A column has ranks among all its values, and beside each
    column that has gaps, ranks of their own among the rows where that one is known; they share the same shuffles.
    """
    columns, spark = list(columns), frame.sparkSession
    m = m or moments(frame, columns)
    at = {c: m.numbers.index(c) for c in columns}
    gappy = {c for c in columns if m.n[at[c], at[c]] < m.rows}
    kinds: dict[tuple[str, str | None], int] = {}
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    ranked = lambda a, b: kinds.setdefault((a, b if b in gappy else None), len(kinds))
    wanted = [(a, b, ranked(a, b), ranked(b, a)) for a, b in pairs]
    schema = "a string, b string, rho double, r double, n long"
    if not wanted:
        return spark.createDataFrame([], schema)
    rows = written(tidy(frame).select(F.monotonically_increasing_id().alias("row"), *[F.col(c).cast("double").alias(f"_{k}") for k, c in enumerate(columns)]), "numbers")
    place = {c: F.col(f"_{k}") for k, c in enumerate(columns)}

    def cell(k: int, a: str, b: str | None) -> Column:
        known = place[a].isNotNull() if b is None else place[a].isNotNull() & place[b].isNotNull()
        return F.when(known, F.struct(F.lit(k).alias("k"), place[a].alias("v")))

    cells = rows.select("row", F.explode(F.array_compact(F.array(*[cell(k, a, b) for (a, b), k in kinds.items()]))).alias("c")).select("row", "c.k", "c.v")
    counts = cells.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    ranks = running_counts(counts, ["k"]).select(F.col("k").alias("_k"), F.col("v").alias("_v"), (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))
    back = cells.join(ranks, (F.col("k") == F.col("_k")) & (F.col("v") == F.col("_v"))).groupBy("row").agg(F.collect_list(F.struct("k", "rank")).alias("cells"))  # a cell per column
    g = _collected(back.select("cells").mapInArrow(partial(_rank_sums, width=len(kinds), shift=m.rows / 2), SUMS), [str(k) for k in range(len(kinds))], [])
    found = [(a, b, g.correlation(x, y)[0], *m.correlation(at[a], at[b])) for a, b, x, y in wanted]
    return spark.createDataFrame(found, schema)
