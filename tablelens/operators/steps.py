"""The step that explains most of a series beyond curve and seasons, with no task that holds a series.

The other terms are a constant, a line, a square and two harmonics of each season. Their products, summed up over a series,
give the terms that are independent of each other; freed of these, what a step at a place gains follows from sums over the
rows before that place. Such sums come from ranges of rows, each of which goes on where the ranges before it ended.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.functions.stats import t_tail
from tablelens.operators.ranks import running_counts

#: Rows at each end of a series where no step is looked for: a tenth, EDGE at least.
EDGE, EDGE_SHARE = 8, 0.1
#: Terms whose share of the spread is below this follow from the others.
DEPENDENT = 1e-10
#: What is left of a series below this share of its squares is rounding.
NO_REST = 1e-26


def _terms(n: Column, idx: Column, periods: Sequence[int]) -> list[Column]:
    """The terms at a row: a season counts if it is seen twice at least."""
    x = F.when(n > 1, 2 * idx / (n - 1) - 1).otherwise(F.lit(0.0))
    out = [F.lit(1.0), x, x * x]
    for period in periods:
        fits = (F.lit(period) >= 3) & (F.lit(period) <= n / 2)
        for harmonic in (1, 2):
            turn = idx * F.lit(2 * math.pi * harmonic / period)
            out += [F.when(fits, wave(turn)).otherwise(F.lit(0.0)) for wave in (F.sin, F.cos)]
    return out


def _by_series(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnRenamed("entity", "_entity")
    return left.join(right, F.col("entity").eqNullSafe(F.col("_entity"))).drop("_entity")


def best_steps(series: DataFrame, periods: Sequence[int]) -> DataFrame:
    """entity, at, size, p of each series of (entity, value, idx): the place of its best step, its size and its p-value.

    The size is relative: to the level before the step if all values are positive, else to the mean absolute value. Series
    too short for a step, or without spread, have none.
    """
    sizes = series.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), (F.min("value") > 0).alias("positive"), F.avg(F.abs("value")).alias("level"))
    edge = F.greatest(F.lit(EDGE), F.floor(EDGE_SHARE * F.col("n")))
    sizes = sizes.withColumn("edge", edge).filter(F.col("n") >= 2 * F.col("edge") + 8)
    rows = _by_series(series.select("entity", F.col("value").cast("double").alias("value"), F.col("idx").cast("double").alias("idx")), sizes)
    m = 3 + 4 * len(periods)
    names = [f"b{k}" for k in range(m)]
    y = F.when(F.col("positive"), F.log("value")).otherwise(F.col("value"))
    rows = rows.select("entity", "idx", "n", "positive", "level", "edge", y.alias("y"), *[t.alias(b) for t, b in zip(_terms(F.col("n"), F.col("idx"), periods), names, strict=True)])
    products = F.array(*[F.sum(F.col(a) * F.col(b)) for k, a in enumerate(names) for b in names[k:]])
    sums = rows.groupBy("entity").agg(products.alias("products"), F.array(*[F.sum(F.col(b) * F.col("y")) for b in names]).alias("with_y"))

    @F.pandas_udf("struct<line array<double>, freed array<double>, rank int>")
    def solved(products: pd.Series, with_y: pd.Series) -> pd.DataFrame:  # a row per series
        out = []
        for p, b in zip(products, with_y, strict=True):
            g = np.zeros((m, m))
            g[np.triu_indices(m)] = p
            values, vectors = np.linalg.eigh(g + np.triu(g, 1).T)
            keep = values > DEPENDENT * values[-1]
            freed = np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0)[:, None] * vectors.T
            out.append(((freed.T @ (freed @ np.asarray(b))).tolist(), freed.reshape(-1).tolist(), int(keep.sum())))
        return pd.DataFrame(out, columns=["line", "freed", "rank"])

    lines = sums.select("entity", solved("products", "with_y").alias("s")).select("entity", "s.*")
    rows = _by_series(rows, lines)
    rest = F.col("y") - reduce(Column.__add__, [F.col("line")[k] * F.col(b) for k, b in enumerate(names)])
    run = running_counts(rows.withColumn("rest", rest), ["entity"], "idx", "rest", names)
    after = [F.col(f"total_{b}") - F.col(f"before_{b}") for b in names]
    # the step's own spread, freed of the other terms
    own = F.col("n") - F.col("idx") - reduce(Column.__add__, [F.pow(reduce(Column.__add__, [F.col("freed")[r * m + c] * after[c] for c in range(m)]), F.lit(2)) for r in range(m)])
    run = run.select("entity", "idx", "n", "positive", "level", "edge", "rank", "rest", "y", (F.col("total") - F.col("before")).alias("tail"), own.alias("own"))
    effect = F.col("tail") / F.col("own")
    fits = (F.col("idx") >= F.col("edge")) & (F.col("idx") <= F.col("n") - F.col("edge")) & (F.col("own") > 1e-9)
    candidate = F.when(fits, F.struct((effect * F.col("tail")).alias("gain"), (-F.col("idx")).alias("back"), effect.alias("effect")))
    best = run.groupBy("entity").agg(F.max(candidate).alias("s"), F.sum(F.col("rest") * F.col("rest")).alias("left"), F.sum(F.col("y") * F.col("y")).alias("squares"), *[F.first(c).alias(c) for c in ("n", "positive", "level", "rank")])
    best = best.select("entity", (-F.col("s.back")).cast("long").alias("at"), F.col("s.gain").alias("gain"), F.col("s.effect").alias("effect"), "left", "squares", "positive", "level", (F.col("n") - F.col("rank") - 1).alias("dof"))

    @F.pandas_udf("double")
    def tail(f: pd.Series, dof: pd.Series) -> pd.Series:  # a value for each series
        return pd.Series([min(1.0, t_tail(math.sqrt(x), d)) for x, d in zip(f, dof, strict=True)], dtype=float)

    f = F.col("gain") / (F.greatest(F.col("left") - F.col("gain"), F.lit(1e-12)) / F.col("dof"))
    size = F.abs(F.when(F.col("positive"), F.expm1("effect")).otherwise(F.col("effect") / F.greatest(F.col("level"), F.lit(1e-12))))
    return best.filter(f"gain > 0 AND left > {NO_REST} * squares AND dof > 0").select("entity", "at", size.alias("size"), tail(f, F.col("dof")).alias("p"))
