"""Exact quantiles and ranks at scale: no task holds a column's distinct values.

Quantiles of whole columns come from selection: a sketch names two values around each wanted rank, one aggregate counts
the rows below, at and between them, and only what lies between is looked at again, until so few rows are left that they
are sorted. All columns and ranks share each pass. Ranks of all values, and quantiles of groups, come from counts of
distinct values in ranges: each range is summed up by itself and goes on where the ranges before it ended.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelens.sources.scratch import written

#: Rows between two bounds that are sorted in the end, for each wanted rank.
FEW = 10_000
#: Of the sketch: a value it names is off its rank by one row in ACCURACY at most.
ACCURACY = 10_000
#: What is counted around two values a and b.
COUNTS = ("below", "at_a", "between", "at_b")


@dataclass
class _Wanted:
    """The value of rank `rank` (from 0) of a column. It lies strictly between low and high, `inside` rows do, and `before`
    rows don't lie above low."""

    column: str
    rank: int
    inside: int
    low: float | None = None
    high: float | None = None
    before: int = 0
    value: float | None = None

    def among(self) -> Column:
        c = F.col(self.column)
        out = c.isNotNull()
        if self.low is not None:
            out &= c > F.lit(self.low)
        return out if self.high is None else out & (c < F.lit(self.high))

    def narrowed(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        """Take the part that holds the rank: below a, a, between a and b, b, or above b."""
        k = self.rank - self.before
        if k < below:
            self.high, self.inside = a, below
        elif k < below + at_a:
            self.value = a
        elif k < below + at_a + between:
            self.low, self.high, self.before, self.inside = a, b, self.before + below + at_a, between
        elif k < below + at_a + between + at_b:
            self.value = b
        else:
            known = below + at_a + between + at_b
            self.low, self.before, self.inside = b, self.before + known, self.inside - known


def _around(q: float, accuracy: int) -> list[float]:
    """The shares at which the sketch is asked, below and above."""
    return [max(0.0, q - 2 / accuracy), min(1.0, q + 2 / accuracy)]


def _sketched(frame: DataFrame, open_: list[_Wanted], accuracy: int) -> list[tuple[float, float]]:
    share = lambda w: (w.rank - w.before) / max(1, w.inside - 1)
    row = frame.agg(*[F.percentile_approx(F.when(w.among(), F.col(w.column)), _around(share(w), accuracy), accuracy).alias(f"_{k}") for k, w in enumerate(open_)]).first()
    return [tuple(x) for x in row]


def _narrow(frame: DataFrame, open_: list[_Wanted], pairs: list[tuple[float, float]]) -> None:
    """Count below, at and between the two values around each wanted rank, in one pass for all. There are four counts for
    each rank, too many for one compiled aggregate, so tasks count in arrays; a row per rank leaves each."""
    columns = list(dict.fromkeys(w.column for w in open_))
    asked = [(columns.index(w.column), w.low, w.high, *pairs[k]) for k, w in enumerate(open_)]
    plain = frame.select(*[F.col(c).alias(f"_{k}") for k, c in enumerate(columns)])
    counted = plain.mapInArrow(partial(_counted, asked=asked), ", ".join(["k int", *(f"{n} long" for n in COUNTS)]))
    for r in counted.groupBy("k").agg(*[F.sum(n).alias(n) for n in COUNTS]).collect():  # a row per wanted rank
        open_[r["k"]].narrowed(*pairs[r["k"]], *[r[n] for n in COUNTS])


def _counted(batches: Iterator[pa.RecordBatch], asked: list[tuple]) -> Iterator[pa.RecordBatch]:
    """COUNTS of each (column, low, high, a, b), over the values between low and high."""
    total = np.zeros((len(asked), len(COUNTS)), np.int64)
    for batch in batches:
        values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]  # nulls become NaN, which no comparison holds for
        for k, (column, low, high, a, b) in enumerate(asked):
            x = values[column]
            x = x if low is None else x[x > low]
            x = x if high is None else x[x < high]
            total[k] += [(x < a).sum(), (x == a).sum(), ((x > a) & (x < b)).sum(), (x == b).sum() if a < b else 0]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(asked)), pa.int32()), *[pa.array(c, pa.int64()) for c in total.T]], ["k", *COUNTS])


def _picked(frame: DataFrame, open_: list[_Wanted]) -> None:
    """The values among the few rows that are left, by their order within each wanted rank's rows."""
    cells = F.array_compact(F.array(*[F.when(w.among(), F.struct(F.lit(k).alias("k"), F.col(w.column).alias("v"))) for k, w in enumerate(open_)]))
    counts = frame.select(F.explode(cells).alias("c")).groupBy("c.k", "c.v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v"))  # few rows for each k
    left = F.create_map(*[F.lit(x) for k, w in enumerate(open_) for x in (k, w.rank - w.before)])[F.col("k")]
    rows = counts.withColumn("upto", upto).filter((F.col("upto") > left) & (F.col("upto") - F.col("n") <= left)).select("k", "v").collect()  # a row per wanted rank
    for r in rows:
        open_[r["k"]].value = r["v"]


def exact_quantiles(frame: DataFrame, wanted: dict[str, Sequence[float]], few: int = FEW, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """For each column its quantiles, interpolated between neighbours; None where a column has no value. Columns are taken
    as doubles without NaN."""
    columns = list(wanted)
    if not columns:
        return {}
    plain = {c: F.col(c).cast("double") for c in columns}
    frame = frame.select(*[F.when(~F.isnan(x), x).alias(c) for c, x in plain.items()])
    around = {c: [q for p in wanted[c] for q in _around(p, accuracy)] for c in columns}
    first = frame.agg(*[F.struct(F.count(c).alias("n"), F.percentile_approx(c, around[c], accuracy).alias("q")).alias(f"_{k}") for k, c in enumerate(columns)]).first()
    sizes, asked, pairs = [r["n"] for r in first], {}, {}
    for k, c in enumerate(columns):
        for at, p in enumerate(wanted[c]):
            place = p * (sizes[k] - 1)
            for rank in {int(place), min(int(place) + (place > int(place)), sizes[k] - 1)} if sizes[k] else ():
                asked[c, rank] = _Wanted(c, rank, sizes[k])
                pairs[c, rank] = tuple(first[k]["q"][2 * at : 2 * at + 2])
    while open_ := [w for w in asked.values() if w.value is None and w.inside > few]:
        _narrow(frame, open_, [pairs[w.column, w.rank] for w in open_] if pairs else _sketched(frame, open_, accuracy))
        pairs = {}
    if open_ := [w for w in asked.values() if w.value is None]:
        _picked(frame, open_)
    out: dict[str, list[float | None]] = {}
    for k, c in enumerate(columns):
        values = []
        for p in wanted[c]:
            place = p * (sizes[k] - 1)
            if not sizes[k]:
                values.append(None)
                continue
            low = asked[c, int(place)].value
            values.append(low if place == int(place) else low + (asked[c, int(place) + 1].value - low) * (place - int(place)))
        out[c] = values
    return out


def running_counts(counts: DataFrame, keys: Sequence[str], value: str = "v", n: str = "n", more: Sequence[str] = ()) -> DataFrame:
    """`counts` (a row per key and value) with `before`, the sum of n over a key's smaller values, and `total`; for other
    columns to be summed up, `more`, likewise before_ and total_ with their names.

    Rows are dealt by ranges of key and value and written; each range is summed up by itself, and a key goes on with what
    its earlier ranges hold. A key of very many values lies in many ranges.
    """
    ranged = counts.repartitionByRange(*[F.asc(k) for k in keys], F.asc(value)).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sums = {n: ("before", "total")} | {c: (f"before_{c}", f"total_{c}") for c in more}
    parts = ranged.groupBy("_range", *keys).agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    w = Window.partitionBy(*keys)
    carried = [x for c, (_, total) in sums.items() for x in ((F.sum(f"_s_{c}").over(w.orderBy("_range")) - F.col(f"_s_{c}")).alias(f"_b_{c}"), F.sum(f"_s_{c}").over(w).alias(total))]
    parts = parts.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k_{k}") for k in keys], *carried)  # a row per key and range
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inner = Window.partitionBy("_range", *keys).orderBy(value)
    ranged = ranged.withColumns({f"_i_{c}": F.sum(c).over(inner) - F.col(c) for c in sums})
    return ranged.join(parts, same).select(*counts.columns, *[x for c, (before, total) in sums.items() for x in ((F.col(f"_b_{c}") + F.col(f"_i_{c}")).alias(before), total)])


def grouped_quantiles(frame: DataFrame, keys: Sequence[str], column: str, p: float, alias: str) -> DataFrame:
    """keys and `alias`: the exact quantile of a column in each group, interpolated; null where a group has no value. No
    task holds a group's values: those of a large group lie in many ranges."""
    x = F.col(column).cast("double")
    values = frame.filter(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, x.alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_counts(values, keys, "_v", "_n")
    place = F.lit(p) * (F.col("total") - 1)
    low, high = F.floor(place), F.ceil(place)
    holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("_n"))
    near = ranked.withColumns({"_low": F.when(holds(low), F.col("_v")), "_high": F.when(holds(high), F.col("_v")), "_part": place - low}).filter("_low IS NOT NULL OR _high IS NOT NULL")
    return near.groupBy(*keys).agg((F.max("_low") + (F.max("_high") - F.max("_low")) * F.max("_part")).alias(alias))
