"""Report packs: headline numbers, trend, breakdowns and detail of one table or several."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators.columns import profile_columns, rank_dimensions, rank_measures
from tablelens.operators.query import Dimension, Metric, QuerySpec, Sort, run_spec

MAX_TILES, DETAIL_ROWS, BREAKDOWN_ROWS = 10, 200, 25


class NothingToReport(ValueError):
    pass


@dataclass
class Pack:
    tiles: dict[str, DataFrame] = field(default_factory=dict)
    dropped: dict[str, str] = field(default_factory=dict)


def headline(frame: DataFrame, measure: str, second: str | None = None, key: str | None = None) -> DataFrame:
    """One row from one pass: total, records, average, and a distinct count or a second total."""
    aggs = [F.sum(measure).alias("total"), F.count(F.lit(1)).alias("records"), F.avg(measure).alias("average")]
    if key:
        aggs.append(F.count_distinct(key).alias("distinct_keys"))
    elif second:
        aggs.append(F.sum(second).alias("second_total"))
    return frame.agg(*aggs)


def headline_by_value(frame: DataFrame, measure: str, column: str, values: Sequence) -> DataFrame:
    """value, total: one filtered sum for each value, in the given order, from one pass."""
    one = frame.agg(*[F.sum(F.when(F.col(column) == v, F.col(measure))).alias(f"_{k}") for k, v in enumerate(values)])
    return one.select(F.posexplode(F.array(*[F.struct(F.lit(str(v)).alias("value"), F.col(f"_{k}").alias("total")) for k, v in enumerate(values)])).alias("place", "s")).select("place", "s.*").orderBy("place").drop("place")


def trend(frame: DataFrame, measure: str, time: str, grain: str = "month") -> DataFrame:
    return run_spec(frame, QuerySpec([Dimension(time, grain)], [Metric("sum", measure)], limit=50_000)).frame


def breakdown(frame: DataFrame, measure: str, dimension: str, rows: int = BREAKDOWN_ROWS) -> DataFrame:
    return run_spec(frame, QuerySpec([Dimension(dimension)], [Metric("sum", measure)], sort=[Sort(f"sum_{measure}", True), Sort(dimension)], limit=rows)).frame


def detail(frame: DataFrame, measures: Sequence[str], dimensions: Sequence[str], time: str | None = None) -> DataFrame:
    dims = [Dimension(time, "month")] if time else []
    dims += [Dimension(d) for d in dimensions[:3]]
    order = [Sort(f"sum_{measures[0]}", True), *[Sort(d.alias or (f"{d.column}_{d.grain}" if d.grain else d.column)) for d in dims]]
    return run_spec(frame, QuerySpec(dims, [Metric("sum", m) for m in measures[:3]], sort=order, limit=DETAIL_ROWS)).frame


def grouping_pack(frame: DataFrame, measure: str, time: str, dimensions: Sequence[str]) -> DataFrame:
    """tile, key, total: the total, the monthly trend and every breakdown from a single scan, by grouping sets."""
    rows = frame.select(F.date_trunc("month", time).cast("date").cast("string").alias("_month"), *[F.col(d).cast("string").alias(d) for d in dimensions], F.col(measure).alias("_m"))
    keys = ["_month", *dimensions]
    sets = [[], *[[F.col(k)] for k in keys]]
    out = rows.groupingSets(sets, *[F.col(k) for k in keys]).agg(F.sum("_m").alias("total"), F.grouping_id().alias("g"))
    every = (1 << len(keys)) - 1
    tile, key = F.lit("total"), F.lit(None).cast("string")
    for place, k in enumerate(keys):
        own = F.col("g") == every - (1 << (len(keys) - 1 - place))
        tile, key = F.when(own, "trend" if k == "_month" else k).otherwise(tile), F.when(own, F.col(k)).otherwise(key)
    return out.select(tile.alias("tile"), key.alias("key"), "total")


def pack(frame: DataFrame, profiled: DataFrame | None = None, measure: str | None = None, dimensions: Sequence[str] | None = None, values: tuple[str, Sequence] | None = None, n_kpis: int | None = None, grain: str = "month", with_trend: bool = True, with_detail: bool = True) -> Pack:
    """A table's tiles, at most ten: kpi, trend, breakdowns, detail. A tile that can't be planned is named and left out."""
    profiled = profile_columns(frame) if profiled is None else profiled
    facts = sorted((r.asDict() for r in profiled.select("column", "place", "semantic", "n_unique", "n_rows").collect()), key=lambda f: f["place"])  # a row per column
    measures = ([measure] if measure else []) + [m for m in rank_measures(facts) if m != measure]
    keys = [f["column"] for f in facts if f["semantic"] == "identifier"]
    repeating = [f["column"] for f in facts if f["semantic"] == "identifier" and 0 < f["n_unique"] < 0.9 * f["n_rows"]]
    times = [f["column"] for f in facts if f["semantic"] == "temporal"]
    dims = list(dimensions) if dimensions is not None else [r["column"] for r in rank_dimensions(profiled).orderBy("rank").collect()]
    if not measures and not keys:
        raise NothingToReport("neither a measure nor an identifier")
    out = Pack()

    def add(name: str, build) -> None:
        if len(out.tiles) >= MAX_TILES:
            return
        try:
            out.tiles[name] = build()
        except Exception as problem:  # noqa: BLE001 - analysis errors come when a plan is built
            out.dropped[name] = str(problem)

    if not measures:
        add("kpi", lambda: frame.agg(F.count(F.lit(1)).alias("records"), F.count_distinct(keys[0]).alias("distinct_keys")))
    elif values:
        add("kpi", lambda: headline_by_value(frame, measures[0], *values))
    else:
        first = headline(frame, measures[0], measures[1] if len(measures) > 1 else None, repeating[0] if repeating else None)
        n = max(1, min(6, n_kpis or 4))
        more = [m for m in measures[1:] if f"total_{m}" not in first.columns][: max(0, n - len(first.columns))]
        if more:
            first = first.join(F.broadcast(frame.agg(*[F.sum(m).alias(f"total_{m}") for m in more])))  # one row each
        add("kpi", lambda: first.select(*first.columns[:n]))
    if measures and times and with_trend:
        add("trend", lambda: trend(frame, measures[0], times[0], grain))
    for d in dims[:2] if measures else []:
        add(f"breakdown_{d}", lambda d=d: breakdown(frame, measures[0], d))
    if measures and dims and with_detail:
        add("detail", lambda: detail(frame, measures, dims, times[0] if times else None))
    return out


def packs(frames: dict[str, DataFrame]) -> DataFrame:
    """table, total, records, average of the first measure of each table."""
    rows = []
    for name, frame in frames.items():
        facts = [r.asDict() for r in profile_columns(frame).select("column", "place", "semantic").collect()]
        measures = rank_measures(facts)
        if measures:
            rows.append(headline(frame, measures[0]).select(F.lit(name).alias("table"), F.lit(measures[0]).alias("measure"), F.col("total").cast("double").alias("total"), "records", F.col("average").cast("double").alias("average")))
    return reduce(DataFrame.unionByName, rows)
