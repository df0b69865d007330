"""Declarative aggregate queries over one table: dimensions, time buckets, metrics, filters, sort, limit."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens.functions.names import clean_alias, resolve
from tablelens.operators.ranks import exact_quantiles, grouped_quantiles

MAX_ROWS, DEFAULT_ROWS = 50_000, 1_000
#: A limit that says outright that all rows are wanted.
ALL_ROWS = "all"
GRAINS = ("day", "week", "month", "quarter", "year")
AGGREGATES = ("sum", "avg", "min", "max", "count", "count_distinct", "median", "stddev")
DATE_PATTERNS = ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y", "%Y-%m", "%Y")


class BadQuery(ValueError):
    """The query can't be answered; raised before any job starts."""


@dataclass(frozen=True)
class Dimension:
    column: str
    grain: str | None = None
    alias: str | None = None


@dataclass(frozen=True)
class Metric:
    agg: str
    column: str = "*"
    alias: str | None = None
    approximate: bool = False


@dataclass(frozen=True)
class Filter:
    column: str
    op: str
    value: Any = None


@dataclass(frozen=True)
class Sort:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class QuerySpec:
    dimensions: Sequence[Dimension] = ()
    metrics: Sequence[Metric] = ()
    filters: Sequence[Filter] = ()
    sort: Sequence[Sort] = ()
    limit: int | str | None = None  # ALL_ROWS for no limit


@dataclass
class Answer:
    frame: DataFrame
    warnings: list[str] = field(default_factory=list)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_temporal(kind: T.DataType) -> bool:
    return isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType)


def number(value: Any) -> Any:
    if isinstance(value, bool) or value is None:
        raise BadQuery(f"not a number: {value!r}")
    if isinstance(value, int | float | decimal.Decimal):
        return value
    text = str(value).strip()
    try:
        return float(text) if set(text.lower()) & set(".e") else int(text)
    except ValueError:
        raise BadQuery(f"not a number: {value!r}") from None


def moment(value: Any) -> dt.datetime:
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    text = str(value).strip()
    for pattern in DATE_PATTERNS:
        try:
            return dt.datetime.strptime(text, pattern)
        except ValueError:
            continue
    try:
        return dt.datetime.fromisoformat(text)
    except ValueError:
        raise BadQuery(f"not a date: {value!r}") from None


def operand(value: Any, kind: T.DataType) -> Column:
    """A literal of the column's own type, so that filters reach the scan."""
    if is_temporal(kind):
        return F.lit(moment(value)).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1", "yes", "y"))
    if is_numeric(kind):
        return F.lit(number(value))
    return F.lit(str(value))


def condition(c: Column, kind: T.DataType, op: str, value: Any, as_of: dt.date | None = None) -> Column:
    """One filter as a boolean column. as_of stands for the current date in last_n_days and last_n_months."""
    lit = lambda v: operand(v, kind)
    compare = {"=": lambda v: c == lit(v), "!=": lambda v: c != lit(v), ">": lambda v: c > lit(v), ">=": lambda v: c >= lit(v), "<": lambda v: c < lit(v), "<=": lambda v: c <= lit(v)}
    if op in compare:
        return compare[op](value)
    if op in ("is_null", "is_not_null"):
        return c.isNull() if op == "is_null" else c.isNotNull()
    if op in ("in", "not_in"):
        values = list(value) if isinstance(value, list | tuple | set) else [value]
        found = c.isin(*[lit(v) for v in values])
        return found if op == "in" else ~found
    if op == "between":
        if not isinstance(value, list | tuple) or len(value) != 2:
            raise BadQuery("between needs exactly two values")
        return c.between(lit(value[0]), lit(value[1]))
    if op in ("contains", "starts_with"):
        text, needle = F.lower(c.cast("string")), F.lower(F.lit(str(value)))
        return text.contains(needle) if op == "contains" else text.startswith(needle)
    if op in ("last_n_days", "last_n_months"):
        if not is_temporal(kind):
            raise BadQuery(f"{op} needs a column of dates")
        n = int(number(value[0] if isinstance(value, list | tuple) else value))
        today = F.lit(as_of) if as_of else F.current_date()
        return c >= (F.date_sub(today, n) if op == "last_n_days" else F.add_months(today, -n)).cast(kind)
    raise BadQuery(f"unknown operator {op!r}")


def bucket(c: Column, grain: str) -> Column:
    """Start of the day, week (Monday), month, quarter or year."""
    return F.date_trunc(grain, c).cast("timestamp_ntz")


def aggregate(m: Metric, frame: DataFrame, column: str, semantic: str | None) -> Column:
    if m.agg not in AGGREGATES:
        raise BadQuery(f"unknown aggregate {m.agg!r}")
    if column == "*":
        if m.agg != "count":
            raise BadQuery("* can only be counted")
        return F.count(F.lit(1))
    kind, c = frame.schema[column].dataType, F.col(column)
    if m.agg in ("sum", "avg", "median", "stddev") and not is_numeric(kind):
        raise BadQuery(f"{m.agg} needs numbers; {column} has {kind.simpleString()}")
    if m.agg == "sum" and semantic == "identifier":
        raise BadQuery(f"{column} names things; its sum means nothing")
    distinct = F.approx_count_distinct if m.approximate else F.count_distinct
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "count_distinct": distinct, "median": lambda c: F.percentile_approx(c, 0.5, 10_000).cast("double"), "stddev": F.stddev_samp}[m.agg](c)


def row_limit(limit: int | str | None) -> int | None:
    if limit == ALL_ROWS:
        return None
    return max(1, min(MAX_ROWS, limit or DEFAULT_ROWS))


def run_spec(frame: DataFrame, spec: QuerySpec, semantics: dict[str, str] | None = None, synonyms: dict[str, Sequence[str]] | None = None, as_of: dt.date | None = None) -> Answer:
    """The query's DataFrame. Everything is checked against the schema first; only exact medians run before the caller asks."""
    semantics, warnings = semantics or {}, []
    find = lambda name: resolve(name, frame.columns, synonyms)
    dims: list[tuple[str, Column, str]] = []
    for d in spec.dimensions:
        column = find(d.column)
        if d.grain is None:
            dims.append((clean_alias(d.alias or column), F.col(column), column))
            continue
        if d.grain not in GRAINS:
            raise BadQuery(f"unknown grain {d.grain!r}")
        if not is_temporal(frame.schema[column].dataType):
            raise BadQuery(f"{column} has no dates to bucket")
        dims.append((clean_alias(d.alias or f"{column}_{d.grain}"), bucket(F.col(column), d.grain), column))
    metrics: list[tuple[str, Column, str]] = []
    for m in spec.metrics:
        column = "*" if m.column == "*" else find(m.column)
        alias = clean_alias(m.alias or ("row_count" if column == "*" else f"{m.agg}_{column}"))
        metrics.append((alias, aggregate(m, frame, column, semantics.get(column)), column))
    aliases = [a for a, _, _ in [*dims, *metrics]]
    if len(set(aliases)) < len(aliases):
        raise BadQuery(f"two outputs have one name: {', '.join(sorted(a for a in set(aliases) if aliases.count(a) > 1))}")
    having, medians = {a for a, _, _ in metrics}, [m.agg == "median" and not m.approximate for m in spec.metrics]
    out, after = frame, []
    for f in spec.filters:
        if clean_alias(f.column) in having and f.column.lower() not in {c.lower() for c in frame.columns}:
            after.append(f)
            continue
        column = find(f.column)
        out = out.filter(condition(F.col(column), frame.schema[column].dataType, f.op, f.value, as_of))
    if metrics:
        keys = [c.alias(a) for a, c, _ in dims]
        plain = [c.alias(a) for (a, c, _), median in zip(metrics, medians, strict=True) if not median]
        found = (out.groupBy(*keys) if keys else out).agg(*(plain or [F.count(F.lit(1)).alias("_rows")]))
        for (alias, _, column), median in zip(metrics, medians, strict=True):
            if median:
                found = _with_median(found, out.select(*keys, F.col(column).alias("_median_of")), [a for a, _, _ in dims], alias)
        out = found.select(*aliases)
    elif dims:
        out = out.select(*[c.alias(a) for a, c, _ in dims])
    else:
        warnings.append("neither dimensions nor metrics: rows are returned as they are")
    for f in after:
        out = out.filter(condition(F.col(clean_alias(f.column)), T.DoubleType(), f.op, f.value))
    order = _order(spec, out.columns, dims, metrics, warnings)
    rows = row_limit(spec.limit)
    out = out.orderBy(*order) if order else out
    return Answer(out if rows is None else out.limit(rows), warnings)


def _with_median(found: DataFrame, values: DataFrame, keys: list[str], alias: str) -> DataFrame:
    """`found` with the exact median of each group's values. It is worked out by jobs of its own, before the caller asks."""
    if not keys:
        return found.withColumn(alias, F.lit(exact_quantiles(values, {"_median_of": [0.5]})["_median_of"][0]).cast("double"))
    per = grouped_quantiles(values, keys, "_median_of", 0.5, alias)
    per = per.select(*[F.col(k).alias(f"_of_{k}") for k in keys], alias)
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return found.join(per, same, "left").drop(*[f"_of_{k}" for k in keys])


def _order(spec: QuerySpec, outputs: list[str], dims: list, metrics: list, warnings: list[str]) -> list[Column]:
    lower = {o.lower(): o for o in outputs}
    base = {column.lower(): alias for alias, _, column in [*metrics, *dims]}
    order = []
    for s in spec.sort:
        name = s.column.lower()
        alias = s.column if s.column in outputs else lower.get(name) or lower.get(clean_alias(s.column)) or base.get(name)
        if alias is None:
            warnings.append(f"no output {s.column!r} to sort by")
            continue
        order.append(F.desc_nulls_last(alias) if s.descending else F.asc_nulls_last(alias))
    if not order and dims and metrics:
        grained = [clean_alias(d.alias or f"{d.column}_{d.grain}") for d in spec.dimensions if d.grain]
        order = [F.asc_nulls_last(grained[0])] if grained else [F.desc_nulls_last(metrics[0][0])]
    return order


def roll_up(result: DataFrame, keep: Sequence[str], metrics: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """A result summed up over fewer dimensions. metrics names each one's aggregate; averages of averages get a caveat."""
    how = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "median": F.avg}
    caveats = [f"{m} is an unweighted average of groups" for m, a in metrics.items() if a in ("avg", "median")]
    aggs = [how[a](m).alias(m) for m, a in metrics.items()]
    return (result.groupBy(*keep) if keep else result).agg(*aggs), caveats


def roll_up_exactly(frame: DataFrame, fine: Sequence[str], keep: Sequence[str], column: str) -> DataFrame:
    """An average over fewer dimensions from sums and counts of the finer ones."""
    parts = frame.groupBy(*fine).agg(F.sum(column).alias("s"), F.count(column).alias("n"))
    return parts.groupBy(*keep).agg((F.sum("s") / F.sum("n")).alias(f"avg_{column}"))
