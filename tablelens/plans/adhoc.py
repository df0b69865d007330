"""Read-only SQL over known tables."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tablelens.operators.query import MAX_ROWS

#: Leaves that read nothing: a SELECT without a table, and the name of a table expression that the query defines itself.
HARMLESS = ("OneRowRelation", "CTERelationRef")
#: Functions that call anything at all.
_CALLS = re.compile(r"(?i)\b(?:try_)?(?:reflect|java_method)\b\W*\(")


class NotAllowed(ValueError):
    pass


def _each(found: Any) -> Iterator[Any]:
    return (found.apply(k) for k in range(found.size()))


def _leaves(frame: DataFrame) -> list[Any]:
    """What the analysed plan reads, in subqueries too. Columns are numbered anew, so that equal relations compare equal."""
    plan = frame._jdf.queryExecution().analyzed()
    return [leaf.canonicalized() for part in (plan, *_each(plan.subqueriesAll())) for leaf in _each(part.collectLeaves())]


def adhoc(spark: SparkSession, text: str, frames: dict[str, DataFrame], cap: int | None = MAX_ROWS) -> DataFrame:
    """The rows of one query over `frames`, `cap` at most (None for all).

    The text is analysed as a subquery, so that commands aren't valid there. Every leaf of the analysed plan must be a
    leaf of one of `frames`: other tables, views of any kind, files, table functions and inline rows are refused before
    anything runs, and so are functions that call code by name. No files are listed for it.
    """
    if _CALLS.search(text):
        raise NotAllowed("the query calls code by name")
    hidden = {v.name: spark.table(v.name) for v in spark.catalog.listTables() if v.isTemporary and v.name in {n.lower() for n in frames}}
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
    direct = spark.conf.get("spark.sql.runSQLOnFiles")
    spark.conf.set("spark.sql.runSQLOnFiles", "false")
    try:
        found = spark.sql(f"SELECT * FROM (\n{text.rstrip().rstrip(';')}\n) AS asked")
    finally:
        spark.conf.set("spark.sql.runSQLOnFiles", direct)
        for name in frames:  # the analysed query keeps what it read
            spark.catalog.dropTempView(name)
        for name, frame in hidden.items():
            frame.createOrReplaceTempView(name)
    known = [leaf for frame in frames.values() for leaf in _leaves(frame)]
    for leaf in _leaves(found):
        if leaf.nodeName() not in HARMLESS and not any(leaf.equals(k) for k in known):
            raise NotAllowed(f"the query reads {leaf.nodeName()}, which isn't one of the given tables")
    return found if cap is None else found.limit(cap)
