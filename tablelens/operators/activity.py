"""Keyed activity: the latest entry per key, the newest entries per user, the whole history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

NEWEST = 200


def stable_key(frame: DataFrame, *columns: str) -> Column:
    """sha256 of the columns' texts, trimmed and lower-cased, with a separator between them. A null is an empty part, so
    that no two rows share a key for it; the items of an array are sorted, nulls left out."""
    parts = [list_part(F.col(c)) if isinstance(frame.schema[c].dataType, T.ArrayType) else plain_part(F.col(c)) for c in columns]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def plain_part(c: Column) -> Column:
    return F.coalesce(F.lower(F.btrim(c.cast("string"), F.lit(" \t\n\r\x0b\x0c"))), F.lit(""))


def list_part(c: Column) -> Column:
    items = F.array_sort(F.transform(F.array_compact(c), plain_part))
    return F.coalesce(F.array_join(items, ","), F.lit(""))


def latest_per_key(events: DataFrame, keys: Sequence[str], time: str, tie: str) -> DataFrame:
    """Of the rows of a key, the one of the latest time, ties by `tie`. Partial maxima, so a hot key isn't sorted by one task."""
    rest = [c for c in events.columns if c not in keys]
    best = events.groupBy(*keys).agg(F.max(F.struct(time, tie, *[c for c in rest if c not in (time, tie)])).alias("s"))
    return best.select(*keys, "s.*").select(*events.columns)


def newest_per_user(events: DataFrame, user: str, time: str, tie: str, n: int = NEWEST) -> DataFrame:
    """At most n rows of each user, newest first; taken within parts of a user before they meet."""
    order = [F.desc(time), F.desc(tie)]
    part = F.pmod(F.xxhash64(tie), F.lit(32))
    near = events.withColumn("_r", F.row_number().over(Window.partitionBy(user, part).orderBy(*order))).filter(F.col("_r") <= n)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(user).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def history(events: DataFrame, time: str, tie: str) -> DataFrame:
    return events.orderBy(F.desc(time), F.desc(tie))
