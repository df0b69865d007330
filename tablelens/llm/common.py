"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.sources.scratch import RUN, release, scratch_dir  # noqa: F401

T = TypeVar("T")

#: Java pattern of a word: a run of anything but ASCII white space. Python's bytes.split() cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: A table is broadcast only if it was counted and has at most so many rows (narrow rows, so some tens of MB).
BROADCAST_ROWS = 200_000


_held: dict = {}


def held(owner: str, key: object, build: Callable[[], T]) -> T:
    """What `build` makes, kept in this Python process until another owner or key asks: workers serve many stages, and
    only one operator's tables stay in their memory."""
    if _held.get("for") != (owner, key):
        _held.clear()
        _held["made"] = build()
        _held["for"] = (owner, key)
    return _held["made"]


def materialise(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    A result that is returned may read such tables when it is used, so they stay until `discard`, or `release` for all
    that this process has written.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/tablelens/{RUN}/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path, **options)
    out = spark.read.schema(df.schema).parquet(path)
    out._tablelens_path = path
    return out


def packed(df: DataFrame, label: str) -> DataFrame:
    """`materialise` for texts: compressed harder."""
    return materialise(df, label, compression="zstd")


DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of each query once it has ended, not when the driver collects garbage next.

    For queries that write their result: what they dealt out is then of no more use. The session's setting comes back.
    """
    before = spark.conf.get(DROPS_SHUFFLES, None)
    spark.conf.set(DROPS_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROPS_SHUFFLES)
        else:
            spark.conf.set(DROPS_SHUFFLES, before)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


def discard(df: DataFrame) -> None:
    """Delete a table that `materialise` wrote and that nothing reads any more."""
    path = getattr(df, "_tablelens_path", None)
    if path:
        _delete(df.sparkSession, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table is small enough to broadcast. For a written table the count comes from the files' footers."""
    return df.count() <= rows


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if its counted size allows; beyond it, the join shuffles."""
    return F.broadcast(df) if small(df, rows) else df


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
