"""Tables that a computation writes on its way, in the folder that driver and executors share."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

RUN = uuid.uuid4().hex


def scratch_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a local session, whose driver and executors are one process, may do without."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return "/tmp/checkpoints"
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tablelens/{RUN}/{uuid.uuid4().hex}/{name}"


def written(frame: DataFrame, name: str) -> DataFrame:
    """`frame` as a table that has been written: it is worked out once, and a lost executor repeats a stage, not a lineage."""
    path = shared_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


#: Rows of a part of a table that many small jobs read again and again, and jobs that run side by side.
PART_ROWS, AT_ONCE = 100_000, 4


def evenly(frame: DataFrame, rows: int) -> DataFrame:
    """`frame`, of `rows` rows, in parts of PART_ROWS: compact files else give few tasks that hold very many rows each."""
    return frame.repartition(max(1, -(-rows // PART_ROWS)))


def side_by_side(spark: SparkSession, run: Callable, jobs: Sequence) -> list:
    """What `run` gives for each job, in order; AT_ONCE run at a time, as most of a small job is waiting."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return list(pool.map(inheritable_thread_target(spark)(run), jobs))


def release(spark: SparkSession) -> None:
    """Delete what this process has written: to be called when results have been read."""
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_dir(spark)}/tablelens/{RUN}")
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
