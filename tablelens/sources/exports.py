"""Folders of CSV exports whose header isn't the first row, read by splits: no task needs a whole file.

A quoted cell may hold line breaks, and a split may begin inside one. So a first pass tells for each split in which state it
ends from either state that it may begin in, and chooses each file's header from the records at its start. The states are
then followed along each file's splits, and a second pass cuts splits into records. What lies on both sides of a border is
put together afterwards.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tablelens.functions.names import normal_columns
from tablelens.sources.scratch import written

HEADER_ROWS = 10
#: Splits whose states are broadcast; beyond that they are joined.
FEW_SPLITS = 200_000

SPLITS = "file string, block long, lines long, closed_ends boolean, open_ends boolean, head array<string>"
RECORDS = "file string, line long, part string, text string, names array<string>"
CELLS = "file string, row_no long, cells map<string,string>"


def header_row(rows: list[list[str]]) -> int:
    """Of the first rows, the one that is most text and most filled."""
    width = max((len(r) for r in rows), default=0)
    best, place = -1.0, 0
    for k, row in enumerate(rows[:HEADER_ROWS]):
        filled = [c.strip() for c in row if c.strip()]
        if len(filled) < 2:
            continue
        texts = sum(not c.replace(".", "", 1).replace("-", "", 1).isdigit() for c in filled)
        if (score := texts / len(filled) * len(filled) / width) > best:
            best, place = score, k
    return place


def ends_open(line: str, inside: bool) -> bool:
    """Whether a line that begins inside a quoted cell, or not, ends inside one. Quotes open a cell only at its start."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line[at + 1 : at + 2] == '"':
                at += 2
                continue
            inside = False
        elif line[at : at + 1] == '"':
            inside = True
            at += 1
            continue
        at = line.find(",", at) + 1
        if at == 0:
            return False


def parsed(records: Iterable[str]) -> list[list[str]]:
    csv.field_size_limit(2**31 - 1)  # a cell may be long
    return [next(csv.reader([r]), []) for r in records]


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The lines of a task by split, in order."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    return groupby(rows, key=lambda r: r[:2])


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = []
    for (file, block), rows in _by_split(batches):
        closed, open_, lines, head, record = False, True, 0, [], []
        for _, _, line in rows:
            if block == 0 and len(head) < HEADER_ROWS:
                record.append(line)
            if '"' in line:
                closed, open_ = ends_open(line, closed), ends_open(line, open_)
            lines += 1
            if record and not closed:
                head.append("\n".join(record))
                record = []
        found.append((file, block, lines, closed, open_, head))
    columns = list(zip(*found, strict=True)) if found else [[]] * 6
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()))
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in SPLITS.split(", ")])


def _followed(splits: pd.DataFrame, header: int | None) -> pd.DataFrame:
    """The splits of a file with the state that each begins in, its first line's number, and the file's header."""
    splits = splits.sort_values("block")
    inside, before, begins, firsts = False, 0, [], []
    for closed, open_, lines in zip(splits["closed_ends"], splits["open_ends"], splits["lines"], strict=True):
        begins.append(inside)
        firsts.append(before)
        inside, before = bool(open_ if inside else closed), before + int(lines)
    head = list(splits["head"].iloc[0])
    rows = parsed(h.removeprefix("\ufeff") if k == 0 else h for k, h in enumerate(head))
    at = header_row(rows) if header is None else header
    names = normal_columns(rows[at]) if at < len(rows) else []
    skipped = sum(h.count("\n") + 1 for h in head[: at + 1])
    return pd.DataFrame({"file": splits["file"], "block": splits["block"], "begins": begins, "first": firsts, "skipped": skipped, "names": [names] * len(splits)})


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of splits; part is 'whole', or 'start', 'middle' or 'end' of a record that lies in several splits."""
    for batch in _cut(batches):
        columns = list(zip(*batch, strict=True)) if batch else [[]] * 5
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RECORDS.split(", ")])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    out: list[tuple] = []
    for (file, _), rows in _by_split(batches):
        record: list[str] = []
        inside = None
        for _, _, line, begins, first, skipped, names in rows:
            if inside is None:
                inside, number, began, start = begins, first, first, "end" if begins else "whole"
            if not record:
                began = number
            record.append(line)
            inside = ends_open(line, inside) if inside or '"' in line else False
            number += 1
            if not inside:
                if began >= skipped:
                    out.append((file, began, start, "\n".join(record), names))
                record, start = [], "whole"
                if len(out) >= 10_000:
                    yield out
                    out = []
        if record and began >= skipped:
            out.append((file, began, {"whole": "start", "end": "middle"}[start], "\n".join(record), names))
    yield out


def _celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for file, line, text, names in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cells = [(n, c) for n, c in zip(names, parsed([text])[0], strict=False) if c.strip()]
            if cells:
                rows.append((file, line, cells))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.map_(pa.string(), pa.string()))], ["file", "row_no", "cells"])


def read_untidy(spark: SparkSession, uri: str, header: int | None = None, glob: str = "*.csv") -> DataFrame:
    """(file, row_no, cells): the records below each file's header, each cell by its tidy column name.

    The header is found among a file's first records, unless `header` says which one it is. row_no is the number of a
    record's first line in its file. Records and cells without any value are left out. Line breaks within quotes are kept
    as \\n; a record may lie in several splits.
    """
    text = spark.read.option("pathGlobFilter", glob).text(uri)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    splits = written(lines.mapInArrow(_states, SPLITS), "splits")
    schema = "file string, block long, begins boolean, first long, skipped long, names array<string>"

    def of_file(rows: pd.DataFrame) -> pd.DataFrame:
        return _followed(rows, header)

    followed = written(splits.groupBy("file").applyInPandas(of_file, schema), "followed")  # a row per split
    followed = followed.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "begins", "first", "skipped", "names")
    if followed.count() > FEW_SPLITS:
        # lines lose their order in a shuffle: they are numbered within their split first, and sorted again
        lines = lines.withColumn("_at", F.monotonically_increasing_id())
        joined = lines.join(followed, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block"))).repartition("file", "block").sortWithinPartitions("file", "block", "_at")
    else:
        joined = lines.join(F.broadcast(followed), (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))
    records = written(joined.select("file", "block", "value", "begins", "first", "skipped", "names").mapInArrow(_records, RECORDS), "records")
    whole = records.filter("part = 'whole'").select("file", "line", "text", "names")
    parts = records.filter("part <> 'whole'")
    run = F.sum((F.col("part") == "start").cast("int")).over(Window.partitionBy("file").orderBy("line"))  # two rows per border of splits
    joined = parts.withColumn("run", run).filter("run > 0").groupBy("file", "run").agg(F.min("line").alias("line"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"]), "\n").alias("text"), F.first("names").alias("names"))
    return whole.unionByName(joined.select("file", "line", "text", "names")).mapInArrow(_celled, CELLS)
