"""Substring dedup by words: every passage of MIN_WORDS words that stands in an earlier document is removed, with its
place in the original text.

Units are hashed and their digests grouped over all documents; the earliest document keeps its own. The first units are
whole texts. What isn't a copy of an earlier text is then taken by passages of MIN_WORDS words, from any word on, as a
repeated passage needn't begin or end with a line or sentence. Candidates come from winnowing: of the hashes of each K
words in a row, the least of every W in a row is a text's fingerprint. With K + W - 1 = MIN_WORDS two equal passages of
MIN_WORDS words have the same fingerprint, wherever they stand. Only where a fingerprint repeats are the passages named
by 96 bits and held against each other; so what is found doesn't depend on the choice of fingerprints.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh3_64_intdigest

from tablelens.llm.common import discard, held, materialise, maybe_broadcast

#: Only repeated passages of at least so many words are removed; 1 takes every repeated word.
MIN_WORDS = 50
#: Rows of an Arrow batch that a task gives out.
ROWS_OUT = 50_000
#: Words whose hashes a process keeps; longer ones than MAX_KEPT are hashed each time.
CACHE_ENTRIES, MAX_KEPT = 500_000, 64
_WORD = re.compile(r"\w+")
_TAIL = re.compile(r"[^\w\s]*(?=\s|$)")  # punctuation that ends a passage's last word

FINGERPRINTS = "key long, fp long"
PASSAGES = "doc_id long, key long, pos int, d1 long, d2 int"
RUNS = "key long, first int, last int, keep long, scope string"
SPANS = "doc_id long, start int, end int, n_words long, keep_doc_id long, scope string"
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _WordHashes(dict):
    """Hashes of lower-cased words, by the word as it is written."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: str) -> int:
        found = xxh3_64_intdigest(word.lower(), self.seed)
        if len(word) <= MAX_KEPT:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = found
        return found


class Hasher:
    """Hashes of each k words in a row: polynomials of the words' hashes modulo 2^64, as differences of running sums."""

    def __init__(self):
        self.words = [_WordHashes(0), _WordHashes(1)]
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            factors = np.full(2 * n, _BASE, np.uint64), np.full(2 * n, _INVERSE, np.uint64)
            for f in factors:
                f[0] = 1
            self.powers, self.inverses = (np.multiply.accumulate(f) for f in factors)

    def sums(self, words: list[str], kind: int = 0) -> np.ndarray:
        self._grow(len(words))
        out = np.zeros(len(words) + 1, np.uint64)
        hashes = np.fromiter(map(self.words[kind].__getitem__, words), np.uint64, len(words))
        np.cumsum(hashes * self.inverses[: len(words)], out=out[1:])
        return out

    def grams(self, sums: np.ndarray, k: int) -> np.ndarray:
        x = (sums[k:] - sums[:-k]) * self.powers[: len(sums) - k]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def _gram_words(min_words: int) -> tuple[int, int]:
    k = min_words // 2 + 1 if min_words > 1 else 1
    return k, min_words - k + 1


def _given_out(parts: list[list[np.ndarray]], fields: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in fields.split(", "))])
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _fingerprints(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """The distinct fingerprints of each text."""
    hasher, (k, width) = held("substring", 0, Hasher), _gram_words(min_words)
    for batch in batches:
        parts, rows = [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = _WORD.findall(text)
            if len(words) < min_words:
                continue
            found = np.unique(_least(hasher.grams(hasher.sums(words), k), width))
            parts.append([np.full(len(found), key, np.int64), found.view(np.int64)])
            rows += len(found)
            if rows >= ROWS_OUT:
                yield _given_out(parts, FINGERPRINTS)
                parts, rows = [], 0
        yield _given_out(parts, FINGERPRINTS)


def _passages(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """A row per word at which a passage of min_words words starts whose fingerprint repeats."""
    hasher, (k, width) = held("substring", 0, Hasher), _gram_words(min_words)
    for batch in batches:
        parts, rows = [], 0
        for doc_id, key, text, repeated in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = _WORD.findall(text)
            sums = hasher.sums(words)
            at = np.flatnonzero(np.isin(_least(hasher.grams(sums, k), width), np.array(repeated, np.int64).view(np.uint64)))
            d1, d2 = (hasher.grams(x, min_words)[at] for x in (sums, hasher.sums(words, 1)))
            parts.append([np.full(len(at), doc_id or 0, np.int64), np.full(len(at), doc_id is None), np.full(len(at), key, np.int64), at.astype(np.int32), d1.view(np.int64), d2.astype(np.uint32).view(np.int32)])
            rows += len(at)
            if rows >= ROWS_OUT:
                yield _passage_rows(parts)
                parts, rows = [], 0
        yield _passage_rows(parts)


def _passage_rows(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    none = np.concatenate([p.pop(1) for p in parts]) if parts else np.zeros(0, bool)
    out = _given_out(parts, PASSAGES)
    return out.set_column(0, "doc_id", pa.array(out.column(0).to_numpy(), pa.int64(), mask=none))


def _places(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Runs of words as places of characters. A run whose first word is -1 is the whole text."""
    names = [f.split()[0] for f in SPANS.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        rows = []
        for doc_id, text, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = [m.span() for m in _WORD.finditer(text)]
            for run in sorted(runs, key=lambda r: r["first"]):
                first, last = (run["first"], run["last"]) if run["first"] >= 0 else (0, len(words) - 1)
                if last - first + 1 >= min_words:
                    tail = _TAIL.match(text, words[last][1])
                    rows.append((doc_id, words[first][0], tail.end() if tail else words[last][1], last - first + 1, run["keep"], run["scope"]))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)


def _elsewhere(least: str, most: str, none: str) -> Column:
    """Whether the rows of a group belong to more than one document; those without an id are no document of their own."""
    return F.col(least).isNotNull() & ((F.col(least) < F.col(most)) | F.col(none))


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """One row per removed span: doc_id, start, end (characters of the original text), n_words, keep_doc_id, scope.

    Of equal texts, and of equal passages of min_words words, the ones of the smallest doc_id stay and the others are
    removed. scope is 'document' for a copy of a whole text, which is one span, and 'passage' for what other texts hold:
    all words of such passages that touch or overlap, from the first word to the end of the last one with the
    punctuation after it; it may begin and end inside sentences. keep_doc_id is where its first passage stays. With
    `within`, passages that a text repeats itself are removed too where they don't overlap the first ('within'). Case,
    punctuation and spacing don't count in passages. Null and empty texts have none. Rows that share an id are one
    document and don't repeat each other; rows without an id keep what they hold against each other.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body")).filter("body IS NOT NULL")
    rows = rows.select("doc_id", "body", F.xxhash64("doc_id", "body").alias("key"), F.xxhash64("body").alias("t1"), F.xxhash64(F.lit(1), "body").alias("t2"))
    whole = rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("none"))
    whole = materialise(whole.filter(_elsewhere("keep", "most", "none")).select(F.col("t1").alias("w1"), F.col("t2").alias("w2"), "keep"), "whole")
    marked = rows.join(maybe_broadcast(whole), (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2")), "left")
    copy = F.col("keep").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("keep"))
    own = marked.filter(~copy).select("doc_id", "key", "body")
    runs = materialise(_passage_runs(own, min_words, within), "runs")
    by_key = runs.groupBy(F.col("key").alias("k")).agg(F.collect_list(F.struct("first", "last", "keep", "scope")).alias("runs"))  # of one text each
    by_key = materialise(by_key, "by_key")
    run = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), "keep", F.lit("document").alias("scope"))
    copies = marked.filter(copy).select("doc_id", "body", F.array(run).alias("runs"))
    found = _with_key(own, by_key).select("doc_id", "body", "runs")
    discard(runs)
    return copies.unionByName(found).mapInArrow(partial(_places, min_words=min_words), SPANS)


def _with_key(texts: DataFrame, found: DataFrame) -> DataFrame:
    """`texts` joined with `found` on key = k. Texts that aren't in `found` go before any text is dealt out, if its keys
    are few enough; what `found` says of a text is an array and is never broadcast."""
    keys = maybe_broadcast(found.select(F.col("k").alias("__k")))
    return texts.join(keys, F.col("key") == F.col("__k"), "left_semi").join(found.hint("merge"), F.col("key") == F.col("k"))


def _passage_runs(own: DataFrame, min_words: int, within: bool) -> DataFrame:
    """(key, first, last, keep, scope): runs of words of a text that repeated passages cover."""
    prints = materialise(own.select("key", "body").mapInArrow(partial(_fingerprints, min_words=min_words), FINGERPRINTS), "fingerprints")
    shared = prints.groupBy("fp").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select(F.col("fp").bitwiseXOR(F.lit(0)).alias("f"))
    wanted = prints.join(shared.hint("shuffle_hash"), F.col("fp") == F.col("f")).groupBy(F.col("key").alias("k")).agg(F.collect_set("fp").alias("repeated"))
    wanted = materialise(wanted, "wanted")  # of one document each
    discard(prints)
    asked = _with_key(own, wanted).select("doc_id", "key", "body", "repeated")
    found = materialise(asked.mapInArrow(partial(_passages, min_words=min_words), PASSAGES), "passages")
    digests = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("keep"), F.max("doc_id").alias("most"), F.max(F.col("doc_id").isNull()).alias("none"))
    digests = digests.filter(_elsewhere("keep", "most", "none")).select(F.col("d1").bitwiseXOR(F.lit(0)).alias("k1"), F.col("d2").alias("k2"), "keep")
    gone = found.join(digests, (F.col("d1") == F.col("k1")) & (F.col("d2") == F.col("k2"))).filter(~F.col("doc_id").eqNullSafe(F.col("keep")))
    gone = materialise(gone.select("key", "pos", "keep"), "gone")
    discard(found)
    order = Window.partitionBy("key").orderBy("pos")  # one text's words
    begins = F.coalesce(F.col("pos") - F.lag("pos").over(order) > min_words, F.lit(False)).cast("int")
    runs = gone.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy("key", "run").agg(F.min("pos").alias("first"), (F.max("pos") + min_words - 1).alias("last"), F.min(F.struct("pos", "keep"))["keep"].alias("keep"))
    runs = runs.select("key", "first", "last", "keep", F.lit("passage").alias("scope"))
    if within:
        runs = runs.unionByName(own.select("doc_id", "key", "body").mapInArrow(partial(_within, min_words=min_words), RUNS))
    return runs


def _within(batches: Iterator[pa.RecordBatch], min_words: int) -> Iterator[pa.RecordBatch]:
    """Runs of words of passages that the same text holds before, where they don't overlap the first."""
    hasher = held("substring", 0, Hasher)
    for batch in batches:
        rows = []
        for doc_id, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = _WORD.findall(text)
            if len(words) < 2 * min_words:
                continue
            d1, d2 = (hasher.grams(hasher.sums(words, kind), min_words) for kind in (0, 1))
            _, first, number = np.unique(d1 ^ (d2 << np.uint64(1)), return_index=True, return_inverse=True)
            at = np.flatnonzero(np.arange(len(d1)) - first[number] >= min_words)
            if len(at):
                ends = np.flatnonzero(np.diff(at) > min_words)
                rows += [(key, int(a), int(b) + min_words - 1, doc_id, "within") for a, b in zip(at[np.concatenate(([0], ends + 1))], at[np.concatenate((ends, [len(at) - 1]))], strict=True)]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in RUNS.split(", ")])


def _cut(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], s["end"])):
        out.append(text[at : max(at, span["start"])])
        at = max(at, span["end"])
    return "".join([*out, text[at:]])


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", within: bool = False) -> DataFrame:
    """`docs` with the spans of `repeated_spans` cut out of the texts; columns and row count unchanged. Rows without an id stay."""
    spans = repeated_spans(docs, min_words, id_col, text_col, within).filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__tl_id"))
    spans = materialise(spans.agg(F.collect_list(F.struct("start", "end")).alias("__tl_spans")), "spans")  # of one document each

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, s) for t, s in zip(texts, found, strict=True)], dtype=object)

    joined = docs.join(maybe_broadcast(spans, 20_000), F.col(id_col).cast("long") == F.col("__tl_id"), "left")
    return joined.withColumn(text_col, F.when(F.col("__tl_spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("__tl_spans")))).select(*docs.columns)
