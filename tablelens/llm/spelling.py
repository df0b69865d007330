"""Spelling variants: words that differ by one letter, each with its far more frequent form.

Pairs come from blocked Gram matrices. A block holds words of length L and of length L + 1 that agree outside the letters
a to b, so that the edit which tells two of them apart lies in between: a word's edit is either in its first half or in
its second, and two blocks of each length find every pair. The product of a block's letter counts with themselves gives
squared distances of counts; one replaced letter makes 2 and one inserted letter makes 1, so the rest is left out and
the edits of what stays are verified. A block of too many words is parted again in the middle of a to b, down to one
letter, where few words are possible.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import discard, materialise

MIN_LENGTH, MIN_COUNT, RATIO = 7, 2, 10
#: A block of more words is parted again.
BLOCK_WORDS = 512
#: Distinct words that a task holds before it gives them out.
HELD_WORDS = 1_000_000
#: One in DROP occurrences, by their checksum, loses a letter.
DROP = 31

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_RUN = re.compile("[a-zÀ-ÿ]+")
#: a to z, then the letters (and signs) from U+00C0 to U+00FF.
_LATIN, _LETTERS = 0xC0, 26 + 64
WORD_ROWS = "word string, n long"
NEAR_ROWS = "word string, n_near long, best_n long, best string"


def _words(batches: Iterator[pa.RecordBatch], drop: int, min_length: int) -> Iterator[pa.RecordBatch]:
    run = re.compile(f"[a-zÀ-ÿ]{{{max(1, min_length)},}}")  # shorter ones can't become longer
    found: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])
        found.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            for word, n in Counter(run.findall(text.translate(_LOWER).decode())).items():
                h = zlib.crc32(word.encode(), start)
                if drop and h % drop == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < min_length:
                        continue
                found[word] += n
            if len(found) > HELD_WORDS:
                yield out()
    yield out()


def word_counts(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int = DROP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of min_length letters and min_count occurrences. One in `drop` occurrences loses a letter (0: none)."""
    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    return rows.mapInArrow(partial(_words, drop=drop, min_length=min_length), WORD_ROWS).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds key: what the words of a block agree in."""
    tail = F.col("size") - F.col("b")
    suffix = F.when(tail > 0, F.expr("substring(word, -1 * (size - b), size - b)")).otherwise("")
    return rows.withColumn("key", F.xxhash64("size", "a", "b", F.expr("substring(word, 1, a)"), suffix))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row twice: with the edit in the first half of a to b, and in the second."""
    half = F.expr("a + (b - a) div 2").cast("int")
    parts = F.explode(F.array(F.struct(F.col("a").alias("a"), half.alias("b")), F.struct(half.alias("a"), F.col("b").alias("b"))))
    return _keyed(rows.select("word", "n", "size", parts.alias("p")).select("word", "n", "size", "p.a", "p.b"))


BLOCK = ["key", "size", "a", "b"]


def _blocks(words: DataFrame, most: int, min_length: int) -> Iterator[DataFrame]:
    """(key, size, a, b, words array<struct<word, n>>): blocks of two words at least and `most` at most, or of one letter."""
    length = F.length("word")
    sizes = F.when(length > min_length, F.array(length, length - 1)).otherwise(F.array(length))
    rows = words.select("word", "n", F.explode(sizes).alias("size")).select("word", "n", "size", F.lit(0).alias("a"), F.col("size").alias("b"))
    rows = materialise(_halves(rows), "keyed")
    while True:
        counts = rows.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
        counts = materialise(counts.select(*[F.col(c).alias(f"_{c}") for c in BLOCK], ((F.col("rows") > most) & (F.col("b") - F.col("a") > 1)).alias("large")), "blocks")
        same = reduce(Column.__and__, [F.col(c) == F.col(f"_{c}") for c in BLOCK])
        joined = rows.join(counts, same)
        yield joined.filter("NOT large").groupBy(*BLOCK).agg(F.collect_list(F.struct("word", "n")).alias("words"))
        large = counts.filter("large")
        if large.isEmpty():
            return
        rows = materialise(_halves(rows.join(large, same, "left_semi")), "parted")


def letter_counts(words: list[str]) -> np.ndarray:
    """A row of letter counts for each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes >= _LATIN, codes - _LATIN + 26, codes - ord("a"))
    return np.bincount(np.repeat(np.arange(len(words)), lengths) * _LETTERS + codes, minlength=len(words) * _LETTERS).reshape(len(words), _LETTERS).astype(np.float64)


def edit_place(short: str, long: str) -> int:
    """Where the one edit is that makes `short` into `long`, which is as long or longer by one; -1 if it takes another number."""
    at = next((k for k, (x, y) in enumerate(zip(short, long, strict=False)) if x != y), len(short))
    if len(short) == len(long):
        return at if at < len(short) and short[at + 1 :] == long[at + 1 :] else -1
    return at if short[at:] == long[at + 1 :] else -1


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a block tells of each of its words: how many near ones there are, and the best of them."""
    for batch in batches:
        found: dict[str, list] = {}
        sizes, lows, highs, lists = (batch.column(k) for k in (1, 2, 3, 4))
        offsets, cells = lists.offsets.to_pylist(), lists.values
        words, counts = cells.field("word").to_pylist(), cells.field("n").to_pylist()
        for k, (size, low, high) in enumerate(zip(sizes.to_pylist(), lows.to_pylist(), highs.to_pylist(), strict=True)):
            group = sorted(range(offsets[k], offsets[k + 1]), key=lambda i: len(words[i]))
            own = [words[i] for i in group]
            shorts = sum(len(w) == size for w in own)
            if not shorts:
                continue
            x = letter_counts(own)
            square = (x * x).sum(axis=1)
            distance = square[:shorts, None] + square[None, :] - 2 * (x[:shorts] @ x.T)
            for i, j in np.argwhere(distance <= 2).tolist():
                if j <= i:
                    continue
                at = edit_place(own[i], own[j])
                # the pair is in other blocks too; it counts in the one that holds its edit
                if at >= 0 and (low <= at < high or at == high == size):
                    for p, q in ((i, j), (j, i)):
                        cell = found.setdefault(own[p], [0, 0, ""])
                        cell[0] += 1
                        n = counts[group[q]]
                        if n > cell[1] or (n == cell[1] and own[q] < cell[2]):
                            cell[1:] = n, own[q]
        columns = list(zip(*((w, *c) for w, c in found.items()), strict=True)) if found else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, most: int = BLOCK_WORDS, min_length: int = MIN_LENGTH) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near one: one inserted, deleted or replaced letter apart."""
    parts = [materialise(b.mapInArrow(_near, NEAR_ROWS), "near") for b in _blocks(words, most, min_length)]
    every = reduce(DataFrame.unionByName, parts)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best")).alias("s")
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("s.m")).alias("best_n"), "s.best")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms followed to the last, by twice as many steps each time."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = now.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        after = materialise(now.join(next_, F.col("root") == F.col("_word"), "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        if after.filter("moved").isEmpty():
            return after.select("word", "root")
        discard(now)
        now = after.drop("moved")


def spelling_variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, ratio: int = RATIO, drop: int = DROP, most: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per word: word, form, root, n, n_near, form_n.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of min_length letters at least, that
    occur min_count times. form: the near word of largest n (ties: the first by code points) if it is `ratio` times as
    frequent, else null, with form_n; root: where forms lead in the end, the word itself without one. Null and empty
    texts have no words; a null id counts as an empty one in the checksum; repeated rows count again.
    """
    words = materialise(word_counts(docs, min_length, min_count, drop, id_col, text_col), "words")
    near = near_words(words, most, min_length).withColumnRenamed("word", "_word")
    linked = words.join(near, F.col("word") == F.col("_word"), "left")
    far = F.col("best_n") >= ratio * F.col("n")
    rows = materialise(linked.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(far, F.col("best")).alias("form"), F.when(far, F.col("best_n")).alias("form_n")), "forms")
    roots = _roots(rows.filter("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "_word")
    return rows.join(roots, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
