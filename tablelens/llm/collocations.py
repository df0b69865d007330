"""Phrase collocations: phrases of two to five words that stand together far more often than their parts would by chance.

Words are counted first, then pairs of words; both counts abandon what can't be frequent. What is left of the texts are
suffix pointers: up to five words from each word on, cut at the first word or pair that is too rare. Equal suffixes of a
task are one row with a count. Rows are routed over the cluster by their two leading words, so that all suffixes of a
leading pair meet, and each task sorts its pointers by multikey three-way quicksort: a partition of equal words at depth
d is a phrase of d words, its size is the phrase's count, and partitions of too small a size are left unsorted. Pairs that
lead very many suffixes are routed by one word more, and so on; counts up to that depth are plain partial sums.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from xxhash import xxh64_intdigest

from tablelens.llm.common import discard, held, materialise, maybe_broadcast

DEPTH, MIN_COUNT, TOP = 5, 100, 2000
#: Words or pairs whose list is broadcast to cut suffixes short; with more of them suffixes are only longer than need be.
MAX_LISTED = 4_000_000
#: A prefix that leads more suffixes than this is routed by one word more.
HOT = 1_000_000
#: Words of a task that are held at once, and rows of a task that sorts.
CHUNK, TASK_ROWS = 2_000_000, 1_000_000
#: Distinct words that a process keeps with their hashes.
KEPT_WORDS = 1_000_000
#: Ranks are taken within so many parts of a language first.
RANK_PARTS = 32

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
WORDS = [f"w{k}" for k in range(1, DEPTH + 1)]
WORD_ROWS = "lang string, h long, word binary, n long"
PAIR_ROWS = "lang string, w1 long, w2 long, n long"
SUFFIX_ROWS = "lang string, " + ", ".join(f"{w} long" for w in WORDS) + ", n long"
PHRASE_ROWS = "lang string, phrase array<long>, a long"


class _Ids(dict):
    """A word's hash as a signed number that is never 0; 0 for words that aren't listed."""

    def __init__(self, seed: int, listed: set | None):
        super().__init__({b"": -1, b"\n": 0})
        self.seed, self.listed = seed, listed

    def __missing__(self, word: bytes) -> int:
        h = xxh64_intdigest(word, self.seed)
        h = max(2, h >> 1)  # 63 bits, so that -1, 0 and 1 are free
        out = h if self.listed is None or h in self.listed else 0
        if len(self) > KEPT_WORDS:
            self.clear()
            self.update({b"": -1, b"\n": 0})
        self[word] = out
        return out


def _tokens(text: bytes) -> list[bytes]:
    """Lower-cased words, with b"\\n" between pieces and b"" where nothing is."""
    return text.translate(_LOWER).replace(b"\n", b" \n ").split(b" ")


def _count_words(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
    found: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(lang, max(2, xxh64_intdigest(w, seed) >> 1), w, n) for lang, c in found.items() for w, n in c.items() if w not in (b"", b"\n")]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int64())], ["lang", "h", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(_tokens(text))
            if sum(map(len, found.values())) > KEPT_WORDS:
                yield out()
    yield out()


def _chunks(batches: Iterator[pa.RecordBatch], run: str, seed: int, listed: dict | None) -> Iterator[tuple[str, np.ndarray]]:
    """(lang, ids) of CHUNK words or so; 0 between pieces and in the place of words that aren't listed. `run` tells what
    the process keeps of this run's words from that of others."""
    parts: dict[str, list[np.ndarray]] = {}
    sizes: Counter = Counter()
    ids = held("collocations", run, dict)
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if lang not in ids:
                ids[lang] = _Ids(seed, None if listed is None else listed.get(lang, set()))
            tokens = _tokens(text)
            x = np.fromiter(map(ids[lang].__getitem__, tokens), np.int64, len(tokens))
            parts.setdefault(lang, []).append(np.append(x[x >= 0], 0))
            sizes[lang] += len(parts[lang][-1])
            if sizes[lang] >= CHUNK:
                yield lang, np.concatenate(parts.pop(lang))
                sizes.pop(lang)
    for lang, found in parts.items():
        yield lang, np.concatenate(found)


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    x = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        x = (x ^ c.view(np.uint64)) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _summed(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows and how often each is there. Rows are brought together by a hash, which need not tell all apart:
    then a row is given out more than once, with parts of its count."""
    order = np.argsort(_mixed(columns))
    columns = [c[order] for c in columns]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def _rows(lang: str, columns: list[np.ndarray], n: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), *[pa.array(c, pa.int64()) for c in columns], pa.array(n, pa.int64())], ["lang", *names, "n"])


def _pairs(batches: Iterator[pa.RecordBatch], run: str, seed: int, listed) -> Iterator[pa.RecordBatch]:
    for lang, x in _chunks(batches, run, seed, listed and listed.value):
        at = np.flatnonzero((x[:-1] > 0) & (x[1:] > 0))
        columns, n = _summed([x[at], x[at + 1]])
        yield _rows(lang, columns, n, WORDS[:2])


def _suffixes(batches: Iterator[pa.RecordBatch], run: str, seed: int, listed, pairs, depth: int) -> Iterator[pa.RecordBatch]:
    """Suffixes of three words at least; pairs are counted already."""
    for lang, x in _chunks(batches, run, seed, listed and listed.value):
        x = np.concatenate((x, np.zeros(depth, np.int64)))
        good = (x[:-1] > 0) & (x[1:] > 0)
        if pairs is not None:
            known = pairs.value.get(lang, np.zeros(0, np.uint64))
            at = np.flatnonzero(good)
            good[at] = np.isin(_mixed([x[at], x[at + 1]]), known)
        at = np.flatnonzero(good[:-1] & good[1:])
        columns, still = [x[at], x[at + 1], x[at + 2]], np.ones(len(at), bool)
        for k in range(3, DEPTH):
            if k < depth:
                still = still & good[at + k - 1]
                columns.append(np.where(still, x[at + k], 0))
            else:
                columns.append(np.zeros(len(at), np.int64))
        columns, n = _summed(columns)
        yield _rows(lang, columns, n, WORDS)


def sorted_phrases(words: np.ndarray, n: np.ndarray, known: np.ndarray, min_count: int) -> Iterator[tuple[int, int, int]]:
    """(row, depth, count): phrases of at least min_count, each by a row that begins with it. Multikey three-way quicksort.

    words: a row per suffix, 0 after its end, with its language in column 0; n: how often it is there; known: the depth
    up to which its prefixes are counted elsewhere. Pointers are parted around a word of the column that matches the
    depth; the equal ones go on with the next column. A partition of too few suffixes holds no phrase and is left.
    """
    pointers, width = np.arange(len(n)), words.shape[1]
    todo = [(0, len(n), 0)]
    while todo:
        a, b, d = todo.pop()
        part = pointers[a:b]
        if int(n[part].sum()) < min_count:
            continue
        column = words[part, d]
        ends = (column[0], column[len(column) // 2], column[-1])
        pivot = sorted(ends)[1]
        less, more = column < pivot, column > pivot
        equal = part[~(less | more)]
        low = int(less.sum())
        high = low + len(equal)
        if high - low < b - a:
            pointers[a:b] = np.concatenate((part[less], equal, part[more]))
            todo += [(a, a + low, d), (a + high, b, d)]
        size = int(n[equal].sum())
        if size < min_count or (pivot == 0 and d > 0):
            continue
        if d > known[equal[0]]:
            yield int(equal[0]), d, size
        if d + 1 < width:
            todo.append((a + low, a + high, d + 1))


def _sort_task(batches: Iterator[pa.RecordBatch], min_count: int) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
    if table is None or not len(table):
        return
    lang = table["lang"].combine_chunks().dictionary_encode()
    words = np.stack([lang.indices.to_numpy(zero_copy_only=False).astype(np.int64), *[table[w].to_numpy() for w in WORDS]], axis=1)
    found = list(sorted_phrases(words, table["n"].to_numpy(), table["known"].to_numpy(), min_count))
    names = lang.dictionary.to_pylist()
    yield pa.RecordBatch.from_arrays(
        [pa.array([names[words[r, 0]] for r, _, _ in found], pa.string()), pa.array([words[r, 1 : d + 1].tolist() for r, d, _ in found], pa.list_(pa.int64())), pa.array([c for _, _, c in found], pa.int64())],
        ["lang", "phrase", "a"],
    )


def _broadcast(rows: DataFrame, cell, build):
    """What `build` makes of the rows of each language, as a broadcast variable; None if they are more than MAX_LISTED."""
    if rows.count() > MAX_LISTED:
        return None
    table = rows.toArrow()
    lang, values, out = table["lang"].to_pylist(), cell(table), {}
    for name in set(lang):
        out[name] = build(values[np.array([x == name for x in lang])])
    return rows.sparkSession.sparkContext.broadcast(out)


def _hot(rows: DataFrame, keys: list[str], bound: float) -> DataFrame:
    """Prefixes that lead more than `bound` suffixes: few beside all suffixes."""
    return rows.filter(F.col("n") > bound).select("lang", *[F.col(k).alias(f"_{k}") for k in keys])


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, depth: int = DEPTH, text_col: str = "text", lang_col: str = "lang", hot: float | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals) of the languages of `docs`, all over written tables.

    phrases (lang, phrase array<long>, a): phrases of 1 to `depth` words with a count of min_count at least; words (lang,
    h, word): the text of the frequent words' hashes; totals (lang, n): all words. A null language is 'und', a null text
    is empty. No two words have one hash: with a collision the hashes are taken again with another seed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    each = rows.mapInArrow(partial(_count_words, seed=seed), WORD_ROWS).groupBy("lang", "h").agg(F.min("word").alias("word"), F.max("word").alias("other"), F.sum("n").alias("n"))
    # all words of a language's rare rest are one row, so that its total is kept and little is written
    rare = (F.col("n") < min_count) & (F.col("word") == F.col("other"))
    counted = materialise(each.groupBy("lang", F.when(rare, F.lit(0)).otherwise(F.col("h")).alias("h")).agg(F.min("word").alias("word"), F.max(F.when(~rare, F.col("other"))).alias("other"), F.sum("n").alias("n")), "words")
    if not counted.filter("h <> 0 AND word <> other").isEmpty():
        return phrase_counts(docs, min_count, depth, text_col, lang_col, hot, seed + 1)
    totals = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    words = counted.filter("h <> 0").select("lang", "h", F.col("word").cast("string").alias("word"), "n")
    listed = _broadcast(words, lambda t: t["h"].to_numpy(), lambda h: set(h.tolist()))
    run = uuid.uuid4().hex
    pairs = rows.mapInArrow(partial(_pairs, run=run, seed=seed, listed=listed), PAIR_ROWS).groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n"))
    pairs = materialise(pairs.filter(F.col("n") >= min_count), "pairs")
    out = [words.select("lang", F.array("h").alias("phrase"), F.col("n").alias("a")), pairs.select("lang", F.array("w1", "w2").alias("phrase"), F.col("n").alias("a"))]
    if depth > 2:
        wanted = _broadcast(pairs, lambda t: _mixed([t["w1"].to_numpy(), t["w2"].to_numpy()]), np.sort)
        suffixes = materialise(rows.mapInArrow(partial(_suffixes, run=run, seed=seed, listed=listed, pairs=wanted, depth=depth), SUFFIX_ROWS), "suffixes")
        n, bound = suffixes.count(), hot or HOT
        left, known, prefixes = suffixes.withColumn("known", F.lit(2)), 2, _hot(pairs, WORDS[:2], bound)
        routed = []
        while known < depth and not prefixes.isEmpty():
            keys = WORDS[:known]
            hits = [F.col(k) == F.col(f"_{k}") for k in keys]
            marked = left.join(maybe_broadcast(prefixes.withColumn("_hot", F.lit(True)).withColumnRenamed("lang", "_lang")), reduce(Column.__and__, hits, F.col("lang") == F.col("_lang")), "left").select(*left.columns, "_hot")
            routed.append(marked.filter("_hot IS NULL").drop("_hot"))
            known += 1
            left = marked.filter("_hot").drop("_hot").filter(F.col(WORDS[known - 1]) != 0).withColumn("known", F.lit(known))
            counts = left.groupBy("lang", *WORDS[:known]).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
            counts = materialise(counts, "hot_prefixes")
            out.append(counts.select("lang", F.array(*WORDS[:known]).alias("phrase"), F.col("n").alias("a")))
            prefixes = _hot(counts, WORDS[:known], bound)
        routed.append(left)
        route = F.xxhash64("lang", *[F.when(F.col("known") > k, F.col(w)).otherwise(F.lit(0)) for k, w in enumerate(WORDS)])
        rest = reduce(DataFrame.unionByName, routed).filter(F.col("known") < depth)
        sorted_ = rest.repartition(max(1, n // TASK_ROWS + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))), route).mapInArrow(partial(_sort_task, min_count=min_count), PHRASE_ROWS)
        out.append(materialise(sorted_, "phrases"))
        discard(suffixes)
    return reduce(DataFrame.unionByName, out), words, totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, top: int = TOP, depth: int = DEPTH, text_col: str = "text", lang_col: str = "lang", hot: float | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases.

    Phrases lie within pieces between the marks [.,;:!?] and line breaks; A-Z count as a-z. n: words of the language; a:
    the phrase's count; l and r: those of its parts at the cut with the lowest score floor(1000 a n / (l r)), the earliest
    of equal ones. A phrase inside a longer one that is as frequent is left out. By score and count descending, then by
    phrase. Null texts are empty, a null language is 'und', repeated rows count again, an empty table gives no row.
    """
    phrases, words, totals = phrase_counts(docs, min_count, depth, text_col, lang_col, hot)
    phrases = materialise(phrases, "frequent")
    found = phrases.filter(F.size("phrase") >= 2)
    longer = found.filter(F.size("phrase") >= 3)
    k = F.size("phrase")
    # whatever is in between is as frequent too, so that phrases longer by one word are enough
    inside = longer.select("lang", F.explode(F.array(F.slice("phrase", 1, k - 1), F.slice("phrase", F.lit(2), k - 1))).alias("phrase"), "a")
    inside = inside.groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("a").alias("_a"))
    kept = found.join(inside, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").filter("_a IS NULL OR _a < a").select("lang", "phrase", "a")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.slice("phrase", F.lit(1), F.col("cut")), "right": F.slice("phrase", F.col("cut") + 1, k - F.col("cut"))})
    parts = lambda name, count: phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias(f"_{name}"), F.col("a").alias(count))
    for name, count in (("left", "l"), ("right", "r")):
        other = parts(name, count)
        cuts = cuts.join(other, (F.col("lang") == F.col("_lang")) & (F.col(name) == F.col(f"_{name}"))).drop("_lang", f"_{name}")
    cuts = cuts.join(maybe_broadcast(totals.select(F.col("lang").alias("_lang"), "n")), F.col("lang") == F.col("_lang")).drop("_lang")
    exact = lambda c: f"cast({c} AS decimal(20, 0))"
    score = F.expr(f"cast((1000BD * {exact('a')} * {exact('n')}) div ({exact('l')} * {exact('r')}) AS long)")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "n", "s.l", "s.r", "s.score")
    best = materialise(best.withColumn("key", F.col("phrase")), "scored")
    spelt = best.select("lang", "key", F.posexplode("phrase").alias("at", "h")).join(maybe_broadcast(words.select(F.col("lang").alias("_lang"), F.col("h").alias("_h"), "word")), (F.col("lang") == F.col("_lang")) & (F.col("h") == F.col("_h")))
    spelt = spelt.groupBy(F.col("lang").alias("_lang"), F.col("key").alias("_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda s: s["word"]), " ").alias("spelt"))  # up to five words
    rows = best.join(spelt, (F.col("lang") == F.col("_lang")) & (F.col("key") == F.col("_key"))).select("lang", F.col("spelt").alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).filter(F.col("rank") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
