"""Suffix-array dedup: every byte of a 50-byte string that an earlier document holds too is removed.

Copies of whole texts are settled by their digests. Of the other texts, each 50-byte window (`length`) belongs to a
trigger: of the GRAM-byte strings in the window, the one of least hash, the first of equal ones. Equal windows have equal
triggers at the same place, so only windows of one trigger need be compared. Triggers are dealt over the cluster by their
hash, with a digest of their context, which is all windows of the trigger. A context that an earlier document holds
settles all its windows at once; contexts that share no trigger hold nothing that repeats. What stays goes to the suffix
sort: pieces of text around triggers, routed by the bytes that all windows of a piece share. Each task sorts the suffixes of
its pieces by difference cover: sampled triples are named, the names are sorted by the same rule, the remaining suffixes
are merged, and neighbours in the order are compared by their first 50 bytes. Pieces of too common a core are parted.
"""

from __future__ import annotations

import gc
import hashlib
import time
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.common import materialise, maybe_broadcast

LENGTH, GRAM = 50, 16
#: Triggers that a task holds before it deals them out, and triggers of a task that compares them.
FLUSH, TASK_TRIGGERS = 1_500_000, 1_000_000
#: A trigger with so many contexts in one task goes to the suffix sort without being dealt out.
LOCAL_HOT = 64
#: Pieces of one core that are sorted together; beyond that their windows are parted.
HOT_PIECES = 4_096
#: Bytes of pieces whose suffixes are sorted at once (three names of such a text fit 63 bits), and bytes of a task.
SORT_BYTES, TASK_BYTES = 1_000_000, 16_000_000
#: Places of bytes that a window's key leaves room for; longer texts are taken in parts.
PLACES = 24
#: An id that isn't there: later than all others.
NONE = (1 << 63) - 1

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_M = np.uint64(0xD6E8FEB86659FD93)
DEALT = "bucket int, fp binary, context binary, doc binary, rid binary, place binary, hot binary"
ANSWERS = "bucket int, rid binary, place binary, covered binary"
KNOWN = "rid long, covered binary, asked binary"
PIECES = "key long, low int, high int, doc long, rid long, trigger int, first int, n int, bytes binary"
SPANS = "rid long, start int, end int"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Hashes of substrings: differences of running sums of bytes by powers modulo 2^64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, b: np.ndarray) -> np.ndarray:
        if len(b) >= len(self.up):
            self.up, self.down = (_powers(x, 2 * len(b) + 2) for x in (_BASE, _INVERSE))
        out = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.down[: len(b)], out=out[1:])
        return out

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[start]) * self.up[start]
        x = (x ^ (x >> np.uint64(32))) * _M
        return x ^ (x >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    done = 1
    while 2 * done <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def triggers(hasher: _Hasher, b: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(sums, trigger, first, last): the running sums of a text; for each trigger its place and the first and last start
    of the windows that belong to it. Every window belongs to one trigger, which lies inside it."""
    sums, width = hasher.sums(b), length - gram + 1
    n, parts = len(b) - length + 1, []
    room = (1 << PLACES) - length
    for begin in range(0, n, room):
        end = min(n, begin + room)
        at = np.arange(begin, end + width - 1)
        g = hasher.of(sums, at, at + gram)
        least = _least((g >> np.uint64(PLACES) << np.uint64(PLACES)) | np.arange(len(g), dtype=np.uint64), width)
        place = (least & np.uint64((1 << PLACES) - 1)).astype(np.int64) + begin
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        parts.append((place[first], first + begin, np.append(first[1:], end - begin) - 1 + begin))
    return (sums, *(np.concatenate(c) for c in zip(*parts, strict=True)))


def _packed(x: np.ndarray) -> bytes:
    """The bytes of equal weight together, so that high ones compress away."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unpacked(cells: list[bytes], kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(c, np.uint8).reshape(width, -1).T).view(kind).reshape(-1) for c in cells]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _first_of(keys: list[np.ndarray]) -> np.ndarray:
    """Where a row of sorted columns differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = reduce(np.logical_or, [k[1:] != k[:-1] for k in keys])
    return out


def _settled(fp: np.ndarray, context: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, group, covered) of triggers sorted by hash, context and document: the number of the trigger's hash, and
    whether an earlier document has the context."""
    order = np.lexsort((doc, context, fp))
    fp, context, doc = fp[order], context[order], doc[order]
    new = _first_of([fp, context])
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(doc) else doc
    return order, np.cumsum(_first_of([fp])) - 1, doc > least


def _answers(rid: np.ndarray, place: np.ndarray, covered: np.ndarray, asked: np.ndarray, buckets: int) -> list[tuple]:
    """What is known of triggers, packed into a row for each bucket of texts."""
    use = np.flatnonzero(covered | asked)
    bucket = _bucket(rid[use], buckets)
    by = np.lexsort((rid[use], bucket))
    use, bucket = use[by], bucket[by]
    at = np.flatnonzero(_first_of([bucket]))
    ends = [*at[1:].tolist(), len(use)]
    return [(int(bucket[a]), _packed(rid[use[a:b]]), _packed(place[use[a:b]]), _packed(covered[use[a:b]].astype(np.uint8))) for a, b in zip(at.tolist(), ends, strict=True)] if len(use) else []


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return ((x.view(np.uint64) * _M) >> np.uint64(33)).astype(np.int64) % buckets


def _table(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = [(n, kinds[k]) for n, k in (f.split() for f in fields.split(", "))]
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], [n for n, _ in schema])


_KINDS = (np.uint64, np.uint64, np.int64, np.int64, np.uint32, np.uint8)


def _deal(batches: Iterator[pa.RecordBatch], buckets: int, bits: int, length: int, gram: int, local_hot: int) -> Iterator[pa.RecordBatch]:
    """Triggers by bucket. What a task can settle by itself goes through buckets below 0: contexts that an earlier text of the
    task has, and triggers with very many contexts; of these one row is dealt out, so that others know of them."""
    hasher, parts, held = _Hasher(), [], 0
    mask = np.uint64(((1 << bits) - 1) << (64 - bits))

    def out() -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        parts.clear()
        order, group, covered = _settled(*columns[:3])
        columns = [c[order] for c in columns]
        contexts = np.bincount(group, weights=_first_of(columns[:2]), minlength=1)
        hot = contexts[group] >= local_hot
        lead = hot & _first_of([group])
        own = _answers(columns[3], columns[4], covered, hot & ~covered, buckets)
        rows = [(-1 - bucket, b"", b"", b"", rid, place, known) for bucket, rid, place, known in own]
        send = np.flatnonzero((~covered & ~hot) | lead)
        send = send[np.argsort(columns[3][send], kind="stable")]
        bucket = _bucket(columns[0][send], buckets)
        by = np.argsort(bucket, kind="stable")
        send, bucket = send[by], bucket[by]
        at = np.flatnonzero(_first_of([bucket]))
        flags = lead.astype(np.uint8)
        for a, b in zip(at.tolist(), [*at[1:].tolist(), len(send)], strict=True) if len(send) else ():
            rows.append((int(bucket[a]), *(_packed(c[send[a:b]]) for c in columns), _packed(flags[send[a:b]])))
        return _table(rows, DEALT)

    for batch in batches:
        for rid, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
            sums, _, first, last = found = triggers(hasher, np.frombuffer(text, np.uint8), length, gram)
            fp = hasher.of(sums, found[1], found[1] + gram) & mask
            m = len(fp)
            parts.append((fp, hasher.of(sums, first, last + length), np.full(m, doc, np.int64), np.full(m, rid, np.int64), np.arange(m, dtype=np.uint32)))
            held += m
            if held >= FLUSH:
                yield out()
                held = 0
    if parts:
        yield out()


def _compare(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Which contexts earlier documents have, and which triggers have more than one context."""
    cells: list[list[bytes]] = [[] for _ in _KINDS]
    for batch in batches:
        own = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] < 0:
                own.append((-1 - row[0], *row[4:]))
            else:
                for k, c in enumerate(row[1:]):
                    cells[k].append(c)
        if own:
            yield _table(own, ANSWERS)
    fp, context, doc, rid, place, hot = (_unpacked(c, k) for c, k in zip(cells, _KINDS, strict=True))
    cells.clear()
    if not len(fp):
        return
    order, group, covered = _settled(fp, context, doc)
    fp, context, doc, rid, place, hot = (x[order] for x in (fp, context, doc, rid, place, hot))
    contexts = np.bincount(group, weights=_first_of([fp, context]))
    begins = np.flatnonzero(_first_of([group]))
    several = np.minimum.reduceat(doc, begins) < np.maximum.reduceat(doc, begins)  # of one document nothing is earlier
    common = np.maximum.reduceat(hot, begins) > 0
    asked = ((contexts > 1) & several | common)[group] & ~covered
    yield _table(_answers(rid, place, covered, asked, buckets), ANSWERS)


def _by_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each text of which something is known."""
    cells: list[list[bytes]] = [[], [], []]
    for batch in batches:
        for k in range(3):
            cells[k] += batch.column(k + 1).to_pylist()
    rid, place, covered = (_unpacked(c, kind) for c, kind in zip(cells, (np.int64, np.uint32, np.uint8), strict=True))
    order = np.lexsort((place, rid))
    rid, place, covered = rid[order], place[order], covered[order] > 0
    at = np.flatnonzero(_first_of([rid]))
    ends = [*at[1:].tolist(), len(rid)]
    yield _table([(int(rid[a]), place[a:b][covered[a:b]].tobytes(), place[a:b][~covered[a:b]].tobytes()) for a, b in zip(at.tolist(), ends, strict=True)] if len(rid) else [], KNOWN)


def _cut(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The pieces of text around asked triggers, two for each; a settled run of windows is a piece without bytes."""
    hasher, width = _Hasher(), length - gram + 1
    half = width // 2
    for batch in batches:
        parts, texts = [], []
        for rid, doc, text, covered, asked in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            b = np.frombuffer(text, np.uint8)
            sums, place, first, last = triggers(hasher, b, length, gram)
            known = np.zeros(len(place), bool)
            known[np.frombuffer(covered, np.uint32)] = True
            if known.any():
                lo, hi = first[known], last[known] + length
                new = np.concatenate(([True], lo[1:] > np.maximum.accumulate(hi)[:-1]))
                lo = lo[new]
                hi = np.maximum.reduceat(hi, np.flatnonzero(new))
                zero = np.zeros(len(lo), np.int64)
                parts.append((zero, zero, zero - 1, zero + doc, zero + rid, hi, lo, zero))
                texts += [b""] * len(lo)
            ask = np.unique(np.frombuffer(asked, np.uint32))
            ask = ask[~known[ask]]
            for low, high in ((0, half), (half, width)):
                # windows that start `low` to `high` - 1 bytes before the trigger
                a, z = np.maximum(first[ask], place[ask] - high + 1), np.minimum(last[ask], place[ask] - low)
                use = np.flatnonzero(a <= z)
                if not len(use):
                    continue
                t, a, z = place[ask][use], a[use], z[use]
                key = hasher.of(sums, t - low, t - high + 1 + length) ^ np.uint64(low)
                fill = np.zeros(len(t), np.int64)
                parts.append((key.view(np.int64), fill + low, fill + high, fill + doc, fill + rid, t, a, z - a + 1))
                texts += [text[p : q + length] for p, q in zip(a.tolist(), z.tolist(), strict=True)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 8
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()).cast(k) for c, k in zip(columns, kinds, strict=True)], pa.array(texts, pa.binary())], [f.split()[0] for f in PIECES.split(", ")])


def suffix_ranks(text: np.ndarray, depth: int) -> np.ndarray:
    """Ranks from 1 of the suffixes of `text` (numbers from 1 on) in the order of their first `depth` symbols, by difference
    cover. Suffixes that agree in so many symbols may have one rank or come in any order.

    The suffixes at places 1 and 2 modulo 3 are the sample: their triples are sorted and named, and if names repeat, the
    suffixes of the text of names are ranked by this same function. A place 0 modulo 3 has its symbol and the rank of the
    next place as its key; it is merged with the sample by the symbol or two before the next place that both sides know.
    """
    n = len(text)
    if n >= 1 << 21:
        raise ValueError("names of three symbols don't fit 63 bits")
    s = np.concatenate((text.astype(np.int64), np.zeros(3, np.int64)))
    top = int(s.max()) + 1
    ones, twos, zeros = np.arange(1, n, 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.concatenate((ones, twos))
    triple = (s[sample] * top + s[sample + 1]) * top + s[sample + 2]
    names, name = np.unique(triple, return_inverse=True)
    name = name.reshape(-1) + 1
    if len(names) < len(sample) and depth > 3:
        deeper = suffix_ranks(np.concatenate((name[: len(ones)] + 1, [1], name[len(ones) :] + 1)), -(-depth // 3))
        name = np.concatenate((deeper[: len(ones)], deeper[len(ones) + 1 :]))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name
    most = int(rank.max()) + 1
    by_one = lambda at: s[at] * most + rank[at + 1]
    by_two = lambda at: (s[at] * top + s[at + 1]) * most + rank[at + 2]
    zeros = zeros[np.argsort(by_one(zeros))]
    before = np.searchsorted(np.sort(by_one(ones)), by_one(zeros)) + np.searchsorted(np.sort(by_two(twos)), by_two(zeros))
    order = np.empty(n, np.int64)
    taken = np.zeros(n, bool)
    place = np.arange(len(zeros)) + np.maximum.accumulate(before) if len(zeros) else before
    order[place], taken[place] = zeros, True
    order[~taken] = sample[np.argsort(name)]
    # equal neighbours have one rank: by the sample's names, or by the keys that both know
    kind = order % 3
    a, b, p, q = order[:-1], order[1:], kind[:-1], kind[1:]
    equal = np.where((p > 0) & (q > 0), rank[a] == rank[b], np.where((p != 2) & (q != 2), by_one(a) == by_one(b), by_two(a) == by_two(b)))
    out = np.empty(n, np.int64)
    out[order] = np.concatenate(([1], 1 + np.cumsum(~equal))) if n else order
    return out


def earlier_windows(pieces: list[bytes], doc: np.ndarray, length: int) -> np.ndarray:
    """For each start of a window in the joined pieces (those that have `length` bytes left): whether a piece of an earlier
    document holds the same window; -1 where no window starts."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    b = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)
    left = np.repeat(np.cumsum(sizes + 1), sizes + 1) - 1 - np.arange(len(b))
    text = np.where(left == 0, 1, b.astype(np.int64) + 2)  # 1 ends a piece
    rank = suffix_ranks(text, length)
    starts = np.flatnonzero(left >= length)
    starts = starts[np.argsort(rank[starts])]
    out = np.full(len(b), -1, np.int8)
    if not len(starts):
        return out
    windows = np.lib.stride_tricks.sliding_window_view(b, length)
    new = np.ones(len(starts), bool)
    for k in range(1, len(starts), 200_000):  # neighbours' first bytes
        at = starts[k - 1 : k + 200_000]
        new[k : k + 200_000] = (windows[at[1:]] != windows[at[:-1]]).any(axis=1)
    least = np.minimum.reduceat(doc[owner[starts]], np.flatnonzero(new))
    out[starts] = doc[owner[starts]] > least[np.cumsum(new) - 1]
    return out


def _sort(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Spans that earlier documents hold, of pieces that come in order of their keys."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        # equal pieces of a core hold the same windows: the later ones go whole, and a core of one text is done
        least: dict[tuple, int] = {}
        kinds: Counter = Counter()
        for key, doc, _, _, piece in rows:
            if (key, piece) not in least:
                kinds[key] += 1
            least[key, piece] = min(doc, least.get((key, piece), doc))
        whole = [(rid, first, first + len(piece)) for key, doc, rid, first, piece in rows if doc > least[key, piece]]
        rows = [r for r in rows if kinds[r[0]] > 1 and r[1] == least[r[0], r[4]]]
        found = [np.array(c, np.int64) for c in zip(*whole, strict=True)] if whole else [np.zeros(0, np.int64)] * 3
        if rows:
            _, doc, rid, first, pieces = zip(*rows, strict=True)
            gone = earlier_windows(list(pieces), np.array(doc, np.int64), length)
            step = np.diff(np.concatenate(([0], (gone == 1).astype(np.int8), [0])))
            a, z = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + 1)))
            piece = np.searchsorted(begin, a, "right") - 1
            shift = np.array(first, np.int64)[piece] - begin[piece]
            found = [np.concatenate(x) for x in zip(found, (np.array(rid, np.int64)[piece], a + shift, z + shift - 1 + length), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1].astype(np.int32)), pa.array(found[2].astype(np.int32))], ["rid", "start", "end"])

    rows, held = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held >= SORT_BYTES and row[0] != rows[-1][0]:
                yield out(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[4]) + 1
    if rows:
        yield out(rows)


def _freed(spark: SparkSession) -> None:
    """Shuffle files that no table needs any more go when the driver forgets their plans, which is made sure of here: they
    would lie beside those of the next steps."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _known(own: DataFrame, n: int, length: int, gram: int, local_hot: int) -> DataFrame:
    """(_rid, covered, asked) of the texts of which something is known. n: about how many triggers there are."""
    tasks = max(n // TASK_TRIGGERS + 1, int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bits, buckets = min(64, max(40, n.bit_length() + 12)), 4 * tasks
    dealt = own.select("rid", "doc", "body").mapInArrow(partial(_deal, buckets=buckets, bits=bits, length=length, gram=gram, local_hot=local_hot), DEALT)
    answers = dealt.repartition(tasks, "bucket").mapInArrow(partial(_compare, buckets=buckets), ANSWERS)
    return materialise(answers.repartition(tasks, "bucket").mapInArrow(_by_text, KNOWN), "known").withColumnRenamed("rid", "_rid")


def _pieces(own: DataFrame, known: DataFrame, length: int, gram: int) -> DataFrame:
    same = F.col("rid") == F.col("_rid")
    asked = own.join(maybe_broadcast(known.select("_rid")), same, "left_semi").join(known.hint("merge"), same)
    return materialise(asked.select("rid", "doc", F.col("body").cast("binary"), "covered", "asked").mapInArrow(partial(_cut, length=length, gram=gram), PIECES), "pieces", compression="zstd")


def _common_cores(pieces: DataFrame, most: int) -> DataFrame:
    """(_key, _low) of the cores of far too many pieces: counted over one piece in a few, by a hash of its place."""
    one_in = max(1, most // 16)
    some = pieces.filter(F.pmod(F.xxhash64("rid", "trigger"), F.lit(one_in)) == 0)
    return some.groupBy("key", "low").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most // one_in).select(F.col("key").alias("_key"), F.col("low").alias("_low"))


def _sorted_spans(pieces: DataFrame, length: int, most: int) -> list[DataFrame]:
    """Spans of the windows that earlier documents hold; pieces of common cores are parted until they are few."""
    spark, out = pieces.sparkSession, []
    while True:
        common = materialise(_common_cores(pieces, most), "common")
        of = (F.col("key") == F.col("_key")) & (F.col("low") == F.col("_low"))
        few = pieces.join(maybe_broadcast(common), of, "left_anti").select("key", "doc", "rid", "first", "bytes")
        tasks = int(pieces.agg(F.coalesce(F.sum("n") + F.count(F.lit(1)) * (length - 1), F.lit(0))).first()[0]) // TASK_BYTES + 1
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
        out.append(materialise(few.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(partial(_sort, length=length), SPANS), "spans"))
        if common.isEmpty():
            return out
        wide = pieces.join(maybe_broadcast(common), of, "left_semi")
        single = wide.filter("high - low = 1")  # one window each: its bytes are the key
        firsts = single.groupBy(F.col("bytes").alias("_bytes")).agg(F.min("doc").alias("_least"))
        out.append(materialise(single.join(firsts, F.col("bytes") == F.col("_bytes")).filter("_least < doc").select("rid", F.col("first").alias("start"), (F.col("first") + length).alias("end")), "spans"))
        wide = wide.filter("high - low > 1")
        middle = F.expr("low + (high - low) div 2").cast("int")
        part = F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high").alias("high")))).alias("p")
        parts = wide.select("doc", "rid", "trigger", "first", "n", "bytes", part).select("doc", "rid", "trigger", "first", "n", "bytes", "p.low", "p.high")
        start = F.greatest(F.col("first"), F.col("trigger") - F.col("high") + 1)
        end = F.least(F.col("first") + F.col("n") - 1, F.col("trigger") - F.col("low"))
        parts = parts.withColumns({"_a": start, "_n": end - start + 1}).filter("_n > 0")
        parts = parts.withColumns({"bytes": F.expr(f"substring(bytes, _a - first + 1, _n + {length - 1})"), "first": F.col("_a"), "n": F.col("_n").cast("int")}).drop("_a", "_n")
        core = F.expr(f"substring(bytes, trigger - low - first + 1, {length} + 1 - (high - low))")
        pieces = materialise(parts.withColumn("key", F.xxhash64("low", "high", core)).select(*pieces.columns), "pieces")


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            kept, at, n_spans, removed, before = hashlib.sha256(), 0, 0, 0, -1
            for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
                if s["start"] > before:
                    kept.update(text[max(at, 0) : s["start"]])
                    n_spans += 1
                    before = at = s["start"]
                removed += max(0, s["end"] - at)
                at = before = max(at, s["end"])
            kept.update(text[at:])
            rows.append((doc_id, len(text), removed, n_spans, kept.hexdigest()))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()], strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = HOT_PIECES, local_hot: int = LOCAL_HOT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the rows of `docs` (doc_id, doc, body, n_bytes, rid, lead) as a written table, and the spans
    (rid, start, end), which may overlap, of the leads: of equal texts, the row of the smallest id. `lead` is a row's lead,
    null where all of the row goes, as an earlier document has the same text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("body"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NONE)).alias("doc"), "body", F.octet_length("body").cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("rid"), F.xxhash64("body").alias("t1"), F.xxhash64(F.lit(1), "body").alias("t2"))
    rows = materialise(rows, "rows", compression="zstd")  # all texts once more
    long = F.col("n_bytes") >= length
    same = rows.filter(long).groupBy(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "rid")).alias("s")).filter("copies > 1")
    same = materialise(same.select("_t1", "_t2", F.col("s.doc").alias("_doc"), F.col("s.rid").alias("_rid")), "copies")
    lead = F.when(F.col("_rid").isNull(), F.col("rid")).when(F.col("doc") == F.col("_doc"), F.col("_rid"))
    rows = rows.join(maybe_broadcast(same), (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")) & long, "left").select("doc_id", "doc", "body", "n_bytes", "rid", lead.alias("lead"))
    own = rows.filter((F.col("lead") == F.col("rid")) & long)
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    known = _known(own, max(1, total * 2 // (length - gram)), length, gram, local_hot)
    _freed(spark)
    pieces = _pieces(own, known, length, gram)
    _freed(spark)
    covered = pieces.filter("high < 0").select("rid", F.col("first").alias("start"), F.col("trigger").alias("end"))
    spans = _sorted_spans(pieces.filter("high > 0"), length, most)
    return rows, reduce(DataFrame.unionByName, spans, covered)


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = HOT_PIECES, local_hot: int = LOCAL_HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte goes that a string of `length` bytes covers which also starts in a document of a smaller id; strings
    overlap, lie within one document, and are judged on the input. n_spans: runs of removed bytes; kept_sha256: of the
    rest, joined. Null texts are empty; shorter texts lose nothing. Rows of one id don't take from each other. A null id
    counts as later than all others.
    """
    rows, spans = repeated_bytes(docs, length, gram, most, local_hot, id_col, text_col)
    by_text = materialise(spans.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "by_text")  # of one text
    _freed(docs.sparkSession)
    whole = rows.filter("lead IS NULL").select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    none = F.lit(0).cast("long")
    keys = maybe_broadcast(by_text.select("_rid"))
    same = F.col("lead") == F.col("_rid")
    kept = rows.filter("lead IS NOT NULL")
    clean = kept.join(keys, same, "left_anti").select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("body").cast("binary"), 256).alias("kept_sha256"))
    cut = kept.join(keys, same, "left_semi").join(by_text.hint("merge"), same).select("doc_id", "body", "spans").mapInArrow(_results, RESULT)
    return whole.unionByName(clean).unionByName(cut)


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of every row with the repeated bytes cut out; bytes that no longer make a character are replaced."""
    rows, spans = repeated_bytes(docs, length, id_col=id_col, text_col=text_col)
    by_text = materialise(spans.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("start", "end")).alias("spans")), "by_text")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(texts, found, strict=True):
            b = text.encode()
            keep = np.ones(len(b), bool)
            for s in spans:
                keep[s["start"] : s["end"]] = False
            out.append(np.frombuffer(b, np.uint8)[keep].tobytes().decode(errors="replace"))
        return pd.Series(out, dtype=object)

    joined = rows.join(by_text, F.col("lead") == F.col("_rid"), "left")
    text = F.when(F.col("lead").isNull(), F.lit("")).when(F.col("spans").isNull(), F.col("body")).otherwise(cut(F.col("body"), F.coalesce("spans", F.expr("array()").cast("array<struct<start:int,end:int>>"))))
    return joined.select("doc_id", text.alias("text"))
