"""SimHash near-dedup with a generalised pigeonhole search.

Two fingerprints of 64 bits that differ in at most t bits, cut into m groups of bits with thresholds t_1..t_m whose
sum is t - m + 1, differ in at most t_i bits in some group i (-1 leaves a group out). Bits that go together are put
in one group, and the thresholds are chosen by dynamic programming on the numbers of candidates that each would give.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tablelens.llm.common import discard, materialise, maybe_broadcast
from tablelens.llm.components import connected_components

BITS = 64
SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Shingles hashed at a time, to bound the memory that a very long text takes.
SHINGLES_AT_ONCE = 1 << 16
#: Fingerprints of a block that one task compares; larger blocks are cut by further bits, then by tiles.
BLOCK = 20_000
LEVELS = 3
#: What one more key for each fingerprint costs, in compared pairs.
KEY_COST = 8.0


def fingerprint(text: bytes | None) -> int:
    """The SimHash of a text's 3-word shingles; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined, n = b" ".join(words), len(words) - SHINGLE + 1
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    ends = (ends[SHINGLE - 1 :] - 1).tolist()
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = zip(starts[at : at + SHINGLES_AT_ONCE], ends[at : at + SHINGLES_AT_ONCE], strict=True)
        h = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in part], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in batch.column(1).cast(pa.binary()).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each row's text as a signed long."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long")


# The plan of the search


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), dtype=np.int64)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
        for at in range(0, len(fps), SHINGLES_AT_ONCE):
            bits = np.unpackbits(fps[at : at + SHINGLES_AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
            total += (bits.T @ bits).astype(np.int64)
    k = np.arange(BITS * BITS)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total.ravel())], ["k", "n"])


def bit_groups(fps: DataFrame, groups: int) -> list[int]:
    """Masks of `groups` groups of bits that cover all 64, correlated bits together. Counted over all fingerprints."""
    n = max(1, fps.count())
    rows = fps.select("fp").mapInArrow(_together, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # 64 x 64 numbers
    both = np.zeros(BITS * BITS)
    for r in rows:
        both[r["k"]] = r["n"]
    both = both.reshape(BITS, BITS) / n
    p = both.diagonal()
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.abs(np.where(spread > 0, (both - np.outer(p, p)) / spread, 0))
    np.fill_diagonal(r, 0)
    left, masks = set(range(BITS)), []
    for g in range(groups):
        width = len(left) // (groups - g)
        own = [max(sorted(left), key=lambda b: r[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < width:
            own.append(max(sorted(left), key=lambda b: r[b, own].sum()))
            left.discard(own[-1])
        masks.append(sum(1 << b for b in own))
    return masks


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks_of(mask: int, threshold: int) -> list[int]:
    """Two values that differ in at most `threshold` bits of `mask` agree under one of these masks."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [mask & ~sum(1 << b for b in gone) for gone in combinations(bits, threshold)] if threshold >= 0 else []


def candidate_costs(fps: DataFrame, masks: list[int]) -> list[dict[int, float]]:
    """For each group and each threshold -1, 0, 1: pairs that would be compared, and keys that would be written."""
    n, out = fps.count(), []
    for mask in masks:
        values = fps.select(F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"))
        near = F.array(*[F.struct(F.lit(k).alias("k"), F.col("v").bitwiseAND(F.lit(signed(m))).alias("v")) for k, m in enumerate(masks_of(mask, 1))])
        near = values.select("c", F.explode(near).alias("s")).groupBy("s.k", "s.v").agg(F.sum("c").alias("c"))
        pairs = [float(t.agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2)).first()[0] or 0) for t in (values, near)]
        out.append({-1: 0.0, 0: pairs[0] + KEY_COST * n, 1: pairs[1] + KEY_COST * n * mask.bit_count()})
    return out


def allocate(costs: list[dict[int, float]], max_distance: int) -> list[int]:
    """Thresholds of least total cost whose sum is max_distance - groups + 1, by dynamic programming over groups."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t, c in options.items():
                found = (cost + c, [*chosen, t])
                if spent + t not in step or found < step[spent + t]:
                    step[spent + t] = found
        best = step
    return best[max_distance - len(costs) + 1][1]


# The search


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _keys(batches: Iterator[pa.RecordBatch], masks: list[int]) -> Iterator[pa.RecordBatch]:
    """(key, fp, used): a fingerprint under each mask; `used` is the mask."""
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for code, mask in enumerate(masks):
            key = _mix((fps & np.uint64(mask)) ^ _mix(np.full(len(fps), code + 1, dtype=np.uint64)))
            used = np.full(len(fps), mask, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), pa.array(used.view(np.int64))], ["key", "fp", "used"])


def _finer(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Keys of large blocks with one of `parts` shares of the bits that they don't use yet."""
    for batch in batches:
        key, fps, used = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(3))
        for one in np.unique(used).tolist():
            rows = np.flatnonzero(used == np.uint64(one))
            rest = [b for b in range(BITS) if not one >> b & 1]
            for j in range(parts):
                share = sum(1 << b for b in rest[j::parts])
                finer = _mix(_mix(key[rows] + np.uint64(j + 1)) ^ (fps[rows] & np.uint64(share)))
                mask = np.full(len(rows), one | share, dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (finer, fps[rows], mask)], ["key", "fp", "used"])


def _tiles(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks that no more bits can cut: every pair of tiles becomes a block of its own."""
    for batch in batches:
        key, fps = (batch.column(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in range(2))
        tiles = -(-batch.column(3).to_numpy(zero_copy_only=False) // (block // 2))
        own = (_mix(fps) % tiles.astype(np.uint64)).astype(np.int64)
        for other in range(int(tiles.max()) if len(tiles) else 0):
            rows = np.flatnonzero(tiles > other)
            low, high = np.minimum(own[rows], other), np.maximum(own[rows], other)
            finer = _mix(_mix(key[rows] ^ low.astype(np.uint64)) + high.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(finer.view(np.int64)), pa.array(fps[rows].view(np.int64))], ["key", "fp"])


def block_links(fps: np.ndarray, max_distance: int) -> list[tuple[int, int]]:
    """Edges that tie what a block links: one for each fingerprint but the first of each component."""
    links, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = np.bitwise_count(rest ^ here) <= max_distance
            if near.any():
                found = rest[near]
                links += [(int(here), x) for x in found.tolist()]
                queue += list(found)
                rest = rest[~near]
    return links


#: Blocks of up to so many rows are compared together, row by row at equal distances.
SMALL_BLOCK = 16


def _link(batches: Iterator[pa.RecordBatch], max_distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. A block that goes on in the next batch waits for it."""
    held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

    def links(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        sizes = np.diff(np.concatenate((starts, [len(key)])))
        left, right = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        size_of_row = np.repeat(sizes, sizes)
        for d in range(1, min(SMALL_BLOCK, int(sizes.max(initial=1)))):
            ok = (key[d:] == key[:-d]) & (size_of_row[d:] <= SMALL_BLOCK)
            ok &= np.bitwise_count(fp[d:] ^ fp[:-d]) <= max_distance
            left.append(fp[:-d][ok])
            right.append(fp[d:][ok])
        for k in np.flatnonzero(sizes > SMALL_BLOCK).tolist():
            if found := block_links(np.unique(fp[starts[k] : starts[k] + sizes[k]]), max_distance):
                pairs = np.array(found, dtype=np.uint64)
                left.append(pairs[:, 0])
                right.append(pairs[:, 1])
        a, b = np.concatenate(left), np.concatenate(right)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], ["a", "b"])

    for batch in batches:
        key = np.concatenate((held_key, batch.column(0).to_numpy(zero_copy_only=False)))
        fp = np.concatenate((held_fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)))
        if not len(key):
            continue
        done = np.searchsorted(key, key[-1])
        if done:
            yield links(key[:done], fp[:done])
        held_key, held_fp = key[done:], fp[done:]
    if len(held_key):
        yield links(held_key, held_fp)


def near_links(fps: DataFrame, max_distance: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over the distinct fingerprints `fps` (fp) that tie all that differ in at most max_distance bits.

    Every linked pair is connected by edges; a pair inside a large group isn't always an edge of its own.
    """
    masks = bit_groups(fps, max_distance + 1)
    thresholds = allocate(candidate_costs(fps, masks), max_distance)
    chosen = [m for mask, t in zip(masks, thresholds, strict=True) for m in masks_of(mask, t)]
    rows = fps.select("fp").mapInArrow(partial(_keys, masks=chosen), "key long, fp long, used long")
    done = []
    for level in range(LEVELS + 1):
        rows = materialise(rows, "keys")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
        sizes = materialise(sizes.select(F.col("key").alias("hot"), "n"), "hot")
        if sizes.isEmpty():
            done.append(rows.select("key", "fp"))
            break
        hint = maybe_broadcast(sizes)
        done.append(rows.join(hint, rows["key"] == sizes["hot"], "left_anti").select("key", "fp"))
        rows = rows.join(hint, rows["key"] == sizes["hot"]).select("key", "fp", "used", "n")
        if level == LEVELS:
            done.append(rows.mapInArrow(partial(_tiles, block=block), "key long, fp long"))
        else:
            rows = rows.select("key", "fp", "used").mapInArrow(partial(_finer, parts=max_distance + 1), "key long, fp long, used long")
    keyed = done[0]
    for more in done[1:]:
        keyed = keyed.unionByName(more)
    dealt = keyed.repartition(F.col("key")).sortWithinPartitions("key")
    return dealt.mapInArrow(partial(_link, max_distance=max_distance), "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable).

    A-Z are lower-cased; null and empty texts have fingerprint zero, which links like any other. Rows that repeat an
    id or a text are linked like others. A null id counts only if its component has no other. Other columns of `docs`
    are ignored. An empty table gives an empty table.
    """
    found = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    edges = materialise(near_links(distinct, max_distance), "links")
    nodes = materialise(connected_components(edges), "components")
    discard(edges)
    named = distinct.join(nodes.withColumnRenamed("node", "fp"), "fp")
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.select("fp", "component").join(roots, "component").select("fp", "component_id")
    alone = distinct.filter("n > 1").join(nodes.select(F.col("node").alias("fp")), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    groups = materialise(linked.unionByName(alone), "groups").withColumnRenamed("component_id", "__component")
    joined = found.join(maybe_broadcast(groups), "fp", "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("__component").isNull(), F.col("doc_id")).otherwise(F.col("__component")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each group, the one of the smallest id; columns unchanged.

    Rows that share an id are one document, and one of them stays. Rows without an id stay.
    """
    found = materialise(near_groups(docs, id_col, text_col).select("doc_id", "component_id"), "groups")
    own = F.col(id_col).cast("long") == F.col("__tl_id")
    gone = materialise(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("__tl_id")).distinct(), "gone")
    kept = docs.join(maybe_broadcast(gone), own, "left_anti")
    again = materialise(found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("__tl_id")).count().filter("count > 1").select("__tl_id"), "again")
    if again.isEmpty():
        return kept
    hint = maybe_broadcast(again)
    return kept.join(hint, own, "left_anti").unionByName(kept.join(hint, own, "left_semi").dropDuplicates([id_col]))
