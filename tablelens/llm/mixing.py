"""Mixing sources to target weights: repetition rates per source, hash-seeded copies per document that add up."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import WORD, materialise, maybe_broadcast, text_or_empty
from tablelens.operators.ranks import running_counts

#: Hexadecimal digits of the md5 that seed a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


def word_count(text_col: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def draw(column: str, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the value alone; a null draws as the text 'null'."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, DRAW_DIGITS), 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """Per source (columns source, size in `sizes`): source_size, target.

    Sources in order of code points, null last, get `weights` in turn and share the sum of all sizes by them.
    A target stops at `max_repeats` times its source's size; the excess is shared again by weight among the
    others until none is above. Sources without words get target 0.

    The table of sources is never collected: ranks come from counts per range partition, and each round of
    sharing is one aggregation. A round caps at least one more source, few rounds are usual.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    per = materialise(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "sources")
    counts = {r["part"]: r["n"] for r in per.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per partition
    before, seen = {}, 0
    for part in sorted(counts):
        before[part], seen = seen, seen + counts[part]
    offset = F.lit(0)
    if before:
        offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("part")]
    weight = F.array(*[F.lit(float(w)) for w in weights])[((F.col("at") + offset) % len(weights)).cast("int")]
    per = per.select("source", "source_size", weight.alias("weight"))
    cap = F.col("source_size") * max_repeats
    total, shared = per.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return per.select("source", "source_size", F.lit(0.0).alias("target"))
    level, n_capped = total / shared, -1
    while True:
        over = cap <= F.lit(level) * F.col("weight")
        n, taken, left = per.agg(F.count_if(over), F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == n_capped or not left:
            break
        n_capped, level = n, (total - (taken or 0)) / left
    over = cap <= F.lit(level) * F.col("weight")
    return per.select("source", "source_size", F.when(over, cap.cast("double")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def with_rates(targets: DataFrame) -> DataFrame:
    """Adds whole (copies that every document gets) and fraction (the probability of one more)."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return targets.withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.floor(rate))


def copies(sizes: DataFrame, rates: DataFrame, seed: str) -> DataFrame:
    """doc_id, source, size, tie, n_rows, source_size, target, n_copies: a row per document, with its number of copies.

    Every document gets `whole` copies, and one more with probability `fraction`. The draws of a source aren't independent:
    its documents are numbered by size, then by a hash of the id, the fraction is added up along them from one
    hash-seeded offset, and a copy is given where the sum passes a whole number. Of two neighbours about one size apart one
    gets the copy instead of the other, so that a source's words miss its target by no more than its largest document.
    Numbers come from ranges that go on where those before ended, so no task holds a source. Rows that agree in id,
    source and text share their copies.
    """
    units = sizes.groupBy("doc_id", "source", "size", "tie").agg(F.count(F.lit(1)).alias("n_rows"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    units = units.withColumn("order", F.struct("size", F.md5(F.concat(F.lit(f"{seed}:"), name)).alias("h"), "doc_id", "tie"))
    numbered = running_counts(units, ["source"], "order", "n_rows")
    rated = numbered.join(maybe_broadcast(rates.withColumnRenamed("source", "__source")), F.col("source").eqNullSafe(F.col("__source")))
    passed = lambda k: F.floor(draw("source", seed) + k * F.col("fraction"))
    given = passed(F.col("before") + F.col("n_rows")) - passed(F.col("before"))
    more = (2 * given >= F.col("n_rows")).cast("int")
    return rated.select("doc_id", "source", "size", "tie", "n_rows", "source_size", "target", "whole", (F.col("whole") + more).cast("int").alias("n_copies"))


def _sizes(docs: DataFrame) -> DataFrame:
    return materialise(docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), F.xxhash64(text_or_empty("text")).alias("tie")), "sizes")


def mix_report(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted).

    A source's taken words differ from its target by no more than its largest document (see `copies`). Null texts and texts
    without words have size 0 and are never counted as taken. Null sources form one source. Reruns agree.
    """
    sizes = _sizes(docs)
    rates = materialise(with_rates(source_targets(sizes, weights, max_repeats)), "rates")
    out = copies(sizes, rates, seed).withColumn("_row", F.explode(F.array_repeat(F.lit(0), F.col("n_rows").cast("int"))))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """The mixed corpus: every document as often as `copies` says, columns of `docs` unchanged."""
    sizes = _sizes(docs)
    rates = materialise(with_rates(source_targets(sizes, weights, max_repeats)), "rates")
    drawn = materialise(copies(sizes, rates, seed).filter("n_copies > whole").select(F.col("doc_id").alias("__tl_id"), F.col("source").alias("__tl_of"), F.col("tie").alias("__tl_tie")), "drawn")
    rates = rates.select(F.col("source").alias("__tl_source"), F.col("whole").alias("__tl_whole"))
    source = F.col("source").cast("string")
    same = F.col("doc_id").eqNullSafe(F.col("__tl_id")) & source.eqNullSafe(F.col("__tl_of")) & (F.xxhash64(text_or_empty("text")) == F.col("__tl_tie"))
    joined = docs.join(maybe_broadcast(rates), source.eqNullSafe(F.col("__tl_source"))).join(maybe_broadcast(drawn, 1_000_000), same, "left")
    n = (F.col("__tl_whole") + F.col("__tl_tie").isNotNull().cast("int")).cast("int")
    return joined.withColumn("__tl_copy", F.explode(F.array_repeat(F.lit(0), n))).select(*docs.columns)
