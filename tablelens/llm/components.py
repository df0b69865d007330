"""Connected components of an edge table, by alternating large-star and small-star steps. DataFrame operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import discard, materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a long, b long); component is the smallest node reachable.

    Loops and repeated edges do no harm; an empty table gives an empty table. Each round writes its edges to the
    shared folder, so a lost executor repeats one round at most. A round's result replaces the one before.
    """
    now = materialise(_oriented(edges), "edges")
    before = _mark(now)
    while True:
        large = materialise(_large_star(now), "large")
        after = materialise(_small_star(large), "small")
        mark = _mark(after)
        for old in (now, large):
            discard(old)
        now = after
        if mark == before:
            break
        before = mark
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _oriented(edges: DataFrame) -> DataFrame:
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """What tells one edge set from another: how many, and two sums over their hashes."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")), F.sum(F.xxhash64("b", "a").bitwiseXOR(h).cast("decimal(20,0)"))).first())


def _least_of(edges: DataFrame, node: str, other: str) -> DataFrame:
    """The least neighbour of each node. Its key is written anew, so that the join deals this side out by itself and
    a node with very many edges can be split on the other side."""
    found = edges.groupBy(node).agg(F.min(other).alias("least"))
    return found.select(F.col(node).bitwiseXOR(F.lit(0)).alias("key"), "least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least one around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.join(_least_of(both, "a", "b"), F.col("a") == F.col("key")).filter("b > a")
    return joined.select(F.col("b").alias("a"), F.least("a", "least").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of them."""
    joined = edges.join(_least_of(edges, "a", "b"), F.col("a") == F.col("key"))
    out = joined.select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
    return out.filter("a <> b").unionByName(joined.select("a", F.col("least").alias("b"))).distinct()
