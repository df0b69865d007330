"""Exact dedup: 128-bit content hash, one row kept per text, bytes compared inside groups. Native operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.common import discard, materialise, small, text_or_empty

#: Rows of one hash group that are compared with its kept row in one join partition.
ROWS_PER_SALT = 2_000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row with the largest id
    stays; among rows that repeat that id too, exactly one is marked kept. A null id ranks below every other.
    Other columns of `docs` are ignored, so their names can't clash. An empty table gives an empty table.

    One pass over the texts leaves a narrow table (id, 128-bit hash, digest). Groups are found on it with
    partial aggregation, so that a group of any size costs one row per task. A second pass shuffles only the
    texts of groups with more than one row and compares their bytes with the kept row's, salted by group size.
    Rows that differ from it, a hash collision, are grouped once more by the text itself.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("body"))
    narrow = materialise(
        rows.select(
            "doc_id",
            F.unhex(F.md5("body")).alias("h"),
            F.sha2("body", 256).alias("text_sha256"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "hashes",
    )
    ids = narrow.groupBy("h", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    groups = ids.groupBy("h").agg(F.sum("n").alias("group_size"), F.max("doc_id").alias("keep_id"))
    multi = materialise(groups.filter("group_size > 1"), "groups")
    few = small(multi)
    hint = F.broadcast if few else (lambda df: df)
    kept_row = hint(
        materialise(
            ids.join(hint(multi.select("h", "keep_id")), "h")
            .filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
            .select("h", F.col("row").alias("keep_row")),
            "kept",
        )
    )
    differing = materialise(_differing(rows, multi, few), "collisions")
    if differing.isEmpty():
        discard(differing)
        return (
            narrow.join(hint(multi), "h", "left")
            .join(kept_row, "h", "left")
            .select(
                "doc_id",
                F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                (F.col("keep_row").isNull() | (F.col("row") == F.col("keep_row"))).alias("kept"),
                "text_sha256",
            )
        )
    return _by_text(rows)


def _differing(rows: DataFrame, multi: DataFrame, few: bool) -> DataFrame:
    """Rows whose bytes differ from those of their group's kept row."""
    salted = multi.withColumn("salts", F.ceil(F.col("group_size") / ROWS_PER_SALT).cast("int"))
    hashed = rows.withColumns({"h": F.unhex(F.md5("body")), "row": F.monotonically_increasing_id()})
    members = hashed.join((F.broadcast if few else (lambda df: df))(salted), "h")
    keepers = members.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("h", "salts").agg(F.first("body").alias("keep_body"))
    keepers = keepers.select("h", "keep_body", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = members.withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int"))
    return members.join(keepers, ["h", "salt"]).filter(F.col("body") != F.col("keep_body")).select("doc_id", "h")


def _by_text(rows: DataFrame) -> DataFrame:
    """The same result with the text itself as the key; used only if a 128-bit hash collided."""
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    ids = rows.groupBy("body", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"))
    groups = ids.groupBy("body").agg(F.sum("n").alias("group_size"), F.max("doc_id").alias("keep_id"))
    kept = ids.join(groups, "body").filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("body", "keep_id", "group_size", F.col("row").alias("keep_row"))
    return rows.join(kept, "body").select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.sha2("body", 256).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` without the rows that `exact_groups` doesn't keep; all columns stay, whatever their names.

    Rows that repeat both id and text of a kept row are reduced to one of them.
    """
    found = materialise(exact_groups(docs, id_col, text_col), "verdicts")
    kept = found.filter("kept AND group_size > 1").select(F.col("doc_id").alias("__tl_id"), F.col("text_sha256").alias("__tl_sha"), F.lit(True).alias("__tl_kept"))
    gone = materialise(found.filter("NOT kept").select(F.col("doc_id").alias("__tl_id"), F.col("text_sha256").alias("__tl_sha")).distinct().join(kept, ["__tl_id", "__tl_sha"], "left"), "gone")
    hint = F.broadcast if small(gone) else (lambda df: df)
    body = docs.withColumn("__tl_sha", F.sha2(text_or_empty(text_col), 256))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__tl_id")) & (body["__tl_sha"] == gone["__tl_sha"])
    alone = body.join(hint(gone), same, "left_anti").select(*docs.columns)
    again = gone.filter("__tl_kept")
    if again.isEmpty():
        return alone
    one = body.join(hint(again), same, "left_semi").dropDuplicates([id_col, "__tl_sha"]).select(*docs.columns)
    return alone.unionByName(one)
