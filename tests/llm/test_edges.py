"""Repeated rows and ids, null ids, empty and null tables, for the operators and the whole pipeline."""

import pytest

pytest.importorskip("tablelens.llm")
from tablelens.llm import common, quality, simhash, toxicity  # noqa: E402

from .test_operators import SCHEMA, frame, labelled  # noqa: E402

LABELS = "doc_id long, quality int, toxic int"


def test_near_groups_of_repeated_and_null_ids(spark):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(4, text, "s"), (4, text, "s"), (None, text, "s"), (2, text.replace("word59", "other"), None), (None, "alone without an id", "s"), (7, None, "s"), (8, "", "s")]
    found = simhash.near_groups(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    near = {r["component_id"] for r in found if r["doc_id"] in (4, 2)}
    assert near in ({2}, {2, 4}) and {r["component_id"] for r in found if r["doc_id"] in (7, 8)} == {7}
    assert sum(r["component_id"] is None for r in found) == 1
    kept = simhash.drop_near_copies(frame(spark, rows)).collect()
    assert sum(r["doc_id"] == 4 for r in kept) <= 1 and sum(r["doc_id"] is None for r in kept) == 2


def test_toxicity_of_repeated_rows_and_labels(spark):
    rows, labels = labelled(n=300)
    table = spark.createDataFrame([*labels, *labels[:50], (None, 1, 1), (5, 1, None)], LABELS)
    found = toxicity.toxicity(frame(spark, [*rows, rows[0], rows[0], (None, None, None)]), table).collect()
    assert len(found) == len(rows) + 3 and len({r["score"] for r in found if r["doc_id"] == rows[0][0]}) == 1
    assert {(r["held_out"], r["predicted"]) for r in found if r["doc_id"] is None} == {(False, 0)}


def test_quality_of_null_columns(spark):
    found = quality.quality_report(frame(spark, [(None, None, None), (None, "some words here", None), (3, "x" * 100_000, "s")])).collect()
    assert len(found) == 3 and not any(r["kept"] for r in found)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, None, None), (1, "one text", "s"), (1, "one text", "s"), (2, "", "s")]])
def test_pipeline_of_small_tables(spark, tmp_path, rows):
    import corpus_pipeline

    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")], name
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert bool(pieces) == bool(docs.count())


def test_scratch_folder(spark, monkeypatch):
    table = common.materialise(spark.range(3).toDF("x"), "edge")
    assert table.count() == 3
    common.discard(table)
    named = spark.conf.get("spark.checkpoint.dir")
    assert common.scratch_dir(spark) == named.rstrip("/")

    class Elsewhere:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://somewhere:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.scratch_dir(Elsewhere())
