"""The pipeline's stages, each against a plain version on its own input."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gristmill.llm import tokens  # noqa: E402
from test_training_operators import EDGES, brute_classes, docs_of, plain_groups  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, SF).cache()
        rows = out.collect()
        if name == "quality classifier":
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
            assert len(good & {r.doc_id for r in rows}) >= 0.95 * len(good & set(before))
        if name == "exact dedup":
            assert {r.doc_id for r in rows} == {min(ids) for ids in plain_groups([(i, t, "") for i, t in before.items()]).values()}
        if name == "near dedup":
            assert {r.doc_id for r in rows} == set(brute_classes(before).values())
        if name == "mixing":
            assert {r.doc_id for r in rows} <= set(before) and max(out.groupBy("doc_id").count().agg(F.max("count")).first()) <= 3
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before) and all(r.offset + r.length <= 2048 for r in rows)
        else:
            assert out.columns == corpus_pipeline.COLUMNS
            assert all(before[r.doc_id] == r.text for r in rows)
        docs = out


@pytest.mark.parametrize("rows", [EDGES, EDGES[:0]])
def test_stages_on_edges(spark, rows):
    """Nulls, empty and very long texts, ties, repeated rows, an empty table: what each stage keeps."""
    docs = docs_of(spark, rows)
    ids = lambda found: sorted(str(r.doc_id) for r in found.collect())
    stage = dict(corpus_pipeline.STAGES)
    left = {(r.doc_id, r.text) for r in stage["quality classifier"](spark, docs, SF).collect()}
    assert left <= {(i, t) for i, t, _ in rows}
    kept = [min((i for i in own if i is not None), default=None) for own in plain_groups(rows).values()]
    assert ids(stage["exact dedup"](spark, docs, SF)) == sorted(map(str, kept))
    assert ids(stage["near dedup"](spark, docs, SF)) == sorted(str(i) for i, _, _ in rows if i != 7)
    drawn = stage["mixing"](spark, docs, SF).collect()
    assert {(r.doc_id, r.text) for r in drawn} <= {(i, t) for i, t, _ in rows}
    packed = stage["packing"](spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in packed if r.piece == 0) == sorted(str(i) for i, _, _ in rows)
    assert sum(r.length for r in packed) == sum(len(tokens.encode(t, tokens.default_path())) for _, t, _ in rows)
