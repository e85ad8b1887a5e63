"""The pipeline: stages in order, decisions that take effect, columns that stay."""

import os
import random

import pytest

import corpus_pipeline as P
from quillspark.llm.common import prepared
from tests.llm.test_quality import bad, good

ITEM = "harbour lantern copper meadow whisper velvet thunder orchard compass ribbon feather kettle marble saddle"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    base = tmp_path_factory.mktemp("sf")
    docs = [(i, good(r) if i % 4 else bad(r)) for i in range(400)]
    docs += [(1000, docs[1][1]), (1001, docs[2][1] + " End."), (1002, good(r) + " " + ITEM.title() + " " + good(r))]
    rows = [(i, t, "en", "src", len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(0, ITEM)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder):
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "byte-level BPE"]
    docs = prepared(spark).read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (_, stage) in enumerate(P.STAGES):
        docs = stage(spark, docs, folder)
        if i < 3:
            assert docs.columns == columns
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
    lost = {i for i in range(400) if i % 4} - seen[0]
    assert len(lost) <= 6 and sum(i % 4 == 0 for i in seen[0]) <= 8
    assert 1000 in seen[0] - seen[1] and {1, 2} <= seen[1]
    assert seen[1] - seen[2] == {1002}
    assert {r.doc_id for r in P.run(spark, folder).collect()} == seen[3] == seen[2]


def test_missing_operators_are_not_hidden():
    source = open(os.path.join(os.path.dirname(P.__file__), "corpus_pipeline.py")).read()
    assert "except" not in source
