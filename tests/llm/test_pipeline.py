"""The pipeline's stages on the small tables: each one's decisions take effect."""

import os

import pytest

pytest.importorskip("loamline.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark):
    from loamline.llm import mixing, near_dedup, pii, quality
    from loamline.llm.common import stash, table

    docs = table(spark, DATA, "documents")
    seen = {"documents": docs.toPandas()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, DATA))
        seen[name] = docs.toPandas()
        if name != "packing":
            assert list(docs.columns) == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = table(spark, DATA, "labels")
    scores = quality.score(table(spark, DATA, "documents"), labels).toPandas()
    assert set(seen["quality"].doc_id) == set(scores[scores.predicted == 1].doc_id)
    before = spark.createDataFrame(seen["quality"])
    classes = near_dedup.near_duplicates(before).toPandas()
    assert sorted(seen["near"].doc_id) == sorted(set(classes.class_id))
    assert sorted(seen["pii"].doc_id) == sorted(seen["near"].doc_id)
    assert not any(pii.base_spans(t) for t in seen["pii"].text)
    copies = mixing.mix(spark.createDataFrame(seen["pii"])).toPandas().set_index("doc_id").copies
    assert seen["mixing"].doc_id.value_counts().to_dict() == copies[copies > 0].to_dict()
    assert seen["packing"].length.sum() == seen["mixing"].text.map(lambda t: len(t.encode().split())).sum()


def test_run_and_odd_rows(spark, tmp_path):
    docs = table_with_odd_rows(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs = docs.cache()
        docs.count()
        docs = stage(spark, docs, DATA)
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, DATA).count() > 0


def table_with_odd_rows(spark):
    from loamline.llm.common import table

    docs = table(spark, DATA, "documents")
    odd = spark.createDataFrame([(None, "no id " * 30, None, None, None), (None, None, "en", "src0", None), (3, "", "en", None, 0)], docs.schema)
    return docs.union(odd).union(docs.limit(5))
