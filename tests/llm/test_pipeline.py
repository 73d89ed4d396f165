"""The five stages, one after another."""

from __future__ import annotations


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from weftline.llm.scratch import Scratch

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    scratch = Scratch(spark, "test")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        new = scratch.save(stage(spark, docs, sf_dir), str(k))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == docs.columns, name
            assert new.join(docs, "doc_id", "left_anti").count() == 0 and new.count() <= docs.count(), name
            before, docs = docs, new
    assert before is not None and new.select("doc_id").distinct().count() == docs.count()
