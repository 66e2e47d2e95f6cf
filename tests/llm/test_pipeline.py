"""The stages in order, on whole small tables."""

import corpus_pipeline
from kerbside.llm.language import identify
from kerbside.llm.ngram_join import join_components

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "secrets", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == columns
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert kept.count() <= before
        if name == "language":
            assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} <= {
                r.doc_id for r in identify(docs).collect() if r.lang_pred == "und" or r.score < 0.15}
        if name == "near_duplicates":
            assert kept.count() == join_components(docs, 5, 80).select("component_id").distinct().count()
        if name == "secrets":
            assert kept.count() == docs.count()
            assert not any("token = \"" in r.text for r in kept.collect())
        docs, before = kept, kept.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100
