from pyspark.sql import functions as F

import corpus_pipeline
from bomlens.llm import jaccard, quality
from bomlens.llm.common import table

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = corpus_pipeline.keep_quality(spark, docs, SF)
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, table(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in good.collect()} == {k for k, s in scores.items() if s >= quality.THRESHOLD}
    single = corpus_pipeline.drop_near_duplicates(spark, good, SF)
    groups = jaccard.jaccard_components(good).filter("component_id = doc_id")
    assert {r["doc_id"] for r in single.collect()} == {r["doc_id"] for r in groups.collect()}
    clean = corpus_pipeline.drop_benchmark(spark, single, SF)
    items = [r["text"] for r in table(spark, SF, "benchmark").collect()]
    kept = {r["doc_id"] for r in clean.collect()}
    assert kept == {r["doc_id"] for r in single.collect() if not any(i in r["text"] for i in items)}
    masked = corpus_pipeline.mask_secrets(spark, clean, SF)
    assert masked.columns == clean.columns == single.columns == good.columns == columns
    changed = [r["doc_id"] for r in masked.collect() if r["text"] != rows[r["doc_id"]]]
    assert masked.count() == len(kept) and masked.filter(F.length("text") != F.col("n_chars")).count() == 0 and len(changed) < len(kept) / 2
    assert {r["doc_id"] for r in corpus_pipeline.encode_pieces(spark, masked, SF).collect()} == kept
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard", "decontamination", "secret_scan", "sentencepiece"]


def test_pipeline_of_odd_rows(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, "s", None), (10**9, "x " * 20_000, "en", "s", 40_000)], docs.schema)
    given = docs.limit(40).unionByName(odd).unionByName(odd).withColumn("_mark", F.lit("m")).withColumn("_base", F.lit(1))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, given, SF)
        assert out.dtypes == given.dtypes, name
        assert 0 < out.count() <= given.count(), name
        empty = stage(spark, given.filter("false"), SF)
        assert empty.columns == given.columns and empty.count() == 0, name
    assert corpus_pipeline.encode_pieces(spark, given, SF).count() == given.count()
    assert corpus_pipeline.encode_pieces(spark, given.filter("false"), SF).count() == 0
