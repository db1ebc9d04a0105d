"""Each stage of the pipeline on its own input, and the whole run."""

import corpus_pipeline as pipeline


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = pipeline.quality_rules(spark, docs, folder).cache()
    ids = {r.doc_id for r in kept.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert kept.columns == docs.columns and sum(i in ids for i in good) >= 0.9 * len(good)
    unique = pipeline.near_duplicates(spark, kept, folder).cache()
    assert unique.columns == docs.columns and {r.doc_id for r in unique.collect()} <= ids
    assert pipeline.near_duplicates(spark, unique, folder).count() == unique.count() == unique.select("doc_id").distinct().count()
    clean = pipeline.secrets(spark, unique, folder).cache()
    assert clean.count() == unique.count() and clean.where("n_chars <> length(text)").count() == 0
    mix = pipeline.mixture(spark, clean, folder).cache()
    assert mix.columns == docs.columns and mix.groupBy("doc_id").count().where("count > 2").count() == 0
    final = pipeline.tokens(spark, mix, folder)
    assert final.count() == mix.count() and final.where("n_tokens <> size(ids)").count() == 0
