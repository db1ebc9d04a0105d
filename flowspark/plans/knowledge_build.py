"""Job 2: knowledge sources to an embedded, searchable corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.operators.retrieval import apply_embedder, bm25_scorer, embed_texts, retrieve
from flowspark.operators.summaries import corpus_counts
from flowspark.sources import knowledge as K


def documents(spark: SparkSession, stix: str | None = None, rules: str | None = None) -> DataFrame:
    """Union of the sources that are present; the curated notes always are."""
    parts = [K.class_notes(spark)]
    if stix is not None:
        parts.append(K.technique_documents(K.read_stix(spark, stix)))
    if rules is not None:
        parts.append(K.rule_documents(K.read_rules(spark, rules)))
    return K.corpus(*parts)


def build(corpus: DataFrame, target: str, dimension: int = 384):
    """Embed the corpus and write the collection.  Returns (embedder, collection, counts per source)."""
    model = embed_texts(corpus, dimension)
    apply_embedder(model, corpus).write.mode("overwrite").parquet(target)
    collection = corpus.sparkSession.read.parquet(target)
    return model, collection, corpus_counts(collection)


def suite(model, collection: DataFrame, queries: DataFrame, top_k: int = 3, rerank: bool = True) -> DataFrame:
    """All test queries (query_id, query_text) against the collection in one job."""
    embedded = apply_embedder(model, queries, "query_text", "query_embedding")
    scorer = bm25_scorer(embedded, collection) if rerank else None
    hits = retrieve(embedded, collection, top_k=top_k, scorer=scorer)
    return hits.join(collection.select("id", "title", "source"), "id").select(
        "query_id", "rank", "id", "title", "source", F.round("distance", 6).alias("distance"))


def suite_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(D.SUITE_QUERIES, 1)), "query_id int, query_text string")
