"""Job 3: sampled flows to scored triage results, as one chain of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.describe import describe
from flowspark.functions.responses import flow_prompt, stage1_prompt
from flowspark.operators.classifier import score_by_source
from flowspark.operators.retrieval import PairScorer, context_gate, pack_context, retrieve
from flowspark.operators.triage import confident_benign, outcomes
from flowspark.session import written

Embedder = Callable[[DataFrame], DataFrame]


def described(flows: DataFrame, key: str = "flow_id", models: dict | None = None) -> DataFrame:
    """Flows with their description and, with models, the forest's verdict; written once."""
    if models is None:
        df = flows.withColumns({"rf_label": F.lit(None).cast("string"), "rf_confidence": F.lit(None).cast("double")})
    else:
        df = score_by_source(flows, models).drop("rf_benign")
    return written(describe(df, generic_columns=flows.columns).withColumn("record_key", F.col(key)))


def contexts(records: DataFrame, corpus: DataFrame, embed: Embedder, top_k: int = 5, scorer: PairScorer | None = None,
             threshold: float = 0.55, max_tokens: int = 1500) -> DataFrame:
    """Packed context of every record that the forest leaves open, gated by distance.

    Settled records are filtered out before the search.  Equal descriptions are embedded and
    searched once.
    """
    open_records = records.filter(~confident_benign()).select("record_key", "description")
    queries = embed(open_records.select(F.col("description").alias("text")).distinct())
    queries = written(queries.select(
        F.sha2("text", 256).alias("query_id"), F.col("text").alias("query_text"), F.col("embedding").alias("query_embedding")))
    hits = retrieve(queries, corpus, top_k=top_k, scorer=scorer)
    details = hits.join(corpus.select("id", "title", "text", "source"), "id")
    packed = pack_context(details, max_tokens=max_tokens)
    distances = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "distance"))).alias("d"))
    gate = context_gate(hits, queries, threshold)
    per_query = gate.join(packed, "query_id", "left").join(distances, "query_id", "left").select(
        "query_id",
        F.when(F.col("use_context"), F.col("context")).otherwise("").alias("context"),
        F.col("titles").alias("context_titles"), F.transform("d", lambda x: x["distance"]).alias("context_distances"))
    keyed = open_records.select("record_key", F.sha2("description", 256).alias("query_id"))
    return keyed.join(per_query, "query_id").drop("query_id")


def prompts(records: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """Both prompts of every record that still needs an answer, ready for whatever answers them."""
    open_records = records.filter(~confident_benign())
    if context is None:
        joined = open_records.withColumn("context", F.lit(""))
    else:
        joined = open_records.join(context.select("record_key", "context"), "record_key", "left")
    return joined.select(
        "record_key", stage1_prompt(F.col("description")).alias("stage1_prompt"),
        flow_prompt(F.col("description"), F.col("context")).alias("prompt"))


def results(records: DataFrame, answers: DataFrame, context: DataFrame | None = None, use_rf: bool = True,
            two_stage: bool = True) -> DataFrame:
    """Join answers (record_key, stage1_response, response, response_error, elapsed_seconds, model_name)
    and contexts to the records and settle every outcome."""
    joined = records.join(answers, "record_key", "left")
    if context is not None:
        joined = joined.join(context.drop("context"), "record_key", "left")
    else:
        joined = joined.withColumns({
            "context_titles": F.lit(None).cast("array<string>"), "context_distances": F.lit(None).cast("array<double>")})
    filled = joined.withColumns({
        "context_titles": F.coalesce("context_titles", F.array().cast("array<string>")),
        "context_distances": F.coalesce("context_distances", F.array().cast("array<double>")),
        "elapsed_seconds": F.coalesce("elapsed_seconds", F.lit(0.0)),
    })
    return outcomes(filled, use_rf, two_stage)
