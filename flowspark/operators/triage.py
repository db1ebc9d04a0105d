"""Triage of flows: skip rules, stage-1 decision, outcome per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.functions.responses import normalise_response, parse, stage1_decision

RESULT_COLUMNS = (
    "attack_type", "severity", "confidence", "mitre_techniques", "explanation", "recommendations",
    "record_description", "retrieved_context_titles", "rag_distances", "elapsed_seconds", "model_name",
    "ground_truth", "raw_llm_response", "validation_errors", "stage1_decision", "stage_skipped",
)
ANSWER_COLUMNS = (
    "attack_type", "severity", "confidence", "mitre_techniques", "explanation", "recommendations", "validation_errors",
)


def confident_benign(threshold: float = 0.95) -> Column:
    """Rows the forest settles alone."""
    return F.coalesce((F.col("rf_label") == "Benign") & (F.col("rf_confidence") >= threshold), F.lit(False))


def with_route(df: DataFrame, use_rf: bool | Column = True, two_stage: bool | Column = True,
               threshold: float = 0.95) -> DataFrame:
    """Add ``stage1`` and ``route``: rf, stage1 or open, the first one that applies.

    The switches may be columns, so that one job serves many configurations.
    """
    rf_on, stage_on = [s if isinstance(s, Column) else F.lit(s) for s in (use_rf, two_stage)]
    settled = rf_on & confident_benign(threshold)
    stage1 = F.when(stage_on & ~settled, stage1_decision(F.col("stage1_response")))
    return df.withColumn("stage1", stage1).withColumn(
        "route", F.when(settled, "rf").when(F.col("stage1") == "BENIGN", "stage1").otherwise("open"))


def outcomes(df: DataFrame, use_rf: bool | Column = True, two_stage: bool | Column = True, threshold: float = 0.95,
             keep: tuple[str, ...] = ()) -> DataFrame:
    """One 16-field result per record, in a single projection.

    Input columns: record_key, description, label, elapsed_seconds, model_name, rf_label,
    rf_confidence, stage1_response (null: the call failed), response, response_error,
    context_titles, context_distances.

    Priority: forest skip, stage-1 skip, model error, unparseable answer, normal answer.  Only
    answers of open records are parsed.
    """
    routed = with_route(df, use_rf, two_stage, threshold)
    answered = (F.col("route") == "open") & F.col("response_error").isNull()
    parsed = normalise_response(parse(routed.withColumn("_asked", F.when(answered, F.col("response"))), "_asked"))
    state = (
        F.when(F.col("route") != "open", F.col("route"))
        .when(F.col("response_error").isNotNull(), "error")
        .when(~F.col("fields.parsed"), "unparsed")
        .otherwise("answer")
    )
    staged = parsed.withColumn("_state", state)
    failure = F.when(F.col("_state") == "error", F.concat(F.lit(D.ERROR_MODEL_PREFIX), F.col("response_error"))).otherwise(
        D.ERROR_NOT_JSON)
    skipped = F.col("_state").isin("rf", "stage1")
    no_texts, no_numbers = F.array().cast("array<string>"), F.array().cast("array<double>")
    skip_values = {
        "attack_type": F.lit("Benign"), "severity": F.lit("informational"),
        "confidence": F.when(F.col("_state") == "rf", F.col("rf_confidence")).otherwise(0.75),
        "mitre_techniques": no_texts, "recommendations": no_texts, "validation_errors": no_texts,
        "explanation": F.when(F.col("_state") == "rf", D.SKIP_TEXT["rf_prefilter"]).otherwise(D.SKIP_TEXT["stage1_benign"]),
    }
    failed_values = {
        "attack_type": F.lit(D.UNKNOWN), "severity": F.lit("informational"), "confidence": F.lit(0.0),
        "mitre_techniques": no_texts, "recommendations": no_texts, "validation_errors": F.array(failure),
        "explanation": F.concat(F.lit(D.ERROR_TEXT_PREFIX), failure),
    }
    values = {
        c: F.when(skipped, skip_values[c]).when(F.col("_state") == "answer", F.col(f"normalised.{c}")).otherwise(failed_values[c])
        for c in ANSWER_COLUMNS
    }
    values.update({
        "record_description": F.col("description"),
        "retrieved_context_titles": F.when(skipped, no_texts).otherwise(F.col("context_titles")),
        "rag_distances": F.when(skipped, no_numbers).otherwise(F.col("context_distances")),
        "elapsed_seconds": F.round("elapsed_seconds", 2),
        "model_name": F.col("model_name"),
        "ground_truth": F.col("label"),
        "raw_llm_response": F.when(F.col("_state").isin("answer", "unparsed"), F.coalesce("response", F.lit(""))).otherwise(""),
        "stage1_decision": F.col("stage1"),
        "stage_skipped": F.when(F.col("_state") == "rf", "rf_prefilter").when(F.col("_state") == "stage1", "stage1_benign"),
    })
    return staged.select("record_key", *keep, *[values[c].alias(c) for c in RESULT_COLUMNS])
