"""Triage runs on storage: partitioned results, run summaries, incremental index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.evaluation import metrics

RUN_FLAGS = ("use_rag", "rerank", "two_stage", "use_rf", "stratified", "n")
SUMMARY_SCHEMA = (
    "n_records bigint, n_valid bigint, avg_elapsed_seconds double, accuracy_exact double, accuracy_binary double, "
    "precision double, recall double, confusion struct<tp bigint, tn bigint, fp bigint, fn bigint>"
)


def write_results(results: DataFrame, path: str, flags: tuple[str, ...] = ("config",)) -> None:
    """Results as a table partitioned by the run's attributes; records are never gathered into one document."""
    results.write.mode("append").partitionBy(*flags).parquet(path)


def write_summary(results: DataFrame, path: str) -> None:
    """Figures of one run as a small JSON document next to its results."""
    confusion = F.struct("tp", "tn", "fp", "fn").alias("confusion")
    figures = metrics(results).select(
        "n_records", "n_valid", "avg_elapsed_seconds", "accuracy_exact", "accuracy_binary", "precision", "recall", confusion)
    figures.write.mode("overwrite").json(path)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Summary documents of many runs, one row each, with the attributes their folder names carry."""
    raw = spark.read.schema(SUMMARY_SCHEMA).option("multiLine", True).json(pattern)
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"/(run_[^/]+)/", 1)
    tags = F.split(folder, "_")
    return raw.select(
        "*", folder.alias("run_dir"),
        F.array_contains(tags, "rag").alias("use_rag"), F.array_contains(tags, "rerank").alias("rerank"),
        F.array_contains(tags, "2stage").alias("two_stage"), F.array_contains(tags, "rf").alias("use_rf"),
        F.array_contains(tags, "stratified").alias("stratified"),
        F.regexp_extract(folder, r"_n(\d+)$", 1).try_cast("int").alias("n"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )


def append_summary(runs: DataFrame, path: str) -> None:
    runs.write.mode("append").parquet(path)
