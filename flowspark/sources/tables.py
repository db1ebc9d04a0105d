"""Reading and writing of flow tables, scaling parameters and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.operators.cleaning import range_table
from flowspark.operators.summaries import dataset_report

SOURCE_OF = {"cic": D.CIC, "unsw": D.UNSW}


def read_clean(spark: SparkSession, paths: dict[str, str], choice: str = "unified") -> DataFrame:
    """Raw-valued clean tables: one dataset, or both with absent columns null."""
    wanted = list(paths) if choice == "unified" else [choice]
    missing = [c for c in wanted if c not in paths]
    if missing:
        raise ValueError(f"no table for dataset {missing}")
    return union_all([spark.read.parquet(paths[c]) for c in wanted])


def union_all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_clean(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_unified(df: DataFrame, path: str) -> None:
    """One folder per dataset, so that a filter on the dataset reads only its files."""
    df.write.mode("overwrite").partitionBy("dataset_source").parquet(path)


def write_ranges(df: DataFrame, columns: list[str], path: str) -> None:
    range_table(df, columns).write.mode("overwrite").json(path)


def read_ranges(spark: SparkSession, path: str) -> dict[str, dict[str, float]]:
    rows = spark.read.schema("column_name string, min_value double, max_value double").json(path).collect()
    return {r["column_name"]: {"min": r["min_value"], "max": r["max_value"]} for r in rows}


def write_report(df: DataFrame, path: str, elapsed_seconds: float | None = None) -> None:
    report = dataset_report(df).withColumns({
        "timestamp": F.current_timestamp(), "elapsed_seconds": F.lit(elapsed_seconds).cast("double")})
    report.write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)
