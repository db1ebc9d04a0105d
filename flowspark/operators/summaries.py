"""Counts and distributions over whole tables.  All aggregates combine map-side first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.operators.cleaning import name, numeric_columns


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share of every label, most frequent first."""
    counts = df.groupBy(name(label).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / total, 4)).orderBy(F.desc("n"), "label")


def source_label_rollup(df: DataFrame, source: str = "dataset_source", label: str = "label") -> DataFrame:
    """Counts per source and label with a subtotal per source and a grand total."""
    return df.rollup(source, label).agg(
        F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


def dataset_report(df: DataFrame) -> DataFrame:
    """One row: records, columns, numeric features, label counts and column names."""
    counts = df.groupBy("label").agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct("label", "n")))
    return counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(len(numeric_columns(df, exclude=()))).alias("numeric_features"),
        F.map_from_entries(pairs).alias("label_distribution"),
        F.array(*[F.lit(c) for c in df.columns]).alias("column_names"),
    )


def unmapped_labels(df: DataFrame) -> DataFrame:
    """Distinct original labels that no map knows, with their counts."""
    return (
        df.filter(F.col("label") == D.UNKNOWN).groupBy("dataset_source", "label_original")
        .agg(F.count("*").alias("n"))
    )


def schema_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """Shared, left-only and right-only column names; only the shared set leaves out metadata."""
    spark = left.sparkSession
    a = spark.createDataFrame([(c,) for c in left.columns], "column_name string")
    b = spark.createDataFrame([(c,) for c in right.columns], "column_name string")
    meta = spark.createDataFrame([(c,) for c in D.META_COLS], "column_name string")
    parts = [
        ("shared", a.intersect(b).exceptAll(meta)),
        ("left_only", a.exceptAll(b)),
        ("right_only", b.exceptAll(a)),
    ]
    tagged = [names.withColumn("side", F.lit(side)) for side, names in parts]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def corpus_counts(documents: DataFrame, source: str = "source") -> DataFrame:
    """Documents per source and in total (null source)."""
    return documents.rollup(source).agg(F.count("*").alias("n_documents"))
