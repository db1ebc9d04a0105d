"""Data-dependent column reduction: constant and highly correlated features."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.cleaning import comparable, drop_columns, name, numeric_columns


def constant_columns(df: DataFrame, columns: list[str] | None = None) -> list[str]:
    """Columns with at most one distinct finite value, by their range: no distinct count needed."""
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return []
    narrow = comparable(df, columns)
    row = narrow.agg(*[F.coalesce(F.min(x) == F.max(x), F.lit(True)) for x in narrow.columns]).first()
    return [c for i, c in enumerate(columns) if row[i]]


def remove_constant(df: DataFrame) -> DataFrame:
    return drop_columns(df, constant_columns(df))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson r of every column pair (earlier, later), over rows where both are present.

    Each task folds its rows into pair moments with matrix products, by one formula for any number
    of columns.  Only one small row per pair and task is shuffled.  Values are shifted by the
    column means first, which keeps the sums well conditioned.
    """
    narrow = comparable(df, columns)
    means = narrow.agg(*[F.avg(x) for x in narrow.columns]).first()
    width = len(columns)
    values = narrow.select(*[(F.col(x) - F.lit(m or 0.0)).alias(x) for x, m in zip(narrow.columns, means)])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        sums = {k: np.zeros((width, width)) for k in ("n", "sa", "saa", "sab")}
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            seen = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            sums["n"] += seen.T @ seen
            sums["sa"] += x.T @ seen
            sums["saa"] += (x * x).T @ seen
            sums["sab"] += x.T @ x
        a, b = np.triu_indices(width, 1)
        yield pd.DataFrame({
            "pos_a": a, "pos_b": b, "n": sums["n"][a, b],
            "sa": sums["sa"][a, b], "sb": sums["sa"][b, a],
            "saa": sums["saa"][a, b], "sbb": sums["saa"][b, a], "sab": sums["sab"][a, b],
        })

    folded = values.mapInPandas(
        fold, "pos_a int, pos_b int, n double, sa double, sb double, saa double, sbb double, sab double")
    total = folded.groupBy("pos_a", "pos_b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "saa", "sbb", "sab")])
    var_a = F.col("n") * F.col("saa") - F.col("sa") * F.col("sa")
    var_b = F.col("n") * F.col("sbb") - F.col("sb") * F.col("sb")
    r = F.when((var_a > 0) & (var_b > 0),
               (F.col("n") * F.col("sab") - F.col("sa") * F.col("sb")) / F.sqrt(var_a) / F.sqrt(var_b))
    names = F.array(*[F.lit(c) for c in columns])
    return total.select(names[F.col("pos_a")].alias("col_a"), names[F.col("pos_b")].alias("col_b"), "pos_a", "pos_b", r.alias("r"))


def correlated_columns(df: DataFrame, columns: list[str] | None = None, threshold: float = 0.95) -> DataFrame:
    """Columns to drop: any earlier column, dropped itself or not, has |r| above the threshold."""
    columns = numeric_columns(df) if columns is None else columns
    strength = F.max(F.when(~F.isnan("r"), F.abs("r")))
    return (
        correlations(df, columns).groupBy("col_b", "pos_b").agg(strength.alias("max_abs_r"))
        .filter(F.col("max_abs_r") > threshold)
        .select(F.col("col_b").alias("column_name"), F.col("pos_b").alias("position"), "max_abs_r")
    )


def remove_correlated(df: DataFrame, threshold: float = 0.95) -> DataFrame:
    columns = numeric_columns(df)
    if len(columns) < 2:
        return df
    unwanted = [r["column_name"] for r in correlated_columns(df, columns, threshold).collect()]
    return drop_columns(df, unwanted)


def kept_columns(df: DataFrame, reduced: DataFrame) -> DataFrame:
    """Which columns survive, as a stored artifact that new data can be selected by."""
    kept = set(reduced.columns)
    rows = [(i, c, c in kept) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "position int, column_name string, kept boolean")


def apply_columns(df: DataFrame, artifact: DataFrame) -> DataFrame:
    wanted = [r["column_name"] for r in artifact.filter("kept").orderBy("position").collect()]
    present = set(df.columns)
    return df.select(*[name(c) for c in wanted if c in present])
