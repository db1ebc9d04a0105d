"""Table helpers of the operators: columns to carry along, and running sums that no single task has to hold."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, taken: Iterable[str]) -> list[Column]:
    """The columns of ``df`` whose names, in any case, are not ``taken``."""
    taken = {t.lower() for t in taken}
    return [named(c) for c in df.columns if c.lower() not in taken]


def running(df: DataFrame, groups: list[str], bucket: str, order: list[str | Column], value: str, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of its group that come before, by (bucket, order).

    Buckets are summed first, so a task sorts the rows of one bucket or the buckets of one group, never
    the rows of a group.  Callers choose ``bucket`` such that both stay small.
    """
    sums = df.groupBy(*groups, bucket).agg(F.sum(value).alias("sum "))
    starts = sums.select(*groups, bucket, (F.sum("sum ").over(Window.partitionBy(*groups).orderBy(bucket)) - F.col("sum ")).alias("start "))
    inside = F.sum(value).over(Window.partitionBy(*groups, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    same = [*groups, bucket]
    return df.withColumn("inside ", inside).join(starts, same).withColumn(out, F.col("start ") + F.col("inside ")).drop("start ", "inside ")
