"""Small sides of joins: broadcast only when a size check passes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 100_000


def small_side(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast side if it has at most ``max_rows`` narrow rows, else ``df`` itself.

    One job computes the side and checks its size; a larger side stays a distributed table
    and joins by shuffle, with adaptive skew handling.
    """
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def dimension(spark, rows, schema: str) -> DataFrame:
    """A fixed lookup table written in the code; its size is known, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, dealt to all cores before costly work on its rows; others as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores else df.repartition(cores)
