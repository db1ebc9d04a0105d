"""Job 4: every configuration over the same samples, scored and ranked in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.operators.bottom_k import stratified_samples
from flowspark.operators.bounded import small_side
from flowspark.operators.evaluation import expand_grid, metrics
from flowspark.operators.triage import outcomes


def evaluate(records: DataFrame, sizes: tuple[int, ...], seeds: tuple[int, ...], key: str = "record_key",
             configs=D.CONFIG_GRID) -> DataFrame:
    """Metrics of every (config, n, seed).

    ``records`` carries everything ``outcomes`` reads; the flags of a configuration decide which
    of it counts.  One scan of keys and labels samples for all sizes and seeds; the wide records are read once.
    """
    chosen = small_side(stratified_samples(records, sizes, seeds, key))
    grid = expand_grid(records.join(chosen, key), configs)
    results = outcomes(grid, F.col("use_rf"), F.col("two_stage"), keep=("config", "n", "seed"))
    return metrics(results, by=("config", "n", "seed")).withColumnRenamed("avg_elapsed_seconds", "avg_elapsed")
