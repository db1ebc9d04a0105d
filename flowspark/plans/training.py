"""Job 2.5: one Random Forest per dataset, models and metrics on storage."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.operators.classifier import load_model, save_model, train_dataset
from flowspark.operators.forest import Forest
from flowspark.sources.tables import write_metrics


def train_all(df: DataFrame, key: str, sources: tuple[str, ...], sample_size: int | None = 200_000,
              target: str | None = None, **forest) -> tuple[dict[str, Forest], DataFrame | None]:
    """Train every dataset that has rows; absent ones are skipped."""
    parts = {source: df.filter(F.col("dataset_source") == source) for source in sources}
    present = [source for source in sources if not parts[source].isEmpty()]

    def train(source: str) -> tuple[Forest, DataFrame]:
        return train_dataset(parts[source], key, sample_size=sample_size, **forest)

    with ThreadPoolExecutor(max(1, len(present))) as pool:  # one job per dataset at a time; Spark shares the cores among them
        trained = dict(zip(present, pool.map(train, present), strict=True))
    models = {source: model for source, (model, _) in trained.items()}
    figures = [metrics.withColumn("dataset", F.lit(source)) for source, (_, metrics) in trained.items()]
    if target is not None:
        for source, model in models.items():
            save_model(model, f"{target}/{source}")
    table = reduce(lambda a, b: a.unionByName(b), figures) if figures else None
    if target is not None and table is not None:
        write_metrics(table, f"{target}/metrics")
    return models, table


def load_all(target: str, sources: tuple[str, ...]) -> dict[str, Forest]:
    return {source: load_model(f"{target}/{source}") for source in sources}
