"""Run figures that are kept: later results add to a run's counts and sums, and no earlier result is read again.

Layout: ``path/run=<run>/generation=<g>/batch=<b>`` holds the state of one batch of results.  A batch that is added again replaces
itself; a run that is replaced starts a new generation, and only the newest one counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators.evaluation import STATE, metric_state, metrics_of

COLUMNS = ", ".join(f"{c} {'double' if c == 'elapsed' else 'long'}" for c in STATE)
PARTS = "run string, generation int, batch string"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _generation(spark: SparkSession, path: str, run: str) -> int | None:
    """The newest generation of a run, from the names of its folders."""
    if not _exists(spark, f"{path}/run={run}"):
        return None
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={run}")
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return max((int(n.removeprefix("generation=")) for n in names if n.startswith("generation=")), default=None)


def add_results(results: DataFrame, path: str, run: str, batch: str, by: tuple[str, ...] = ()) -> None:
    """Add a batch of a run's results, by groups of ``by``."""
    generation = _generation(results.sparkSession, path, run) or 0
    metric_state(results, by).write.mode("overwrite").parquet(f"{path}/run={run}/generation={generation}/batch={batch}")


def replace_run(results: DataFrame, path: str, run: str, by: tuple[str, ...] = ()) -> None:
    """These results instead of all that the run had."""
    now = _generation(results.sparkSession, path, run)
    metric_state(results, by).write.mode("overwrite").parquet(f"{path}/run={run}/generation={0 if now is None else now + 1}/batch=all")


def kept_state(spark: SparkSession, path: str, by: DataFrame | str) -> DataFrame:
    """The added-up state of each run and group; ``by`` is the DDL of the grouping columns."""
    rows = spark.read.schema(f"{by}, {COLUMNS}, {PARTS}").option("basePath", path).parquet(path)
    newest = F.broadcast(rows.groupBy("run").agg(F.max("generation").alias("generation")))  # a row per run
    names = [c for c in rows.columns if c not in STATE and c not in ("generation", "batch", "run")]
    return rows.join(newest, ["run", "generation"]).groupBy("run", *names).agg(*[F.sum(c).alias(c) for c in STATE])


def kept_metrics(spark: SparkSession, path: str, by: str) -> DataFrame:
    state = kept_state(spark, path, by)
    return metrics_of(state, tuple(c for c in state.columns if c not in STATE))
