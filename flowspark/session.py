"""Session helpers: local sessions for tests, and the shared folder for written intermediates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


# Description and outcome expressions are wide.  As one fused method they outgrow what the JIT
# compiles (8,000 bytes of bytecode) and run interpreted; below this limit Spark splits them.
SETTINGS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def use_settings(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "flowspark") -> SparkSession:
    return use_settings(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # records the call site of every expression
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which every executor can reach.

    The setting is the cluster's; where it is unset, the session's warehouse is used, never a
    machine-local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Cut lineage by writing a table to the shared folder and reading it back.

    Used before iterative jobs, so that a lost executor costs a re-read, not a recompute.
    """
    target = folder or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)
