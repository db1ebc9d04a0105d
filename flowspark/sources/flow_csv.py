"""CSV scans of the two raw flow datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowspark import domains as D
from flowspark.operators.cleaning import drop_columns
from flowspark.sources.raw_csv import read_raw
from flowspark.sources.tables import union_all


CIC_TEXT = {c.lower() for c in D.CIC_IDENTIFIERS} | {"label"}
UNSW_TEXT = {"srcip", "sport", "dstip", "dsport", "proto", "service", "state", "attack_cat", "attack_category", "ct_ftp_cmd"}


def read_cic(spark: SparkSession, pattern: str) -> DataFrame:
    """All day files of the first dataset: header names trimmed, files with other headers unioned by name."""
    return read_raw(spark, pattern, lambda c: "string" if c.lower() in CIC_TEXT else "double")


def read_unsw(spark: SparkSession, train: str, test: str) -> DataFrame:
    """Training and testing files with headers, without their row number; text in numeric columns becomes null."""
    return union_all([drop_columns(read_raw(spark, path, _unsw_type), ["id"]) for path in (train, test)])


def _unsw_type(column: str) -> str:
    """Columns that are numeric by name are numbers; text and mixed ones stay text."""
    return "string" if column.lower() in UNSW_TEXT else "double"


def read_unsw_numbered(spark: SparkSession, pattern: str, features: str | None = None) -> DataFrame:
    """Header-less files; names come from the ``Name`` column of the features file when the counts agree."""
    if features is None:
        return read_raw(spark, pattern, header=False)
    listed = [r["Name"].strip() for r in read_raw(spark, features).select("Name").collect()]
    named = {len(listed): listed}
    return read_raw(
        spark, pattern, lambda c: "string" if c.startswith("_c") else _unsw_type(c), header=False,
        names=lambda n: named.get(n) or [f"_c{i}" for i in range(n)])


# Spellings of the training files -> spellings the describers read.
UNSW_NAMES = {
    "spkts": "Spkts", "dpkts": "Dpkts", "sload": "Sload", "dload": "Dload", "smean": "smeansz", "dmean": "dmeansz",
}


def describer_names(df: DataFrame) -> DataFrame:
    """Give columns of the training files the names the describers know."""
    return df.toDF(*[UNSW_NAMES.get(c, c) for c in df.columns])
