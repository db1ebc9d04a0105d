"""A training corpus from the raw documents, in stages; each stage works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import bpe, mixing, ngram_join, quality, secret_scan
from flowspark.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that fail a base rule or the likelihood ratio go."""
    return quality.judged(docs, table(spark, folder, "labels")).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each group of linked documents (five words, 0.8) the one with the smallest doc_id stays; rows without doc_id all stay."""
    groups = ngram_join.joined(docs.select("doc_id", "text"), ngram_join.Rule(5, 80, 100))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    known = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi").withColumn("same", F.xxhash64("text"))
    return known.dropDuplicates(["doc_id", "same"]).select(*COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Secrets and linked parts of credentials are masked; every document stays."""
    found = secret_scan.redacted(secret_scan.scanned(docs.select(*COLUMNS), text=True))
    return found.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice; those it does not take go."""
    return mixing.repeated(mixing.mixed(docs.select(*COLUMNS), text=True)).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Token ids of each document, with the digests of ids and of the decoded text."""
    encoded = bpe.encoded(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("word_bpe_49k.json"), real=True)
    return encoded.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

# Hashed likelihood ratios, the set join and byte-pair merges have no SQL; tests/llm compares most operators with brute force, the stages only by subsets and counts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; every stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
