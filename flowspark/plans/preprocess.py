"""Job 1: raw flow tables to clean, reduced, unified and scaled tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.operators import cleaning as C
from flowspark.operators.reduction import remove_constant, remove_correlated
from flowspark.operators.sampling import fraction_sample
from flowspark.session import shared_folder, written
from flowspark.sources.tables import write_clean, write_metrics, write_ranges, write_unified
from flowspark.operators.summaries import dataset_report, schema_overlap


def preprocess_cic(df: DataFrame, tidy_dashes: bool = False) -> DataFrame:
    """Drop identifiers, tidy numbers, impute exact medians, clip, map labels."""
    df = C.drop_columns(df, D.CIC_IDENTIFIERS)
    raw = C.resolve_column(df, ["Label"])
    if raw is None:
        raise ValueError("no label column found")
    features = C.numeric_columns(df, exclude=(raw,))
    df = C.drop_empty_rows(C.finite_only(df, features), features)
    df = C.clip_negatives(C.impute_medians(df, features), features)
    return C.map_labels(df, raw, D.CIC, tidy_dashes)


def preprocess_unsw(df: DataFrame) -> DataFrame:
    """Drop identifiers, resolve the label, coerce, encode, impute exact medians, map labels.

    The 0/1 label is used only for resolving, never imputed or kept as a feature.
    """
    df = C.drop_columns(df, D.UNSW_IDENTIFIERS)
    category = C.resolve_column(df, ["attack_cat", "Attack_cat", "attack_category"])
    binary = C.resolve_column(df, ["label", "Label"])
    resolved = C.resolve_label(
        None if category is None else C.name(category),
        None if binary is None else C.name(binary).try_cast("int"))
    df = df.withColumn("_resolved", resolved)
    df = C.drop_columns(df, [c for c in (category, binary) if c is not None])
    df = C.coerce_numeric(df, keep=("_resolved", *D.UNSW_CATEGORICALS))
    df = C.encode_categories(df, [c for c in D.UNSW_CATEGORICALS if c in df.columns])
    features = C.numeric_columns(df)
    df = C.impute_medians(C.finite_only(df, features), features)
    return C.map_labels(df, "_resolved", D.UNSW)


def process_dataset(df: DataFrame, clean: Callable[[DataFrame], DataFrame], skip_correlation: bool = False,
                    threshold: float = 0.95, fraction: float | None = None, key: str | None = None) -> DataFrame:
    """Sample, clean and reduce one dataset.

    Which columns survive depends on the data, so the cleaned table is written once and every
    later decision reads it back instead of recomputing the cleaning.
    """
    if fraction is not None and fraction < 1.0:
        df = df.sample(fraction=fraction, seed=D.DEFAULT_SEED) if key is None else fraction_sample(df, fraction, key)
    cleaned = written(clean(df))
    reduced = remove_constant(cleaned)
    return reduced if skip_correlation else remove_correlated(reduced, threshold)


def unified_table(cic: DataFrame, unsw: DataFrame) -> tuple[DataFrame, dict]:
    """Outer union with zeros in the gaps, scaled to [0, 1], and the scaling parameters."""
    both = C.unify(cic, unsw)
    ranges = C.column_ranges(both, C.numeric_columns(both))
    return C.scale(both, ranges), ranges


def run(cic: DataFrame, unsw: DataFrame, target: str, **options) -> dict[str, str]:
    """The whole job; returns the folders of all outputs."""
    import time

    started = time.monotonic()
    clean_cic = process_dataset(cic, preprocess_cic, **options)
    clean_unsw = process_dataset(unsw, preprocess_unsw, **options)
    folders = {k: f"{target}/{k}" for k in ("cic", "unsw", "unified", "ranges", "report", "overlap")}
    write_clean(clean_cic, folders["cic"])
    write_clean(clean_unsw, folders["unsw"])
    both = C.unify(clean_cic, clean_unsw)
    features = C.numeric_columns(both)
    write_ranges(both, features, folders["ranges"])
    scaled = C.scale(both, C.column_ranges(both, features))
    write_unified(scaled, folders["unified"])
    reports = [dataset_report(df).withColumn("dataset", F.lit(tag))
               for tag, df in (("cic", clean_cic), ("unsw", clean_unsw), ("unified", scaled))]
    report = reports[0].unionByName(reports[1]).unionByName(reports[2])
    write_metrics(report.withColumns({
        "timestamp": F.current_timestamp(), "elapsed_seconds": F.lit(round(time.monotonic() - started, 2))}), folders["report"])
    write_metrics(schema_overlap(clean_cic, clean_unsw), folders["overlap"])
    return folders
