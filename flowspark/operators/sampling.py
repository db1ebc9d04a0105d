"""Exact, repeatable sampling in hash order.

The first n rows by hash of a key are found without sorting a class in one task: counts per
hash bucket give the bucket in which a class reaches its quota, all rows of lower buckets are
taken as they are, and only that one bucket is ranked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.operators.bounded import small_side


def hash_order(key: str, seed: int = D.DEFAULT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary"))


def flag_first(df: DataFrame, quota: Callable[[Column], Column], key: str, flag: str = "picked",
               seed: int = D.DEFAULT_SEED, strata: tuple[str, ...] = (), digits: int = 4, whole_input: bool = True) -> DataFrame:
    """Add a boolean that marks, per stratum, the first ``quota`` rows in hash order.

    ``quota(rows_of_stratum)`` gives the wanted count.  Rows with a null stratum belong to no
    stratum and are left out.  Without ``whole_input`` rows of higher buckets are, too.
    """
    whole = "_all"
    groups = list(strata) or [whole]
    hashed = df.withColumn("_h", hash_order(key, seed))
    hashed = hashed.withColumn("_bucket", F.substring("_h", 1, digits))
    if not strata:
        hashed = hashed.withColumn(whole, F.lit(1))
    for column in strata:
        hashed = hashed.filter(F.col(column).isNotNull())

    counts = hashed.groupBy(*groups, "_bucket").agg(F.count("*").alias("_m"))
    by_group = Window.partitionBy(*groups)
    upto = F.sum("_m").over(by_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    running = counts.select(
        *groups, "_bucket", F.sum("_m").over(by_group).alias("_total"), (upto - F.col("_m")).alias("_before"))
    wanted = quota(F.col("_total")).cast("bigint")
    edge_of = F.max_by(F.struct("_bucket", (wanted - F.col("_before")).alias("_need")),
                       F.when(F.col("_before") < wanted, F.col("_bucket")))
    limits = running.groupBy(*groups).agg(edge_of.alias("_e")).select(
        *groups, F.coalesce("_e._bucket", F.lit("")).alias("_edge"), F.coalesce("_e._need", F.lit(0)).alias("_need"))
    if strata:
        joined = hashed.join(small_side(limits), groups)
    else:
        only = limits.first()
        joined = hashed.withColumns({"_edge": F.lit(only["_edge"] if only else ""), "_need": F.lit(only["_need"] if only else 0)})
    others = F.col("_bucket") != F.col("_edge") if whole_input else F.col("_bucket") < F.col("_edge")  # one hash of a row, not two
    sure = joined.filter(others).withColumn(flag, F.col("_bucket") < F.col("_edge") if whole_input else F.lit(True))
    rank = F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy("_h", key))
    edge = joined.filter(F.col("_bucket") == F.col("_edge")).withColumn(flag, rank <= F.col("_need"))
    return sure.unionByName(edge).select(*[F.col(f"`{c}`") for c in df.columns], flag)


def _picked(flagged: DataFrame) -> DataFrame:
    return flagged.filter("picked").drop("picked")


def sample_n(df: DataFrame, n: int, key: str, seed: int = D.DEFAULT_SEED) -> DataFrame:
    """Exactly min(n, rows) rows."""
    return _picked(flag_first(df, lambda rows: F.lit(n), key, seed=seed, whole_input=False))


def count_classes(df: DataFrame, label: str = "label") -> int:
    return df.agg(F.count_distinct(label)).first()[0]


def stratified_sample(df: DataFrame, n: int, key: str, label: str = "label", seed: int = D.DEFAULT_SEED,
                      classes: int | None = None) -> DataFrame:
    """At most max(1, n // classes) rows of each class; classes are counted unless given."""
    classes = count_classes(df, label) if classes is None else classes
    per_class = max(1, n // max(1, classes))
    return _picked(flag_first(df, lambda rows: F.lit(per_class), key, seed=seed, strata=(label,)))


def presample(df: DataFrame, n: int, key: str, source: str = "dataset_source", seed: int = D.DEFAULT_SEED,
              factor: int = 50) -> DataFrame:
    """``factor * n`` rows of each dataset, so that rare classes survive into a small sample."""
    return _picked(flag_first(df, lambda rows: F.lit(n * factor), key, seed=seed, strata=(source,)))


def select_records(df: DataFrame, n: int, key: str, stratified: bool = False, seed: int = D.DEFAULT_SEED) -> DataFrame:
    if stratified and "label" in df.columns:
        return stratified_sample(df, n, key, seed=seed)
    return sample_n(df, n, key, seed=seed)


def fraction_sample(df: DataFrame, fraction: float, key: str, seed: int = D.DEFAULT_SEED) -> DataFrame:
    """A fixed share of rows by hash threshold: no count, no shuffle, same rows every time."""
    position = F.conv(F.substring(hash_order(key, seed), 1, 7), 16, 10).cast("double") / F.lit(float(16**7))
    return df.filter(position < fraction)


def train_test_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2,
                     seed: int = D.DEFAULT_SEED) -> DataFrame:
    """Add ``is_test``: the wanted share of every class, to the nearest row."""
    return flag_first(df, lambda rows: F.floor(rows * test_fraction + 0.5), key, flag="is_test", seed=seed, strata=(label,))


def record_at(df: DataFrame, key: str, value: int) -> DataFrame:
    """One record by its stable key, never by physical position."""
    found = df.filter(F.col(key) == value)
    if found.isEmpty():
        raise ValueError(f"no record with {key} = {value}")
    return found
