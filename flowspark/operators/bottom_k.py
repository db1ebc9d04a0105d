"""Mergeable samples: the first k rows in hash order of every stratum, for many seeds in one scan.

Each task folds its rows into a sketch that holds at most k keys per (stratum, seed); sketches merge by taking the k
smallest again.  So one scan serves all sizes up to k and all seeds, no stratum is sorted or gathered, and what leaves
a task does not grow with its rows.  Rows and ranks are those of ``sampling.flag_first``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.sampling import hash_order

MERGED = 32  # so many sketches are merged by one task before the last merge


def _fold(k: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The k smallest (hash, key) of each (seed, stratum) of a task."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: pd.DataFrame | None = None
        limits = pd.Series(dtype=object)
        for batch in batches:
            if len(limits):  # full strata take smaller hashes only
                index = pd.MultiIndex.from_frame(batch[["seed", "stratum"]])
                bound = limits.reindex(index).to_numpy(dtype=object)
                batch = batch[[b is None or b != b or h <= b for h, b in zip(batch["h"], bound, strict=True)]]
            both = batch if kept is None else pd.concat([kept, batch], ignore_index=True)
            groups = both.sort_values(["h", "key"], kind="stable").groupby(["seed", "stratum"], sort=False)
            kept = groups.head(k)
            full = kept.groupby(["seed", "stratum"], sort=False)["h"].agg(["size", "max"])
            limits = full.loc[full["size"] >= k, "max"]
        if kept is not None:
            yield kept

    return fold


def bottom_k(df: DataFrame, key: str, k: int, seeds: tuple[int, ...], stratum: str) -> DataFrame:
    """(seed, stratum, key, rank): the first ``k`` rows in hash order of each stratum, for each seed; null strata have none."""
    keys = df.where(F.col(stratum).isNotNull())
    orders = F.explode(F.array(*[F.struct(F.lit(s).alias("seed"), hash_order(key, s).alias("h")) for s in seeds])).alias("o")
    rows = keys.select(F.col(stratum).cast("string").alias("stratum"), F.col(key).alias("key"), orders).select("o.seed", "stratum", "o.h", "key")
    schema = T.StructType([*rows.schema.fields])
    sketches = rows.mapInPandas(_fold(k), schema)
    merged = sketches.repartition(max(1, df.sparkSession.sparkContext.defaultParallelism // MERGED), "seed", "stratum").mapInPandas(_fold(k), schema)
    rank = F.row_number().over(Window.partitionBy("seed", "stratum").orderBy("h", "key"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("seed", "stratum", F.col("key").alias(key), "rank")


def stratified_samples(df: DataFrame, sizes: tuple[int, ...], seeds: tuple[int, ...], key: str, label: str = "label") -> DataFrame:
    """(key, n, seed) of ``stratified_sample`` for every size and seed, from one scan of keys and labels."""
    ranked = bottom_k(df.select(key, label), key, max(sizes), seeds, label)
    found = ranked.groupBy("seed").agg(F.count_distinct("stratum").alias("classes"))  # the sketch has every class
    per_class = F.greatest(F.lit(1).cast("bigint"), F.floor(F.col("n") / F.col("classes")))
    sized = ranked.join(F.broadcast(found), "seed").withColumn("n", F.explode(F.array(*map(F.lit, sizes))))
    return sized.where(F.col("rank") <= per_class).select(key, "n", "seed")
