"""Connected components of a distributed edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import narrow, stored

_MAX_ROUNDS = 60


def _star(edges: DataFrame, key: str, other: str) -> DataFrame:
    """Each ``other`` of a key is linked to the key's smallest neighbour.

    The minimum is a combining aggregate and the join has one row per key on that side, so a hub
    with very many neighbours is spread over tasks.
    """
    low = edges.groupBy(key).agg(F.min(other).alias("low"))
    return edges.join(low, key)


def _settled(edges: DataFrame, rows: int) -> bool:
    """Whether only stars are left: each ``u`` has one ``v``, and no ``v`` is a ``u``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    sides = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.count("*").alias("links"))
    return narrow(sides, rows).where("ups > 0 AND links > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges(a, b)``: component is the smallest node reachable.

    Each round is written to the shared folder; only a count and whether it was the last come to the driver.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows = now.count()  # no round makes more
    for _ in range(_MAX_ROUNDS):
        if _settled(now, rows):
            break
        # large star: every larger neighbour of u goes to u's smallest neighbour (or u itself)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.least("u", "low").alias("v"))
        # small star: u and its smaller neighbours go to the smallest of them
        small = _star(narrow(narrow(large, rows).distinct(), rows), "u", "v")
        moved = small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v")).union(small.select("u", F.col("low").alias("v")))
        now = stored(narrow(narrow(moved, rows).distinct(), rows))
    else:
        raise RuntimeError(f"components did not settle in {_MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
