"""Exact medians of a table that grows by parts (days, files), from sketches that are kept.

Every part leaves one KLL sketch and one count per column.  The merged sketches bracket the middle of each column and cut
the bracket into pieces; one filtered pass over the table counts what lies below and in each piece and ranks the values of the
middle piece only.  Adding a part scans that part, and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.operators.cleaning import comparable

ACCURACY = 4096  # items that a sketch keeps; ranks are off by about 0.1%
SLACK = 0.004
PIECES = 64
KEPT = "column_name string, n long, sketch binary"


def sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n, sketch) of every column, from one scan; nulls, NaN and infinite values do not count."""
    narrow = comparable(df, columns)
    values = [F.col(x) for x in narrow.columns]
    found = narrow.agg(*[part for i, v in enumerate(values) for part in (
        F.count(v).alias(f"n{i}"), F.kll_sketch_agg_double(v, F.lit(ACCURACY)).alias(f"s{i}"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch")) for i, c in enumerate(columns)])
    return found.select(F.inline(rows))


def add_part(df: DataFrame, columns: list[str], part: str, path: str) -> None:
    """Keep the sketches of one part; a part that is added again replaces what it had."""
    sketches(df, columns).write.mode("overwrite").parquet(f"{path.rstrip('/')}/part={part}")


def kept_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{KEPT}, part string").parquet(path)


def _brackets(spark: SparkSession, path: str, slacks: dict[str, float]) -> dict[str, tuple[int, list[float]]]:
    """(rows, ends of the pieces) of every column: the quantiles around the middle."""
    merged = kept_parts(spark, path).where(F.col("n") > 0).groupBy("column_name").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(ACCURACY)).alias("sketch"))
    ends: Column | None = None
    for column, slack in slacks.items():
        points = F.array(*[F.lit(min(1.0, max(0.0, 0.5 + slack * (2 * i / PIECES - 1)))) for i in range(PIECES + 1)])
        own = F.col("column_name") == column
        found = F.kll_sketch_get_quantile_double("sketch", points)
        ends = F.when(own, found) if ends is None else ends.when(own, found)
    rows = merged.select("column_name", "n", ends.alias("ends")).where("ends IS NOT NULL").collect()
    return {r["column_name"]: (r["n"], r["ends"]) for r in rows}


def _middle(df: DataFrame, columns: list[str], brackets: dict[str, tuple[int, list[float]]]) -> dict[str, list[float | None]]:
    """For both middle ranks of every column the value there, or None if it lies outside the bracket."""
    narrow = comparable(df, columns)
    own = {x: brackets[c] for x, c in zip(narrow.columns, columns, strict=True)}

    def by_column(value) -> Column:
        chain: Column | None = None
        for x, bracket in own.items():
            chain = F.when(F.col("i") == x, value(bracket)) if chain is None else chain.when(F.col("i") == x, value(bracket))
        return chain

    ends = by_column(lambda b: F.array(*map(F.lit, b[1])))
    long = narrow.unpivot([], list(own), "i", "v").where(F.col("v") <= by_column(lambda b: F.lit(b[1][-1])))
    # piece 0 is all below the bracket, as one value; the other pieces keep their values
    below = F.col("v") < by_column(lambda b: F.lit(b[1][0]))
    cut = long.select("i", F.when(below, 0).otherwise(1 + F.size(F.filter(ends, lambda e: e < F.col("v")))).alias("piece"), F.when(~below, F.col("v")).alias("v"))
    counted = cut.groupBy("i", "piece", "v").agg(F.count("*").alias("m"))
    pieces = counted.groupBy("i", "piece").agg(F.sum("m").alias("m"))
    order = Window.partitionBy("i").orderBy("piece")
    starts = pieces.select("i", "piece", (F.sum("m").over(order) - F.col("m")).alias("start"))
    upto = F.sum("m").over(Window.partitionBy("i", "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumn("upto", upto).join(starts, ["i", "piece"]).withColumn("upto", F.col("upto") + F.col("start"))
    ranks = by_column(lambda b: F.array(F.lit((b[0] + 1) // 2), F.lit(b[0] // 2 + 1)))
    hits = ranked.select("i", "v", F.posexplode(ranks).alias("which", "rank"), "upto", "m").where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
    found: dict[str, list[float | None]] = {c: [None, None] for c in columns}
    for r in hits.select("i", "which", "v").collect():  # two rows per column
        found[columns[int(r["i"][1:])]][r["which"]] = r["v"]
    return found


def kept_medians(df: DataFrame, columns: list[str], path: str) -> dict[str, float | None]:
    """The exact medians of ``df``, whose parts have all been added under ``path``."""
    result: dict[str, float | None] = dict.fromkeys(columns)
    slacks = dict.fromkeys(columns, SLACK)
    while slacks:
        brackets = _brackets(df.sparkSession, path, slacks)
        todo = [c for c in slacks if c in brackets]
        if not todo:
            break
        missed = {}
        for column, (first, last) in _middle(df, todo, brackets).items():
            if first is None or last is None:
                if slacks[column] >= 0.5:
                    raise ValueError(f"the sketches under {path} are not those of this table's column {column}")
                missed[column] = min(0.5, 4 * slacks[column])
            else:
                result[column] = (first + last) / 2
        slacks = missed
    return result
