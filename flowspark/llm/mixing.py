"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

* Sources, by code point with null last, weigh ``weights`` in turn and share ``share`` of all words; a
  target stops at ``cap`` times its source's words, and the excess goes to the others by weight (the
  common level is found from running sums over the sources in the order in which they fill up).
* The schedule has a slot per word.  Slot i is the point ``frac(i * golden ratio)``, which the cumulative
  target shares map to a source; a slot's rank among its source's slots, modulo the source's size, names the
  word it takes.  So a source's words are taken in turn, and only the number of its slots matters.
* That number is counted without making the slots: the points below a share are a sum of floors of a
  linear function, which Euclid's algorithm adds up in a few dozen steps of whole numbers at any size.
* Documents are shuffled within their source by a hash of doc_id; running word counts say which of their
  words the last, unfinished pass over the source takes.

A source with a third of all rows is no hot spot: documents are placed by sums per (source, hash bucket)
and a running sum inside each bucket.  What a source gets differs from its target by the discrepancy of the
schedule only, a few words, whatever the sizes of the source and of the rest.

Nulls and edge cases: a null text has no words; a null source is a source of its own, the last; documents
without words are taken zero times; repeated rows count each and share the words that fall on them;
a null doc_id is hashed as such; columns with the names of results are replaced; an empty table gives
an empty result.  Reruns agree.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import WORD, stored

BUCKETS = 4096
GOLDEN = 0.6180339887498949
RESULTS = ("size", "source_size", "target", "taken")


def place(doc_id: Column) -> Column:
    """A hash of 60 bits that SQL engines agree on."""
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix-"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """``sizes(k, source, source_size)``, one row per source, with its weight and target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("i", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("i") % len(weights) + 1).cast("int")))
    filling = Window.orderBy("full_at", "i")
    everything = Window.partitionBy()
    levels = (
        weighed.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight"))
        .withColumn("shared", share * F.sum("source_size").over(everything))
        .withColumn("level", (F.col("shared") - (F.sum("most").over(filling) - F.col("most"))) / F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    )
    common = F.min_by(F.when(F.col("level") <= F.col("full_at"), F.col("level")), F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "i"))).over(everything)
    return levels.withColumn("common", common).select("i", "k", "source_size", F.least("most", F.col("common") * F.col("weight")).alias("target"))


def below(share: Column, slots: int) -> Column:
    """How many i below ``slots`` have ``frac(i * GOLDEN) < share``."""
    a, m = GOLDEN.as_integer_ratio()
    whole = lambda x: F.lit(Decimal(x)).cast("decimal(38,0)")
    most, all_low, steps = m, 0, []
    n, b = slots, 0
    while m:
        steps.append(F.struct(whole(a // m).alias("q"), whole(a % m).alias("a"), whole(m).alias("m")))
        all_low += n * (n - 1) * (a // m) + 2 * n * (b // m)
        n, b = divmod(a % m * n + b % m, m)
        a, m = m, a % m
    state = "struct<n:decimal(38,0),b:decimal(38,0),twice:decimal(38,0)>"

    def step(s: Column, x: Column) -> Column:
        end = x.a * s.n + s.b % x.m
        # twice the sum of floor((a i + b) / m) over i below n
        twice = s.twice + s.n * (s.n - 1) * x.q + 2 * s.n * F.floor((s.b - s.b % x.m) / x.m)
        return F.struct(F.floor((end - end % x.m) / x.m).alias("n"), (end % x.m).alias("b"), twice.alias("twice")).cast(state)

    reach = F.least(F.ceil(share * float(most)), F.lit(most)).cast("decimal(38,0)")
    start = F.struct(whole(slots).alias("n"), (whole(most) - reach).alias("b"), whole(0).alias("twice")).cast(state)
    return ((whole(all_low + 2 * slots) - F.aggregate(F.array(*steps), start, step, lambda s: s.twice)).cast("long") / 2).cast("long")


def _slots(goals: DataFrame, slots: int, cap: float) -> DataFrame:
    """(k, source_size, slots): how many of the schedule's slots each source takes."""
    order = Window.orderBy("i")
    share = F.try_divide(F.sum("target").over(order), F.sum("target").over(Window.partitionBy()))
    reached = goals.withColumn("share", share).withColumn("reached", F.coalesce(below(F.col("share"), slots), F.lit(0)))
    hits = F.col("reached") - F.lag("reached", 1, 0).over(order)
    return reached.select("k", "source_size", F.least(hits, F.floor(cap * F.col("source_size"))).alias("slots"))


def mixed(docs: DataFrame, text: bool = False, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The columns of ``docs`` (``text`` only if asked for) with size, source_size, target and taken."""
    own = [c for c in docs.columns if c not in RESULTS and (text or c != "text")]
    sized = stored(
        docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
        .select(*own, "size", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("k "), place(F.col("doc_id")).alias("place "), F.monotonically_increasing_id().alias("row "))
    )
    rows = sized.select(F.col("row ").alias("row"), F.col("k ").alias("k"), F.col("place ").alias("place"), "size", "source").withColumn("bucket", F.floor(F.col("place") / (2**60 // BUCKETS)))
    sizes = rows.groupBy("k").agg(F.first("source", ignorenulls=True).alias("source"), F.sum("size").alias("source_size"))
    goals = stored(targets(sizes, weights, share, cap))
    wanted = goals.agg(F.sum("target")).first()[0] or 0.0

    sums = rows.groupBy("k", "bucket").agg(F.sum("size").alias("n"))
    starts = sums.select("k", "bucket", (F.sum("n").over(Window.partitionBy("k").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("k", "bucket").orderBy("place", "row")) - F.col("size")
    at = rows.where("size > 0").withColumn("inside", inside).join(starts, ["k", "bucket"]).select("row", "k", "size", (F.col("before") + F.col("inside")).alias("first"))
    passes = at.join(_slots(goals, round(wanted), cap), "k")
    taken = passes.select("row", F.expr("size * (slots div source_size) + greatest(0L, least(first + size, slots % source_size) - first)").alias("taken"))
    return (
        sized.join(taken.withColumnRenamed("row", "row "), "row ", "left").join(goals.select(F.col("k").alias("k "), "source_size", "target"), "k ")
        .select(*own, "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )


def repeated(mix: DataFrame) -> DataFrame:
    """One row per time that a document is taken; the one document of a source at which a pass ends counts from half its words on."""
    times = F.when(F.col("size") > 0, F.expr("(2 * taken + size) div (2 * size)")).otherwise(F.lit(0)).cast("int")
    copies = F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))).alias("copy ")
    return mix.select("*", copies).drop("copy ")
