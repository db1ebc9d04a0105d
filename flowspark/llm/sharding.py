"""Sharding by balanced label propagation, in DataFrame functions only.

Documents with equal texts are linked.  The rows of such a group are alike, so the state is one row per
(group, shard) with a count, never a row per document, and a group of a third of all rows has at most as many
state rows as there are shards.

* Law: ``rows``.  Shard sizes differ by one row at most.  Every shard has a capacity; linked rows never
  exceed it, and unlinked ones fill what is left in the end.
* Start: linked rows are dealt to the shards in turn.
* Round: the rows of a cell wish to follow their neighbours to the shard that holds most of the group (ties by
  hash); a group that needs several shards has that many homes, and its other cells are dealt to them.  What may move from one shard to another is a quota: as much as wishes to come back, and its
  share of the target's free room.  Within a pair of shards the greatest gains go first, by running sums; the
  last cell may move in part.  Every move makes a group more concentrated; rounds end when a pair of them changes little.  Odd
  rounds wish for shards with room only (a group too large for a shard goes on to its next one), even
  rounds for any shard that the group does not fill (swaps between full shards).
* Rows find their place by their rank in the group: ranks and slots come from counts per block of the input
  plus a number inside the block, so nothing sorts a group or a shard.

Links have no further weight: minimising cut links means keeping groups together, and what cannot be whole
because of its size or of other groups' is left in as few and as full pieces as propagation finds.

Nulls and edge cases: a null text has no bytes and counts as the empty text (size 8, crc32 of nothing, one
group); rows without or with repeated doc_id are rows like others; columns with the names of results, in
any case, are replaced; with fewer rows than shards some shards stay empty; an empty table gives an empty
result.  Reruns over the same files agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import stored
from flowspark.llm.tables import others, running

BLOCK_BITS = 15
BUCKET_GROUPS = 50_000
MAX_ROUNDS = 40
PROGRESS = 0.005  # propagation ends when a pair of rounds neither joins more rows nor empties more cells than this
RESULTS = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "text")


def _capacity(shard: Column, n: int, shards: int) -> Column:
    return F.lit(n // shards) + (shard < n % shards).cast("long")


def _start(groups: DataFrame, shards: int, buckets: int) -> DataFrame:
    """(group, place, shard, n): the rows of all groups dealt to the shards in turn."""
    dealt = running(groups.withColumn("bucket", F.pmod("place", F.lit(buckets))).withColumn("all", F.lit(0)), ["all"], "bucket", ["place", "group"], "n", "before")
    each = dealt.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(shards)) - 1)))
    return each.select(
        "group", "place", ((F.col("before") + F.col("i")) % shards).cast("int").alias("shard"),
        (F.floor(F.col("n") / shards) + (F.col("i") < F.col("n") % shards).cast("long")).alias("n"),
    )


def _round(cells: DataFrame, rows: int, shards: int, buckets: int, roomy: bool) -> DataFrame:
    """The cells after one round of wishes under quotas."""
    spark = cells.sparkSession
    used = cells.groupBy("shard").agg(F.sum("n").alias("used"))
    all_shards = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    room = F.broadcast(all_shards.join(used, "shard", "left").select("shard", _capacity(F.col("shard"), rows, shards).alias("capacity"), F.coalesce("used", F.lit(0)).alias("used")))  # a row per shard
    own = F.struct("n", F.xxhash64("place", "shard").alias("tie"), "shard")
    open_ = F.col("used") < F.col("capacity") if roomy else F.col("n") < F.col("capacity")
    of_group = Window.partitionBy("group")
    loose = F.sum(F.when(F.col("n") < F.col("capacity"), F.col("n")).otherwise(0)).over(of_group)
    needed = F.greatest(F.ceil(loose / F.greatest(F.col("capacity"), F.lit(1))).cast("int"), F.lit(1))
    homes = F.slice(F.sort_array(F.collect_list(F.when(open_, own)).over(of_group), asc=False), F.lit(1), needed)
    seen = cells.join(room, "shard").withColumn("homes", homes).withColumn("rank", F.row_number().over(of_group.orderBy(own.desc())))
    seen = seen.withColumn("best", F.get("homes", F.col("rank") % F.greatest(F.size("homes"), F.lit(1))))
    wishes = F.col("best").isNotNull() & (own < F.col("best")) & ~F.array_contains("homes", own)
    gain = F.floor(F.log2(F.col("best.n") - F.col("n") + 1)).cast("int")
    cell = seen.select(
        "group", "place", "shard", "n", F.when(wishes, F.col("best.shard")).alias("to"),
        # greatest gains first, by hash among about equal ones
        F.when(wishes, (64 - gain) * F.lit(buckets).cast("long") + F.pmod("place", F.lit(buckets))).alias("bucket"),
    )
    sums = cell.where("to IS NOT NULL").groupBy("shard", "to", "bucket").agg(F.sum("n").alias("sum"))
    pairs = sums.groupBy("shard", "to").agg(F.sum("sum").alias("wish"))
    back = pairs.select(F.col("shard").alias("to"), F.col("to").alias("shard"), F.col("wish").alias("back"))
    excess = pairs.join(back, ["shard", "to"], "left").withColumn("swap", F.least("wish", F.coalesce("back", F.lit(0)))).withColumn("excess", F.col("wish") - F.col("swap"))
    free = room.select(F.col("shard").alias("to"), (F.col("capacity") - F.col("used")).alias("free"))
    into = Window.partitionBy("to")
    # each source's share of the room, rounded such that the shares add up to the room
    upto = "cast(cast(least(free, total) as decimal(19,0)) * cast({} as decimal(19,0)) div greatest(total, 1) as bigint)"
    quota = excess.join(free, "to").withColumn("total", F.sum("excess").over(into)).withColumn("run", F.sum("excess").over(into.orderBy("shard")))
    quota = quota.select("shard", "to", (F.col("swap") + F.expr(f"{upto.format('run')} - {upto.format('(run - excess)')}")).alias("quota"))
    starts = sums.select("shard", "to", "bucket", (F.sum("sum").over(Window.partitionBy("shard", "to").orderBy("bucket")) - F.col("sum")).alias("start"))
    starts = starts.join(F.broadcast(quota), ["shard", "to"]).select("shard", "to", "bucket", (F.col("quota") - F.col("start")).alias("open"))  # quota: a row per pair of shards
    inside = F.sum("n").over(Window.partitionBy("shard", "to", "bucket").orderBy("place", "group").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    moved = cell.where("to IS NOT NULL").withColumn("inside", inside).join(starts, ["shard", "to", "bucket"]).withColumn(
        "moved", F.greatest(F.lit(0).cast("long"), F.least("n", F.col("open") - F.col("inside")))
    )
    stays = cell.where("to IS NULL").select("group", "place", "shard", "n")
    both = F.explode(F.array(F.struct("shard", (F.col("n") - F.col("moved")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("moved").alias("n")))).alias("x")
    return stays.union(moved.select("group", "place", both).select("group", "place", "x.shard", "x.n")).where("n > 0").groupBy("group", "place", "shard").agg(F.sum("n").alias("n"))


def propagated(groups: DataFrame, rows: int, shards: int) -> DataFrame:
    """(group, place, shard, n) after propagation, for ``groups(group, place, n)`` of a table of ``rows`` rows."""
    groups_n = groups.count()
    buckets = max(1, groups_n // BUCKET_GROUPS)
    cells = stored(_start(groups, shards, buckets))
    states: list[tuple[float, int]] = []
    for i in range(MAX_ROUNDS):
        now = cells.agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("together"), F.count("*").alias("cells")).first()
        states.append((now.together or 0.0, now.cells))
        settled = i >= 2 and states[i][0] <= (1 + PROGRESS) * states[i - 2][0] and states[i][1] >= (1 - PROGRESS) * states[i - 2][1]
        if settled or now.cells == groups_n:
            break
        cells = stored(_round(cells, rows, shards, buckets, i % 2 == 0))
    return cells


def sharded(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The columns of ``docs(text, ...)`` without text, with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    own = others(docs, RESULTS)
    text = F.coalesce("text", F.lit(""))
    row = F.monotonically_increasing_id()
    rows = stored(docs.select(
        *own, (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("group "), row.alias("row "),
    )).withColumn("block ", F.shiftright("row ", BLOCK_BITS))
    by_group = Window.partitionBy("group ")
    parts = rows.groupBy("group ", "block ").agg(F.count("*").alias("c "))
    parts = stored(parts.select(
        "group ", "block ", F.sum("c ").over(by_group).alias("n "), (F.sum("c ").over(by_group.orderBy("block ")) - F.col("c ")).alias("before "), F.col("c "),
    ))
    n = rows.count()
    linked = parts.where("`n ` > 1")
    groups = linked.where("`before ` = 0").select(F.col("group ").alias("group"), F.xxhash64("group ").alias("place"), F.col("n ").alias("n"))
    cells = propagated(groups, n, shards)

    used = {r.shard: r.n for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard
    left, ends = 0, []
    for shard in range(shards):
        left += n // shards + (shard < n % shards) - used.get(shard, 0)
        ends.append((left, shard))
    alone = F.array(*(F.struct(F.lit(e).cast("long").alias("end"), F.lit(s).alias("shard")) for e, s in ends))
    by_shard = Window.partitionBy("group").orderBy("shard")
    kept = cells.withColumn("end", F.sum("n").over(by_shard)).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("end", "shard"))).alias("ends "))

    singles = parts.where("`n ` = 1").groupBy("block ").agg(F.count("*").alias("c ")).withColumn("all ", F.lit(0)).withColumn("blocks ", F.shiftright("block ", 10))
    firsts = running(singles, ["all "], "blocks ", ["block "], "c ", "before ").select("block ", "before ")
    placed = (
        linked.join(kept.withColumnRenamed("group", "group "), "group ").select("group ", "block ", "before ", "ends ", F.lit(True).alias("linked "))
        .union(parts.where("`n ` = 1").select("group ", "block ").join(firsts, "block ").select("group ", "block ", "before ", alone.alias("ends "), F.lit(False).alias("linked ")))
    )
    same = Window.partitionBy("block ", F.when(F.col("linked "), F.col("group "))).orderBy("row ")
    rank = F.col("before ") + F.row_number().over(same) - 1
    found = rows.join(placed, ["block ", "group "]).withColumn("rank ", rank).withColumn("shard", F.filter("ends ", lambda e: F.col("rank ") < e.end)[0].shard)
    assigned = stored(found.select(*own, "size", "text_crc32", "shard", "row ", "block "))
    counts = assigned.groupBy("shard", "block ").agg(F.count("*").alias("c "))
    firsts = counts.select("shard", "block ", (F.sum("c ").over(Window.partitionBy("shard").orderBy("block ")) - F.col("c ")).alias("first "))
    slot = F.col("first ") + F.row_number().over(Window.partitionBy("shard", "block ").orderBy("row ")) - 1
    return assigned.join(firsts, ["shard", "block "]).select(
        *own, "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
