"""Time-aggregated context per traffic source, on streams and on tables.

A single flow cannot tell a flood from a scan; what its source did around that time can.

``split_late`` reads the live flows once and deals each micro-batch into rows in time, rows behind the watermark
and rows without a time, so late rows are kept and counted, not lost.  ``window_stream`` and ``session_stream``
aggregate the rows in time with event-time state that the watermark bounds.  ``windows`` and ``sessions`` replay
the same aggregates over tables, and ``with_context`` adds them to flows as features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

SOURCE, TIME, KEY = "user_id", "ts", "flow_id"
IN_TIME, LATE, UNTIMED = "in_time", "late", "untimed"


def measures() -> list[Column]:
    """What a source did: sums and extremes, which partial aggregates combine before any shuffle."""
    return [
        F.count("*").alias("n_flows"),
        F.count_if((F.col("syn") > 0) & (F.col("ack") == 0)).alias("n_syn_only"),
        F.count_if(F.col("bwd_pkts") == 0).alias("n_unanswered"),
        F.sum(F.col("total_pkts").cast("long")).alias("packets"),
        F.max("pkt_rate").alias("peak_rate"),
    ]


# ---------------------------------------------------------------- streams

def split_late(flows: DataFrame, target: str, checkpoint: str, delay: str) -> StreamingQuery:
    """Append each row of a stream to ``target/rows`` under its state: in time, late or untimed.

    The watermark of a micro-batch is the greatest time of all earlier ones less ``delay``; it comes from a
    ledger with one time per batch.  A batch that runs again after a failure sees the same ledger and splits
    the same way; rows that it writes twice are told apart by their key downstream.
    """

    def deal(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        marks = f"{target}/marks"
        edge = None
        if batch_id > 0:
            known = spark.read.schema("latest timestamp, batch long").option("basePath", marks).parquet(marks)
            edge = known.where(F.col("batch") < batch_id).agg(F.max("latest") - F.expr(f"INTERVAL {delay}")).first()[0]
        late = F.lit(False) if edge is None else F.col(TIME) < F.lit(edge)
        state = F.when(F.col(TIME).isNull(), UNTIMED).when(late, LATE).otherwise(IN_TIME)
        batch.withColumn("state", state).write.mode("append").partitionBy("state").parquet(f"{target}/rows")
        batch.agg(F.max(TIME).alias("latest")).write.mode("overwrite").parquet(f"{marks}/batch={batch_id}")

    return flows.writeStream.foreachBatch(deal).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(spark, target: str, schema: T.StructType) -> DataFrame:
    """The rows that came behind the watermark, each once."""
    found = spark.read.schema(T.StructType([*schema.fields, T.StructField("state", T.StringType())])).parquet(f"{target}/rows")
    return found.where(F.col("state") == LATE).drop("state").dropDuplicates([KEY])


def in_time(spark, target: str, schema: T.StructType, delay: str) -> DataFrame:
    """The stream of rows in time, each once, with its watermark."""
    rows = spark.readStream.schema(schema).parquet(f"{target}/rows/state={IN_TIME}")
    return rows.withWatermark(TIME, delay).dropDuplicatesWithinWatermark([KEY])


def _append(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_stream(rows: DataFrame, width: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each tumbling window of each source once, when the watermark has passed its end."""
    return _append(_flat(rows.groupBy(SOURCE, F.window(TIME, width).alias("w")).agg(*measures())), path, checkpoint)


def session_stream(rows: DataFrame, gap: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each session of each source once, when the watermark has passed its last row by ``gap``."""
    return _append(_flat(rows.groupBy(SOURCE, F.session_window(TIME, gap).alias("w")).agg(*measures())), path, checkpoint)


def _flat(df: DataFrame) -> DataFrame:
    return df.select(SOURCE, F.col("w.start").alias("start"), F.col("w.end").alias("end"), *[c for c in df.columns if c not in (SOURCE, "w")])


# ---------------------------------------------------------------- tables

def windows(flows: DataFrame, width: str) -> DataFrame:
    """The tumbling windows of every source over a whole table."""
    return _flat(flows.where(F.col(TIME).isNotNull()).groupBy(SOURCE, F.window(TIME, width).alias("w")).agg(*measures()))


def sessions(flows: DataFrame, gap: str, block: str = "1 day") -> DataFrame:
    """The sessions of every source over a whole table.

    Rows are joined to islands within (source, block of time) first, islands then over a source, so that a
    source with a third of all rows is spread over its blocks and only its islands meet in one task.
    """
    step = F.expr(f"INTERVAL {gap}")
    timed = flows.where(F.col(TIME).isNotNull()).withColumn("_block", F.window(TIME, block).start)
    islands = _joined(timed, [SOURCE, "_block"], F.col(TIME), F.col(TIME), step).groupBy(SOURCE, "_block", "_no").agg(
        F.min(TIME).alias("_first"), F.max(TIME).alias("_last"), *measures())
    whole = _joined(islands.drop("_no"), [SOURCE], F.col("_first"), F.col("_last"), step).groupBy(SOURCE, "_no").agg(
        F.min("_first").alias("start"), (F.max("_last") + step).alias("end"),
        *[F.sum(c).alias(c) for c in ("n_flows", "n_syn_only", "n_unanswered", "packets")], F.max("peak_rate").alias("peak_rate"))
    return whole.drop("_no")


def _joined(df: DataFrame, by: list[str], first: Column, last: Column, step: Column) -> DataFrame:
    """Number (``_no``) the runs of rows that begin at most ``step`` after the end of the one before."""
    order = Window.partitionBy(*by).orderBy(first)
    new = (first > F.lag(last).over(order) + step).cast("int")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def with_context(flows: DataFrame, context: DataFrame, width: str, busy: int = 20, quiet_packets: float = 10.0) -> DataFrame:
    """Flows with the features of their source's window and what they suggest.

    The join key (source, window) spreads a busy source over time.  A source is ``quiet`` below ``busy`` flows in the
    window, else it scans if it sends few packets per flow and floods otherwise.  Flows without a time or window are quiet.
    """
    names = [c for c in context.columns if c not in (SOURCE, "start", "end")]
    any_time = F.coalesce(TIME, F.lit("1970-01-01").cast(flows.schema[TIME].dataType))  # a window of a null would drop its row
    start = F.when(F.col(TIME).isNotNull(), F.window(any_time, width).start)
    found = flows.withColumn("start", start).join(context.drop("end"), [SOURCE, "start"], "left").drop("start")
    filled = found.withColumns({c: F.coalesce(c, F.lit(0).cast(context.schema[c].dataType)) for c in names})
    per_flow = F.coalesce(F.try_divide("packets", F.col("n_flows")), F.lit(0.0))
    return filled.withColumns({
        "syn_only_share": F.coalesce(F.try_divide("n_syn_only", F.col("n_flows")), F.lit(0.0)), "packets_per_flow": per_flow,
        "behaviour": F.when(F.col("n_flows") < busy, "quiet").when(per_flow <= quiet_packets, "scan").otherwise("flood"),
    })
