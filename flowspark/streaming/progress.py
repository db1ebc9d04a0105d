"""Progress of a live run: a row per result as results arrive, from keyed state with timers.

State is kept per (run, block of record keys), so a run with most of the results is spread over its blocks; a block
holds ``block_width`` records at most.  Rows carry running totals of their block, and ``progress`` adds the totals of the
earlier blocks, of which a run has few.  The state is three numbers and a timer per block, lives in the
checkpoint and survives a restart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ROWS = "run string, block long, record_key long, n long, total double, finished_at timestamp, kind string"


class Progress(StatefulProcessor):
    """Per block: how many results, their summed time, and when the last one came.

    A timer at the last result plus ``idle_ms`` reports a block without further results as ``stalled``.
    """

    def __init__(self, idle_ms: int) -> None:
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("totals", "n long, total double, last_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total, last = self.state.get() if self.state.exists() else (0, 0.0, 0)
        arrived = pd.concat(list(rows), ignore_index=True).sort_values("record_key", kind="stable")  # one block of one batch
        sums = total + arrived["elapsed_seconds"].cumsum()
        newest = max(last, int(arrived["finished_at"].max().timestamp() * 1000))
        yield pd.DataFrame({
            "run": key[0], "block": key[1], "record_key": arrived["record_key"], "n": range(n + 1, n + 1 + len(arrived)), "total": sums,
            "finished_at": arrived["finished_at"], "kind": "result"})
        if last:
            self.handle.deleteTimer(last + self.idle_ms)
        self.handle.registerTimer(newest + self.idle_ms)
        self.state.update((n + len(arrived), float(sums.iloc[-1]), newest))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, total, last = self.state.get()
        yield pd.DataFrame({
            "run": [key[0]], "block": [key[1]], "record_key": [None], "n": [n], "total": [total],
            "finished_at": [pd.Timestamp(last, unit="ms")], "kind": ["stalled"]}).astype({"record_key": "Int64"})

    def close(self) -> None:
        pass


def progress_stream(results: DataFrame, path: str, checkpoint: str, block_width: int = 100_000, idle_ms: int = 600_000,
                    delay: str = "10 minutes") -> StreamingQuery:
    """Append a row for every streamed result (run, record_key, elapsed_seconds, finished_at) and for every stalled block.

    Results later than ``delay`` would be dropped by event-time state, so ``delay`` is the longest time that a result may be under way.
    """
    results.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    blocked = results.select("run", "record_key", "elapsed_seconds", "finished_at", F.floor(F.col("record_key") / block_width).alias("block"))
    rows = blocked.withWatermark("finished_at", delay).groupBy("run", "block").transformWithStateInPandas(
        Progress(idle_ms), ROWS, "append", "eventTime")
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """What ``operators.evaluation.running_progress`` gives, from the rows so far and the planned size of each run.

    ``planned`` has (run, n_planned).  Within a block, results count in the order of their arrival.
    """
    results = rows.where(F.col("kind") == "result")
    blocks = results.groupBy("run", "block").agg(F.max("n").alias("_n"), F.max_by("total", "n").alias("_t"))
    before = Window.partitionBy("run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("run", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_t0"))
    i, total, whole = F.col("n") + F.col("_n0"), F.col("total") + F.col("_t0"), F.col("n_planned")
    return results.join(offsets.join(planned, "run"), ["run", "block"]).select(
        "run", "record_key", i.alias("ordinal"), (100.0 * i / whole).alias("pct"), total.alias("elapsed_total"),
        (total / i).alias("avg_elapsed"), (total / i * (whole - i)).alias("remaining"))


def stalled(rows: DataFrame) -> DataFrame:
    """Blocks whose last word is a timer: no result came after it."""
    last = rows.groupBy("run", "block").agg(F.max_by("kind", F.struct("n", F.col("kind") == "stalled")).alias("kind"), F.max("n").alias("n"), F.max("finished_at").alias("last"))
    return last.where(F.col("kind") == "stalled").select("run", "block", "n", "last")
