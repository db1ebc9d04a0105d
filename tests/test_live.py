"""Streams: late rows, windows, sessions and progress, with restarts and repeated batches."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from flowspark.streaming import context as C
from flowspark.streaming import progress as G

START = dt.datetime(2024, 3, 1)
SCHEMA = "flow_id long, user_id long, ts timestamp, syn int, ack int, bwd_pkts int, total_pkts int, pkt_rate double"


def flow(i, user, hours):
    return (i, user, None if hours is None else START + dt.timedelta(hours=hours), i % 3, i % 2, i % 4, i % 9, float(i % 7))


def stream(spark, path):
    return spark.readStream.schema(SCHEMA).parquet(path)


@pytest.fixture
def replay(spark, tmp_path):
    """Deals the given batches one by one, each with a new start of the stream."""
    def run(*batches):
        for batch in batches:
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            C.split_late(stream(spark, f"{tmp_path}/in"), f"{tmp_path}/split", f"{tmp_path}/state", "2 hours").awaitTermination()
        return f"{tmp_path}/split"
    return run


def test_late_and_untimed_rows_are_kept_apart(spark, replay):
    target = replay([flow(1, 1, 0), flow(2, 1, 5)], [flow(3, 1, 3), flow(4, 1, 2.9), flow(5, 2, None), flow(6, 2, 20)], [flow(7, 1, 17.9), flow(8, 2, 18)])
    schema = spark.createDataFrame([], SCHEMA).schema
    assert {r.flow_id for r in C.late_rows(spark, target, schema).collect()} == {4, 7}
    states = {r.flow_id: r.state for r in spark.read.parquet(f"{target}/rows").collect()}
    assert states[5] == C.UNTIMED and [i for i, s in states.items() if s == C.IN_TIME] and {i for i, s in states.items() if s == C.IN_TIME} == {1, 2, 3, 6, 8}


def test_rows_of_a_repeated_batch_count_once(spark, replay, tmp_path):
    target = replay([flow(i, i % 3, i / 10) for i in range(60)], [flow(100, 9, 40)])
    spark.read.parquet(f"{target}/rows").where("flow_id < 30").write.mode("append").partitionBy("state").parquet(f"{target}/rows")  # a batch that failed half-way and ran again
    schema = spark.createDataFrame([], SCHEMA).schema
    C.window_stream(C.in_time(spark, target, schema, "2 hours"), "1 hour", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r.user_id, r.start): r.n_flows for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert sum(got.values()) == 60 and max(r for _, r in got) == START + dt.timedelta(hours=5)


def plain_sessions(rows, gap):
    out = []
    for user in {r[1] for r in rows}:
        times = sorted((r[2], r) for r in rows if r[1] == user and r[2] is not None)
        group = []
        for t, r in times:
            if group and t > group[-1][2] + gap:
                out.append((user, group[0][2], group[-1][2] + gap, len(group), sum(x[6] for x in group)))
                group = []
            group.append(r)
        if group:
            out.append((user, group[0][2], group[-1][2] + gap, len(group), sum(x[6] for x in group)))
    return out


def test_sessions_of_a_table(spark):
    rng = random.Random(4)
    rows = [flow(i, rng.choice([1, 1, 1, 2, 3]), None if i % 50 == 0 else round(rng.uniform(0, 300), 2)) for i in range(600)]
    got = [(r.user_id, r.start, r.end, r.n_flows, r.packets) for r in C.sessions(spark.createDataFrame(rows, SCHEMA), "90 minutes").collect()]
    assert sorted(got) == sorted(plain_sessions(rows, dt.timedelta(minutes=90)))


def test_context_of_flows(spark):
    rows = [flow(i, 1 if i < 40 else 2, 0.01 * i) for i in range(50)] + [flow(99, 3, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.flow_id: r for r in C.with_context(df, C.windows(df, "1 hour"), "1 hour", busy=20, quiet_packets=3.0).collect()}
    assert len(got) == 51 and got[0].n_flows == 40 and got[45].n_flows == 10 and got[99].n_flows == 0
    assert got[0].behaviour == "flood" and got[45].behaviour == "quiet" and got[99].behaviour == "quiet" and got[0].packets == sum(i % 9 for i in range(40))
    assert C.sessions(df.limit(0), "1 hour").collect() == []


def test_progress_over_restarts_and_stalls(spark, tmp_path):
    schema = "run string, record_key long, elapsed_seconds double, finished_at timestamp"

    def step(rows):
        spark.createDataFrame([(r, k, e, START + dt.timedelta(minutes=m)) for r, k, e, m in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        G.progress_stream(source, f"{tmp_path}/rows", f"{tmp_path}/cp", block_width=10, idle_ms=60_000, delay="1 minute").awaitTermination()
        return spark.read.schema(G.ROWS).parquet(f"{tmp_path}/rows")

    planned = spark.createDataFrame([("a", 25), ("b", 4)], "run string, n_planned long")
    first = step([("a", k, 1.0 + k, 0) for k in range(12)] + [("b", 0, 5.0, 0)])
    seen = {(r.run, r.record_key): r for r in G.progress(first, planned).collect()}
    assert len(seen) == 13 and seen["a", 11].ordinal == 12 and seen["a", 11].elapsed_total == sum(1.0 + k for k in range(12)) and seen["b", 0].remaining == 15.0
    step([("a", k, 1.0 + k, 1) for k in range(12, 25)])
    last = step([("b", 1, 1.0, 600), ("b", 2, 2.0, 600)])
    done = {(r.run, r.record_key): r for r in G.progress(last, planned).collect()}
    assert len(done) == 28 and done["a", 24].pct == 100.0 and done["a", 24].remaining == 0.0 and done["b", 2].elapsed_total == 8.0
    totals = [done["a", k].elapsed_total for k in range(25)]
    assert totals == [sum(1.0 + x for x in range(k + 1)) for k in range(25)]
    idle = {(r.run, r.block): r.n for r in G.stalled(last).collect()}
    assert idle == {("a", 0): 10, ("a", 1): 10, ("a", 2): 5}  # b went on, a has had no result for hours
