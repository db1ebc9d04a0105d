"""Queries of live and kept data: streams, keyed state, stored collections, raw readers and mergeable summaries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions import responses as P
from flowspark.functions import text as X
from flowspark.operators import evaluation as E
from flowspark.operators import kept_medians as K
from flowspark.operators import kept_metrics as N
from flowspark.operators import responder as R
from flowspark.operators.bounded import spread
from flowspark.plans.queries import NUMBERS, _runs, query, rounded
from flowspark.plans.views import FLOWS, table
from flowspark.session import shared_folder
from flowspark.sources.knowledge import read_stix
from flowspark.sources.postings import Postings
from flowspark.sources.raw_csv import read_raw
from flowspark.streaming import context as C
from flowspark.streaming import progress as G

WIDTH, GAP, DELAY = "6 hours", "2 hours", "1 day"
TIMED = FLOWS.replace("SELECT event_id AS flow_id,", "SELECT event_id AS flow_id, ts,")
# Flows in three arrivals of ten days: some come up to twelve hours late, some a whole arrival.
ARRIVALS = """
SELECT t1.*, CASE WHEN first_due >= 2 THEN 2 WHEN flow_id % 97 = 5 THEN first_due + 1 ELSE first_due END AS arrival
FROM (SELECT t0.*, CAST(floor((extract(DAY FROM ts + CASE WHEN flow_id % 53 = 7 THEN INTERVAL '12' HOUR ELSE INTERVAL '0' HOUR END) - 1) / 10.0) AS INT) AS first_due
 FROM {flows} t0) t1
"""


def timed_flows(spark, folder) -> DataFrame:
    return spark.sql(TIMED, events=table(spark, folder, "events"))


def arrivals(spark, folder) -> DataFrame:
    """Event time of streams is an instant, so the wall-clock ``ts`` of the table is cast, and cast back in results."""
    return spark.sql(ARRIVALS, flows=timed_flows(spark, folder)).select(
        "flow_id", "user_id", F.col("ts").cast("timestamp"), "syn", "ack", "bwd_pkts", "total_pkts", "pkt_rate", "arrival")


def _wall_clock(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end", "earliest") if c in df.columns})


def _split(spark, folder) -> tuple[str, DataFrame]:
    """The arrivals written one after another, each dealt by the stream before the next one comes."""
    base = shared_folder(spark)
    rows = arrivals(spark, folder)
    for number in range(3):
        rows.where(F.col("arrival") == number).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        C.split_late(stream, f"{base}/split", f"{base}/split-state", DELAY).awaitTermination()
    return base, rows


# ---------------------------------------------------------------- context

@query
def context_windows(spark, folder):
    return rounded(C.windows(timed_flows(spark, folder), WIDTH), ["peak_rate"])


@query
def context_sessions(spark, folder):
    return rounded(C.sessions(timed_flows(spark, folder), GAP), ["peak_rate"])


@query
def flow_context(spark, folder):
    rows = timed_flows(spark, folder).select("flow_id", "user_id", "ts", "syn", "ack", "bwd_pkts", "total_pkts", "pkt_rate")
    found = C.with_context(rows, C.windows(rows, WIDTH), WIDTH, busy=3, quiet_packets=30.0)
    return rounded(found, ["peak_rate", "syn_only_share", "packets_per_flow"]).select(
        "flow_id", "user_id", "n_flows", "n_syn_only", "n_unanswered", "packets", "peak_rate", "syn_only_share", "packets_per_flow", "behaviour")


@query
def stream_context(spark, folder):
    """Windows closed by the watermark, as the streams leave them."""
    base, rows = _split(spark, folder)
    C.window_stream(C.in_time(spark, f"{base}/split", rows.schema, DELAY), WIDTH, f"{base}/windows", f"{base}/windows-state").awaitTermination()
    return rounded(_wall_clock(spark.read.parquet(f"{base}/windows")), ["peak_rate"])


@query
def stream_sessions(spark, folder):
    base, rows = _split(spark, folder)
    C.session_stream(C.in_time(spark, f"{base}/split", rows.schema, DELAY), GAP, f"{base}/sessions", f"{base}/sessions-state").awaitTermination()
    return rounded(_wall_clock(spark.read.parquet(f"{base}/sessions")), ["peak_rate"])


@query
def stream_late(spark, folder):
    base, rows = _split(spark, folder)
    late = C.late_rows(spark, f"{base}/split", rows.schema).groupBy("user_id", "arrival").agg(F.count("*").alias("n_late"), F.min("ts").alias("earliest"))
    return _wall_clock(late)


# ---------------------------------------------------------------- progress

@query
def live_progress(spark, folder):
    """The runs' results arrive in three parts; the stream stops and goes on from its checkpoint in between."""
    base = shared_folder(spark)
    made = _runs(spark, folder).select(F.col("config").alias("run"), "record_key", "elapsed_seconds")
    made = made.withColumn("finished_at", F.timestamp_seconds(F.col("record_key") + 1_700_000_000))
    third = table(spark, folder, "events").agg(F.max("event_id")).first()[0] // 3 + 1
    for number in range(3):
        made.where(F.floor(F.col("record_key") / third) == number).write.mode("append").parquet(f"{base}/in")
        G.progress_stream(spark.readStream.schema(made.schema).parquet(f"{base}/in"), f"{base}/rows", f"{base}/state", 1000).awaitTermination()
    planned = made.groupBy("run").agg(F.count("*").alias("n_planned"))
    rows = spark.read.schema(G.ROWS).parquet(f"{base}/rows")
    return rounded(G.progress(rows, planned), ["pct", "elapsed_total", "avg_elapsed", "remaining"], 4)


# ---------------------------------------------------------------- raw readers

@query
def scan_csv_encodings(spark, folder):
    """Flows as CSV files of two encodings and three headers, read back in one pass in small byte ranges."""
    base = shared_folder(spark)
    df = timed_flows(spark, folder).select("flow_id", F.regexp_replace("raw_label", "–", "é").alias("label"), "fwd_pkts", "duration_s")
    third = F.col("flow_id") % 3
    spaced = df.where(third == 0).select(F.col("label").alias(" Label"), F.col("flow_id").alias("Flow ID "), F.col("fwd_pkts").alias(" Total Fwd Packets"))
    swapped = df.where(third == 1).select(F.col("duration_s").alias("Flow Duration"), F.col("flow_id").alias("Flow ID"), F.col("label").alias("Label"))
    plain = df.where(third == 2).select(F.col("flow_id").alias("Flow ID"), F.col("label").alias("Label"))
    for part, name, encoding in ((spaced, "a", "UTF-8"), (swapped, "b", "ISO-8859-1"), (plain, "c", "ISO-8859-1")):
        writer = part.write.option("header", True).option("encoding", encoding).option("ignoreLeadingWhiteSpace", False)
        writer.option("ignoreTrailingWhiteSpace", False).option("escape", '"').csv(f"{base}/{name}")
    both = read_raw(spark, f"{base}/*", lambda c: "string" if c == "Label" else "double", split_bytes=1 << 16)
    return both.groupBy(X.strip(F.col("Label")).alias("label")).agg(
        F.count("*").alias("n"), F.sum("Flow ID").cast("bigint").alias("ids"), F.sum("Total Fwd Packets").cast("bigint").alias("fwd_packets"),
        F.round(F.max("Flow Duration"), 6).alias("longest"))


@query
def stix_split_scan(spark, folder):
    """All documents as objects of eight large bundles, each read in many byte ranges."""
    base = shared_folder(spark)
    objects = table(spark, folder, "documents").select(
        (F.col("doc_id") % 8).alias("part"), F.col("doc_id").alias("ord"), F.concat(F.to_json(F.struct(
            F.col("doc_id").cast("string").alias("id"), F.lit("attack-pattern").alias("type"), F.col("source").alias("name"), F.col("text").alias("description"))), F.lit(",")).alias("value"))
    ends = spark.range(8).select(F.col("id").alias("part"), F.explode(F.array(
        F.struct(F.lit(-1).cast("long").alias("ord"), F.lit('{"type": "bundle", "notes": [{"id": "none"}], "objects": [').alias("value")),
        F.struct(F.lit((1 << 63) - 1).alias("ord"), F.lit('{"id": "last", "type": "identity"}]}').alias("value")))).alias("e")).select("part", "e.*")
    objects.union(ends).repartition("part").sortWithinPartitions("part", "ord").select("part", "value").write.partitionBy("part").text(base)
    found = read_stix(spark, f"{base}/*").where("type = 'attack-pattern'")
    return found.select(F.col("id").cast("long").alias("doc_id"), "position", "name", F.length("description").alias("n_chars"), F.md5("description").alias("digest"))


# ---------------------------------------------------------------- stored index

@query
def lexical_search(spark, folder):
    """The best documents of every benchmark passage by words alone, from a stored index."""
    corpus = spread(table(spark, folder, "documents")).select(F.col("doc_id").alias("id"), "text")
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return rounded(Postings.build(corpus, shared_folder(spark)).search(queries, 5), ["score"])


# ---------------------------------------------------------------- kept summaries

@query
def kept_medians(spark, folder):
    """Medians after each of three parts has come in; each part is scanned for its sketches once."""
    path, rows = shared_folder(spark), table(spark, folder, "lineitem")
    found = []
    for last in range(3):
        K.add_part(rows.where(F.col("l_orderkey") % 3 == last), NUMBERS, str(last), path)
        medians = K.kept_medians(rows.where(F.col("l_orderkey") % 3 <= last), NUMBERS, path)
        found += [(last + 1, c, m) for c, m in medians.items()]
    return spark.createDataFrame(found, "parts int, column_name string, median double")


GROUPS = "config string, dataset_source string, k int"


@query
def kept_ranking(spark, folder):
    """Configurations ranked from kept run figures: one run comes in two batches, one is wrong at first and replaced."""
    path, by = shared_folder(spark), ("config", "dataset_source", "k")
    made = _runs(spark, folder)
    part = lambda r: made.where(F.col("k") % 3 == r)
    for half in range(2):
        N.add_results(part(0).where(F.col("flow_id") % 2 == half), path, "first", f"b{half}", by)
    N.add_results(part(1), path, "second", "b0", by)
    N.add_results(part(2).withColumn("attack_type", F.lit("Benign")), path, "third", "b0", by)
    N.replace_run(part(2), path, "third", by)
    return E.ranking(N.kept_metrics(spark, path, GROUPS).withColumnRenamed("avg_elapsed_seconds", "avg_elapsed"))


# ---------------------------------------------------------------- answers

def digests(prompts: list[str]) -> list[str]:
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


@query
def respond_batches(spark, folder):
    """Every flow's prompt answered once, by a stand-in for a model, in a run that stops half-way and goes on."""
    prompts = timed_flows(spark, folder).select(F.col("flow_id").alias("record_key"), F.concat_ws(" ", F.lit("flow"), "flow_id", "proto_number").alias("prompt"))
    path = shared_folder(spark)
    R.answer(prompts, path, digests, only_slices=3)
    found = R.answer(prompts, path, digests)
    return found.select("record_key", "response", "response_error")


ODD = """
SELECT flow_id, CASE flow_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' WHEN 3 THEN '0.5' WHEN 4 THEN '"NaN"' ELSE '150' END AS shown,
 concat('{{"attack_type": "DDoS", "severity": "high", "confidence": ', CASE flow_id % 6 WHEN 0 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' WHEN 3 THEN '0.5' WHEN 4 THEN '"NaN"' ELSE '150' END,
  ', "mitre_techniques": ', CASE flow_id % 4 WHEN 0 THEN '{{"T1046": "scan", "T1498.001 flood": 1, "none": 0}}' WHEN 1 THEN '["T1046"]' WHEN 2 THEN '{{}}' ELSE '[NaN, "T1110"]' END,
  ', "explanation": ', CASE flow_id % 5 WHEN 0 THEN 'NaN' ELSE '"text"' END, ', "recommendations": []}}') AS response
FROM {flows} f
"""


@query
def odd_answers(spark, folder):
    """Answers with NaN, Infinity and an object where a list belongs."""
    answers = P.parse(spark.sql(ODD, flows=timed_flows(spark, folder)))
    done = P.normalise_response(answers).select(
        "flow_id", F.array_join(P.validation_errors(), "|").alias("raw_errors"), F.col("normalised.confidence").cast("string").alias("confidence"),
        F.array_join("normalised.mitre_techniques", "|").alias("techniques"), F.array_join("normalised.validation_errors", "|").alias("errors"))
    return done
