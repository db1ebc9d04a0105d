"""Flow, response and run tables derived from the given tables.

The texts are portable SQL.  They shape whole input tables into the record layouts the operators
work on and plant the defects (nulls, infinities, padded labels, broken answers) those handle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark import domains as D

FLOWS = """
SELECT f.*,
 fwd_pkts + bwd_pkts AS total_pkts, fwd_bytes + bwd_bytes AS total_bytes,
 CASE WHEN duration > 0 THEN (fwd_pkts + bwd_pkts) / duration ELSE CAST(0 AS DOUBLE) END AS pkt_rate,
 CASE WHEN duration > 0 THEN (fwd_bytes + bwd_bytes) / duration ELSE CAST(0 AS DOUBLE) END AS byte_rate
FROM (
SELECT e2.*, CASE WHEN dataset_source = 'UNSW-NB15' OR duration_raw <= 1000 THEN duration_raw ELSE duration_raw / CAST(1000000 AS DOUBLE) END AS duration
FROM (
SELECT e1.*, CASE WHEN dataset_source = 'UNSW-NB15' THEN duration_s ELSE duration_s * CAST(1000000 AS DOUBLE) END AS duration_raw
FROM (
SELECT event_id AS flow_id, user_id, value, k,
 CASE WHEN user_id % 2 = 0 THEN 'CIC-IDS2017' ELSE 'UNSW-NB15' END AS dataset_source,
 CASE WHEN user_id % 2 = 0 THEN
  CASE event_id % 15 WHEN 0 THEN ' DoS Hulk ' WHEN 1 THEN 'PortScan' WHEN 2 THEN 'DDoS' WHEN 3 THEN 'Bot' WHEN 4 THEN 'FTP-Patator'
   WHEN 5 THEN concat(chr(9), 'Web Attack – XSS') WHEN 6 THEN 'Infiltration' WHEN 7 THEN 'Heartbleed' WHEN 8 THEN 'Mystery'
   WHEN 9 THEN 'Benign' ELSE 'BENIGN' END
  ELSE CASE event_id % 14 WHEN 0 THEN 'Fuzzers' WHEN 1 THEN ' Backdoors' WHEN 2 THEN 'Exploits' WHEN 3 THEN 'Generic' WHEN 4 THEN 'DoS ' WHEN 5 THEN 'Reconnaissance'
   WHEN 6 THEN 'Shellcode' WHEN 7 THEN 'Worms' WHEN 8 THEN 'Analysis' WHEN 9 THEN NULL WHEN 10 THEN NULL WHEN 11 THEN ' ' WHEN 12 THEN 'Odd' ELSE 'Normal' END
 END AS raw_label,
 CASE WHEN event_id % 14 = 9 OR event_id % 14 = 11 OR event_id % 14 = 13 THEN 0 ELSE 1 END AS raw_binary,
 fwd_pkts, bwd_pkts,
 CASE WHEN event_id % 13 = 0 THEN CAST(0 AS DOUBLE) ELSE fwd_pkts * value * CASE WHEN event_id % 6 = 0 THEN 5000 ELSE 10 END END AS fwd_bytes,
 CASE WHEN event_id % 17 = 0 OR event_id % 13 = 0 AND event_id % 2 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(bwd_pkts * k * CASE WHEN event_id % 9 = 0 THEN 20000 ELSE 20 END AS DOUBLE) END AS bwd_bytes,
 CASE WHEN event_id % 31 = 4 THEN CAST(0.5 AS DOUBLE) WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) WHEN event_id % 7 = 0 THEN value / CAST(1000000 AS DOUBLE)
  WHEN event_id % 5 = 1 THEN value / CAST(500 AS DOUBLE) WHEN event_id % 23 = 0 THEN value * 20 ELSE value * 3 END AS duration_s,
 event_id % 7 AS syn, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 4 END AS ack, CASE WHEN event_id % 8 = 1 THEN 1 ELSE 0 END AS fin,
 CASE WHEN event_id % 10 = 3 THEN 1 ELSE 0 END AS rst, event_id % 2 AS psh, CASE WHEN event_id % 4 = 1 THEN 1 ELSE 0 END AS urg,
 CASE WHEN event_id % 12 = 5 THEN 2 ELSE 0 END AS ece, CASE WHEN event_id % 19 = 7 THEN 1 ELSE 0 END AS cwr,
 CASE event_id % 8 WHEN 0 THEN 6 WHEN 1 THEN 17 WHEN 2 THEN 1 WHEN 3 THEN 47 WHEN 4 THEN 6 WHEN 5 THEN 113 WHEN 6 THEN NULL ELSE 0 END AS proto_number,
 event_id % 14 AS service, (event_id + k) % 9 AS state,
 CASE WHEN event_id % 9 = 2 THEN 60 ELSE k % 40 END AS pkt_min,
 CASE WHEN event_id % 9 = 2 THEN 60 WHEN event_id % 9 = 3 THEN k % 40 WHEN event_id % 9 = 4 THEN 0 ELSE k % 40 + event_id % 1400 END AS pkt_max,
 k % 40 + value / CAST(7 AS DOUBLE) AS pkt_mean, value / CAST(3 AS DOUBLE) AS pkt_std,
 CASE event_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 512 WHEN 2 THEN 65535 ELSE 8192 END AS fwd_win,
 CASE WHEN event_id % 4 = 2 THEN 229 ELSE -1 END AS bwd_win,
 CASE WHEN event_id % 6 = 1 THEN CAST(0 AS DOUBLE) ELSE value * 1234567 / CAST(100 AS DOUBLE) END AS s_load,
 CASE WHEN event_id % 3 = 1 THEN CAST(0 AS DOUBLE) ELSE value * 77 END AS d_load,
 event_id % 1500 AS s_mean, CASE WHEN event_id % 4 = 0 THEN 0 ELSE k END AS d_mean,
 CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 64 WHEN 2 THEN 128 WHEN 3 THEN 254 WHEN 4 THEN 255 ELSE 31 END AS s_ttl,
 CASE WHEN event_id % 7 = 3 THEN 0 ELSE 29 END AS d_ttl,
 event_id % 8 AS repeats, CASE WHEN event_id % 50 = 9 THEN 1 ELSE 0 END AS same_ends,
 CASE WHEN event_id % 10 = 1 THEN 3 ELSE 0 END AS http_methods, CASE WHEN event_id % 25 = 6 THEN 1 ELSE 0 END AS ftp_login, event_id % 3 AS ftp_commands
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
 CASE WHEN event_id % 31 = 4 THEN 800 + event_id % 41 WHEN event_id % 19 = 0 THEN 0 ELSE event_id % 41 END AS fwd_pkts,
 CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id % 29 END AS bwd_pkts FROM {events}) e0) e1) e2) f
"""

DIRTY = """
SELECT event_id AS flow_id,
 CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 29 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 31 = 0 THEN CAST('-inf' AS DOUBLE)
  WHEN event_id % 37 = 0 THEN CAST('nan' AS DOUBLE) WHEN event_id % 47 = 0 THEN -value ELSE value END AS flow_rate,
 CASE WHEN event_id % 41 = 0 THEN NULL WHEN event_id % 43 = 0 THEN -value ELSE value * 3 END AS fwd_length,
 CASE WHEN event_id % 41 = 0 OR event_id % 53 = 0 THEN NULL WHEN event_id % 59 = 0 THEN -5 ELSE event_id % 101 END AS total_count,
 CASE event_id % 7 WHEN 0 THEN '-' WHEN 1 THEN 'abc' WHEN 2 THEN concat(' ', CAST(user_id AS STRING), ' ') WHEN 3 THEN '' WHEN 4 THEN '1.5e3'
  WHEN 5 THEN NULL ELSE CAST(value AS STRING) END AS mixed,
 CASE event_id % 6 WHEN 0 THEN '-' WHEN 1 THEN NULL WHEN 2 THEN 'http' WHEN 3 THEN 'dns' WHEN 4 THEN 'ssh' ELSE event_type END AS service_name
FROM {events}
"""

RESPONSES = """
SELECT r1.*, CASE flow_id % 9 WHEN 1 THEN concat('Here is the result:', chr(10), body) WHEN 2 THEN concat(body, ' end of answer')
  WHEN 3 THEN concat('Answer: ', substring(body, 1, length(body) - 1), ',}}') WHEN 4 THEN 'no object in this answer' WHEN 6 THEN NULL WHEN 7 THEN '[1, 2]'
  WHEN 8 THEN '' ELSE body END AS response
FROM (SELECT flow_id, k, value, raw_label, dataset_source, pkt_rate,
 concat('{{"attack_type": "', CASE flow_id % 13 WHEN 0 THEN 'DDoS' WHEN 1 THEN 'ddos attack' WHEN 2 THEN 'Benign' WHEN 3 THEN 'network scan' WHEN 4 THEN 'C2 Communication'
   WHEN 5 THEN 'something else' WHEN 6 THEN 'Brute-Force' WHEN 7 THEN ' SYN flood ' WHEN 8 THEN 'Web Attack' WHEN 9 THEN 'port scan' WHEN 10 THEN 'Normal' WHEN 11 THEN 'Exploits' ELSE '' END,
  '", "severity": "', CASE flow_id % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'LOW' WHEN 2 THEN 'medium' WHEN 3 THEN 'critical' WHEN 4 THEN 'informational' WHEN 5 THEN 'severe' ELSE '' END,
  '", "confidence": ', CASE flow_id % 10 WHEN 0 THEN '0.9' WHEN 1 THEN '85' WHEN 2 THEN '0.5' WHEN 3 THEN '1.0' WHEN 4 THEN '0' WHEN 5 THEN '150' WHEN 6 THEN 'null' WHEN 7 THEN '"high"' WHEN 8 THEN '-0.25' ELSE '"0.75"' END,
  ', "mitre_techniques": ', CASE flow_id % 5 WHEN 0 THEN '["T1498", "T1499.001 - flood"]' WHEN 1 THEN '[]' WHEN 2 THEN '["none", "T1046"]' WHEN 3 THEN 'null' ELSE '["T1110", 7]' END,
  ', "explanation": ', CASE flow_id % 11 WHEN 0 THEN '""' WHEN 1 THEN '12' ELSE concat('"flow ', CAST(k AS STRING), ' shows {{odd}} traffic"') END,
  ', "recommendations": ', CASE flow_id % 8 WHEN 0 THEN '"none"' WHEN 1 THEN 'null' ELSE '["block", "watch"]' END, '}}') AS body,
 CASE flow_id % 6 WHEN 0 THEN 'BENIGN' WHEN 1 THEN ' benign, mostly ' WHEN 2 THEN 'THREAT' WHEN 3 THEN '' WHEN 4 THEN 'It is BENIGN' ELSE NULL END AS stage1_response,
 CASE WHEN flow_id % 20 = 9 THEN 'timeout' ELSE NULL END AS response_error,
 CASE WHEN flow_id % 4 = 1 THEN 'Benign' ELSE 'Threat' END AS rf_label,
 CAST(50 + flow_id % 51 AS DOUBLE) / CAST(100 AS DOUBLE) AS rf_confidence,
 CAST(flow_id % 500 AS DOUBLE) / CAST(16 AS DOUBLE) AS elapsed_seconds
FROM {flows} fl) r1
"""

# Prediction of configuration number c for a flow with unified label "label".
RUN_COLUMNS = {
    "attack_type": "CASE WHEN (flow_id + c) % 17 = 0 THEN 'Unknown' WHEN (flow_id * 7 + c * 3) % 10 < 3 + c THEN label "
                   "WHEN flow_id % 3 = 0 THEN 'normal' WHEN flow_id % 3 = 1 THEN 'denial of service' ELSE 'bruteforce' END",
    "severity": "CASE flow_id % 5 WHEN 0 THEN 'informational' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high' ELSE 'critical' END",
    "confidence": "CAST((flow_id + c) % 64 AS DOUBLE) / CAST(64 AS DOUBLE)",
    "elapsed_seconds": "CAST(flow_id % 50 AS DOUBLE) / CAST(8 AS DOUBLE) + c",
    "n_errors": "CASE WHEN (flow_id + c) % 17 = 0 THEN 2 WHEN (flow_id + c) % 5 = 0 THEN 1 ELSE 0 END",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def flows(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(FLOWS, events=table(spark, folder, "events"))


def dirty(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(DIRTY, events=table(spark, folder, "events"))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(RESPONSES, flows=flows(spark, folder))


# Column of the flow view -> column of each dataset.
CIC_FROM = {
    "Protocol": "proto_number", "Flow Duration": "duration_raw", "Total Fwd Packets": "fwd_pkts", "Total Backward Packets": "bwd_pkts",
    "Total Length of Fwd Packets": "fwd_bytes", "Total Length of Bwd Packets": "bwd_bytes",
    "Min Packet Length": "pkt_min", "Max Packet Length": "pkt_max", "Packet Length Mean": "pkt_mean", "Packet Length Std": "pkt_std",
    "SYN Flag Count": "syn", "FIN Flag Count": "fin", "RST Flag Count": "rst", "PSH Flag Count": "psh", "ACK Flag Count": "ack",
    "URG Flag Count": "urg", "ECE Flag Count": "ece", "CWE Flag Count": "cwr",
    "Init_Win_bytes_forward": "fwd_win", "Init_Win_bytes_backward": "bwd_win",
}
UNSW_FROM = {
    "proto": "proto_number", "service": "service", "state": "state", "dur": "duration_raw", "sbytes": "fwd_bytes", "dbytes": "bwd_bytes",
    "Spkts": "fwd_pkts", "Dpkts": "bwd_pkts", "Sload": "s_load", "Dload": "d_load", "smeansz": "s_mean", "dmeansz": "d_mean",
    "sttl": "s_ttl", "dttl": "d_ttl", "ct_state_ttl": "repeats", "is_sm_ips_ports": "same_ends",
    "ct_flw_http_mthd": "http_methods", "is_ftp_login": "ftp_login", "ct_ftp_cmd": "ftp_commands",
}


def wide_flows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The flow view under the column names of both datasets; the other dataset's columns are null."""
    cic = F.col("dataset_source") == D.CIC
    return df.select(
        "flow_id", "dataset_source", "raw_label", "raw_binary", *keep,
        *[F.when(cic, F.col(own)).alias(name) for name, own in CIC_FROM.items()],
        *[F.when(~cic, F.col(own)).alias(name) for name, own in UNSW_FROM.items()])


def labelled(df: DataFrame) -> DataFrame:
    """Flow view with its unified label, both datasets by one broadcast lookup."""
    from flowspark.functions.text import strip
    from flowspark.operators.bounded import dimension
    from flowspark.operators.cleaning import resolve_label

    original = F.when(F.col("dataset_source") == D.CIC, strip(F.col("raw_label"))).otherwise(
        resolve_label(F.col("raw_label"), F.col("raw_binary")))
    known = [(source, raw, label) for source, labels in D.LABELS_BY_SOURCE.items() for raw, label in labels.items()]
    lookup = dimension(df.sparkSession, known, "dataset_source string, label_original string, label string")
    return (
        df.withColumn("label_original", original).join(lookup, ["dataset_source", "label_original"], "left")
        .withColumn("label", F.coalesce("label", F.lit(D.UNKNOWN)))
    )


def runs(df: DataFrame) -> DataFrame:
    """Labelled flows once per configuration, with a deterministic prediction for each."""
    from flowspark.operators.evaluation import expand_grid

    numbered = expand_grid(df).withColumn("c", F.substring("config", 1, 1).cast("int"))
    made = numbered.withColumns({name: F.expr(text) for name, text in RUN_COLUMNS.items()})
    errors = F.when(F.col("n_errors") > 0, F.array_repeat(F.lit("error"), F.col("n_errors"))).otherwise(
        F.array().cast("array<string>"))
    return made.withColumns({"ground_truth": F.col("label"), "validation_errors": errors, "record_key": F.col("flow_id")})
