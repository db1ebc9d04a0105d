"""SQL of the queries in ``live_queries``; only the input views are shared with the Spark side."""

from __future__ import annotations

from flowspark.plans import oracles as O
from flowspark.plans.live_queries import ARRIVALS, TIMED

ORACLES: dict[str, str] = {}

TF = "(" + TIMED.format(events="events") + ")"
AR = "(" + ARRIVALS.format(flows=TF) + ")"

# ---------------------------------------------------------------- context

MEASURES = (
    "count(*) AS n_flows, count(*) FILTER (WHERE syn > 0 AND ack = 0) AS n_syn_only, count(*) FILTER (WHERE bwd_pkts = 0) AS n_unanswered, "
    "CAST(sum(total_pkts) AS BIGINT) AS packets, round(max(pkt_rate), 6) AS peak_rate")
KEPT = (
    f"marks AS (SELECT arrival, max(ts) AS latest FROM a GROUP BY arrival), edges AS (SELECT arrival, (SELECT max(latest) FROM marks e WHERE e.arrival < m.arrival) - INTERVAL 1 DAY AS edge FROM marks m), "
    "dealt AS (SELECT a.*, coalesce(ts < edge, false) AS late FROM a JOIN edges USING (arrival)), kept AS (SELECT * FROM dealt WHERE NOT late)")


def window_sql(source: str) -> str:
    return f'SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts) AS start, time_bucket(INTERVAL 6 HOURS, ts) + INTERVAL 6 HOURS AS "end", {MEASURES} FROM {source} GROUP BY 1, 2, 3'


def session_sql(source: str) -> str:
    return (
        f'SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOURS AS "end", {MEASURES} FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no '
        f"FROM (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOURS THEN 1 ELSE 0 END AS new FROM {source}) s1) s2 GROUP BY user_id, no")


CLOSED = "\"end\" <= (SELECT date_trunc('milliseconds', max(ts)) FROM kept) - INTERVAL 1 DAY"
ORACLES["context_windows"] = window_sql(TF)
ORACLES["context_sessions"] = session_sql(TF)
ORACLES["flow_context"] = (
    f"SELECT flow_id, f.user_id, w.n_flows, w.n_syn_only, w.n_unanswered, w.packets, w.peak_rate, round(w.n_syn_only / CAST(w.n_flows AS DOUBLE), 6) AS syn_only_share, "
    "round(w.packets / CAST(w.n_flows AS DOUBLE), 6) AS packets_per_flow, CASE WHEN w.n_flows < 3 THEN 'quiet' WHEN w.packets / CAST(w.n_flows AS DOUBLE) <= 30 THEN 'scan' ELSE 'flood' END AS behaviour "
    f"FROM {TF} f JOIN ({window_sql(TF)}) w ON f.user_id = w.user_id AND time_bucket(INTERVAL 6 HOURS, f.ts) = w.start")
ORACLES["stream_context"] = f"WITH a AS {AR}, {KEPT} SELECT * FROM ({window_sql('kept')}) w WHERE {CLOSED}"
ORACLES["stream_sessions"] = f"WITH a AS {AR}, {KEPT} SELECT * FROM ({session_sql('kept')}) w WHERE {CLOSED}"
ORACLES["stream_late"] = f"WITH a AS {AR}, {KEPT} SELECT user_id, arrival, count(*) AS n_late, min(ts) AS earliest FROM dealt WHERE late GROUP BY 1, 2"
ORACLES["live_progress"] = O.ORACLES["batch_progress"]

# ---------------------------------------------------------------- raw readers

# a field of blanks only is kept by the files; an empty label is read as null
ORACLES["scan_csv_encodings"] = (
    f"SELECT {O.strip("replace(raw_label, '–', 'é')")} AS label, count(*) AS n, CAST(sum(flow_id) AS BIGINT) AS ids, "
    "CAST(sum(fwd_pkts) FILTER (WHERE flow_id % 3 = 0) AS BIGINT) AS fwd_packets, round(max(duration_s) FILTER (WHERE flow_id % 3 = 1), 6) AS longest "
    f"FROM {TF} GROUP BY 1")
ORACLES["stix_split_scan"] = (
    "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id % 8 ORDER BY doc_id) - 1 AS INT) AS position, source AS name, CAST(length(text) AS INT) AS n_chars, md5(text) AS digest FROM documents")

# ---------------------------------------------------------------- stored index

WORDS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"
ORACLES["lexical_search"] = (
    f"WITH w AS (SELECT doc_id AS id, {WORDS.format('text')} AS words FROM documents), st AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM w), "
    f"tq AS (SELECT DISTINCT item_id AS query_id, unnest({WORDS.format('text')}) AS term FROM benchmark), "
    "tf AS (SELECT id, len(any_value(words)) AS n, term, count(*) AS tf FROM (SELECT id, words, unnest(words) AS term FROM w) u GROUP BY id, term), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "sc AS (SELECT query_id, id, round(sum(ln(1.0 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 12) AS score "
    "FROM tq JOIN tf USING (term) JOIN df USING (term), st GROUP BY 1, 2) "
    "SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) r WHERE rank <= 5")

# ---------------------------------------------------------------- kept summaries

ORACLES["kept_medians"] = " UNION ALL ".join(
    f"SELECT CAST({n} AS INT) AS parts, '{c}' AS column_name, median({c}) AS median FROM lineitem WHERE l_orderkey % 3 < {n}" for n in (1, 2, 3) for c in O.NUMBERS)
ORACLES["kept_ranking"] = O.ORACLES["config_ranking"]

# ---------------------------------------------------------------- answers

ORACLES["respond_batches"] = f"SELECT flow_id AS record_key, md5(concat_ws(' ', 'flow', flow_id, proto_number)) AS response, CAST(NULL AS VARCHAR) AS response_error FROM {TF} f"
RANGE = "'confidence fora do intervalo [0,1]: '"
EXPLAINED = "CASE WHEN flow_id % 5 = 0 THEN 'explanation ausente ou inválida' END"
ORACLES["odd_answers"] = (
    f"SELECT flow_id, concat_ws('|', CASE flow_id % 6 WHEN 0 THEN {RANGE} || 'nan' WHEN 4 THEN {RANGE} || 'nan' WHEN 1 THEN {RANGE} || 'inf' WHEN 2 THEN {RANGE} || '-inf' WHEN 5 THEN {RANGE} || '150.0' END, "
    f"CASE WHEN flow_id % 4 IN (0, 2) THEN 'mitre_techniques deve ser uma lista' END, {EXPLAINED}) AS raw_errors, "
    "CASE flow_id % 6 WHEN 0 THEN 'NaN' WHEN 4 THEN 'NaN' WHEN 1 THEN 'Infinity' WHEN 2 THEN '-Infinity' WHEN 3 THEN '0.5' ELSE '1.5' END AS confidence, "
    "CASE flow_id % 4 WHEN 0 THEN 'T1046|T1498.001' WHEN 1 THEN 'T1046' WHEN 2 THEN '' ELSE 'T1110' END AS techniques, "
    f"concat_ws('|', CASE flow_id % 6 WHEN 0 THEN {RANGE} || 'nan' WHEN 4 THEN {RANGE} || 'nan' WHEN 1 THEN {RANGE} || 'inf' WHEN 2 THEN {RANGE} || '-inf' WHEN 5 THEN {RANGE} || '1.5' END, {EXPLAINED}) AS errors FROM {TF} f")
