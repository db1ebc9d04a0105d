"""The same results as plain SQL over the given tables, for checking with another engine.

Only the input views and the fixed vocabularies are shared with the Spark side; every rule is
written again here.
"""

from __future__ import annotations

from string import ascii_lowercase

from flowspark import domains as D
from flowspark.plans.queries import FREE_TEXTS, GENERIC_COLUMNS, NUMBERS, PREDICTED, RULE_YAML
from flowspark.plans.views import DIRTY, FLOWS, RESPONSES, RUN_COLUMNS

ORACLES: dict[str, str] = {}

FL = "(" + FLOWS.format(events="events") + ")"
DI = "(" + DIRTY.format(events="events") + ")"
RE = "(" + RESPONSES.format(flows=FL) + ")"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def texts(values) -> str:
    return "(" + ", ".join(text(v) for v in values) + ")"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def benign(x: str) -> str:
    return f"coalesce(lower({strip(x)}) IN {texts(D.BENIGN_LABELS)}, false)"


def threat(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT {benign(x)})"


def case_map(key: str, mapping: dict, default: str) -> str:
    branches = " ".join(f"WHEN {text(k) if isinstance(k, str) else k} THEN {text(v)}" for k, v in mapping.items())
    return f"(CASE {key} {branches} ELSE {default} END)"


def canonical(x: str) -> str:
    key = f"lower({strip(x)})"
    return case_map(key, {a: g for g, aliases in D.LABEL_ALIASES.items() for a in aliases}, key)


def match(p: str, a: str) -> str:
    return f"coalesce({p} <> '' AND {a} <> '' AND {canonical(p)} = {canonical(a)}, false)"


def attack_norm(x: str) -> str:
    key = f"lower({strip(x)})"
    contained = " ".join(f"WHEN contains({key}, {text(k)}) THEN {text(v)}" for k, v in D.ATTACK_TYPE_KEYS)
    return case_map(key, dict(D.ATTACK_TYPE_KEYS), f"CASE {contained} ELSE 'Generic' END")


def resolve(category: str, binary: str) -> str:
    first = f"CASE WHEN {category} IS NULL AND {binary} = 0 THEN 'Normal' WHEN {category} IS NULL AND {binary} = 1 THEN 'Attack' ELSE {category} END"
    return tidy(f"({first})")


def tidy(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {strip(x)} IN {texts(D.EMPTY_LABEL_MARKERS)} THEN 'Normal' ELSE {strip(x)} END"


LABEL_ROWS = ", ".join(
    f"({text(s)}, {text(raw)}, {text(label)})" for s, labels in D.LABELS_BY_SOURCE.items() for raw, label in labels.items())
ORIGINAL = f"CASE WHEN dataset_source = '{D.CIC}' THEN {strip('raw_label')} ELSE {resolve('raw_label', 'raw_binary')} END"
LAB = (
    f"(SELECT fl.*, coalesce(m.label, 'Unknown') AS label FROM (SELECT *, {ORIGINAL} AS label_original FROM {FL}) fl "
    f"LEFT JOIN (VALUES {LABEL_ROWS}) m(src, raw, label) ON fl.dataset_source = m.src AND fl.label_original = m.raw)")
GRID_ROWS = ", ".join(f"({text(c[0])}, {i}, {c[1]}, {c[2]}, {c[3]}, {c[4]})" for i, c in enumerate(D.CONFIG_GRID, 1))
RUNS = (
    "(SELECT *, label AS ground_truth, flow_id AS record_key, " + ", ".join(f"{sql} AS {name}" for name, sql in RUN_COLUMNS.items()) +
    f" FROM {LAB} l CROSS JOIN (VALUES {GRID_ROWS}) g(config, c, use_rag, rerank, two_stage, use_rf))")


def md5(seed: int, key: str = "flow_id") -> str:
    return f"md5(concat('{seed}-', CAST({key} AS VARCHAR)))"


# ---------------------------------------------------------------- class rules

def rate_class(rate: str, volume: str | None, least: int, limits, duration: str | None) -> str:
    top, high, mid, low = limits
    ok = "true" if volume is None else f"({volume} >= {least} AND {duration} >= 0.1)"
    return (f"CASE WHEN {rate} IS NULL OR {rate} <= 0 THEN 'ZERO' WHEN {rate} > {top} THEN CASE WHEN {ok} THEN 'FLOOD' ELSE 'INDETERMINADA' END "
            f"WHEN {rate} > {high} THEN CASE WHEN {ok} THEN 'ALTA' ELSE 'BURST' END WHEN {rate} > {mid} THEN 'MODERADA' "
            f"WHEN {rate} > {low} THEN 'BAIXA' ELSE 'QUASE ZERO' END")


PACKET_LIMITS, BYTE_LIMITS = (1000, 100, 10, 0.1), (10000000, 1000000, 10000, 100)
PACKET_CLASS = rate_class("pkt_rate", "total_pkts", 20, PACKET_LIMITS, "duration")
BYTE_CLASS = rate_class("byte_rate", "total_bytes", 10000, BYTE_LIMITS, "duration")
DURATION_CLASS = ("CASE WHEN duration <= 0 THEN 'INSTANTÂNEA' WHEN duration < 0.001 THEN 'INSTANT' WHEN duration < 1 THEN 'SHORT' "
                  "WHEN duration < 60 THEN 'MEDIUM' WHEN duration < 600 THEN 'LONG' ELSE 'VERY LONG' END")
RATIO = "(fwd_bytes / greatest(bwd_bytes, 1))"
SHAPE = ("CASE WHEN fwd_pkts = 0 AND bwd_pkts = 0 THEN 'VAZIO' WHEN bwd_pkts = 0 THEN 'UNIDIRECIONAL' WHEN fwd_pkts = 0 THEN 'REVERSO ANÔMALO' "
         "WHEN fwd_bytes = 0 AND bwd_bytes = 0 THEN 'HANDSHAKE-ONLY' WHEN bwd_bytes = 0 THEN 'QUERY' WHEN fwd_bytes = 0 THEN 'ANSWER' "
         f"WHEN {RATIO} > 100 THEN 'EXFILTRAÇÃO' WHEN {RATIO} > 10 THEN 'UPLOAD' WHEN {RATIO} < 0.01 THEN 'DOWNLOAD' "
         f"WHEN {RATIO} < 0.1 THEN 'DOWNLOAD-HEAVY' ELSE 'SIMÉTRICO' END")
PATTERNS = {
    "SYN-only": "syn > 0 AND ack = 0 AND fin = 0",
    "ACK-only": "ack > 0 AND syn = 0 AND fin = 0 AND psh = 0 AND urg = 0",
    "FIN scan": "fin = 1 AND syn = 0",
    "SYN+RST": "rst > 0 AND syn > 0",
    "XMAS scan": "urg > 0 AND psh > 0 AND fin > 0",
    "SYN+ACK+PSH": "syn > 0 AND ack > 0 AND psh > 0",
}
IS_CIC, IS_UNSW = f"dataset_source = '{D.CIC}'", f"dataset_source = '{D.UNSW}'"
LONG_ENOUGH = "duration >= 0.1 AND total_pkts >= 20"
DIALOG = f"({SHAPE}) IN ('SIMÉTRICO', 'DOWNLOAD', 'DOWNLOAD-HEAVY')"
UNKNOWN_PROTO = f"(proto_number IS NOT NULL AND proto_number NOT IN ({', '.join(map(str, D.PROTOCOL_NAMES))}))"
SIGNATURES = {
    "flood": f"pkt_rate > 1000 AND {LONG_ENOUGH}",
    "syn_flood": f"{IS_CIC} AND syn >= 5 AND ack = 0 AND bwd_pkts = 0",
    "syn_scan": f"{IS_CIC} AND syn > 0 AND syn < 5 AND ack = 0 AND bwd_pkts = 0",
    "slow_recon": "duration > 60 AND fwd_pkts <= 5 AND bwd_pkts = 0",
    "brute_force": f"{IS_CIC} AND duration > 0.1 AND duration < 10 AND fwd_pkts > 5 AND bwd_pkts > 0 AND psh > 0",
    "exfiltration": f"fwd_bytes > 100000 AND {LONG_ENOUGH} AND fwd_pkts > 2 * bwd_pkts AND byte_rate > 100000",
    "c2_beacon": f"duration > 300 AND pkt_rate > 0 AND pkt_rate < 10 AND {DIALOG}",
    "likely_benign": f"pkt_rate > 1 AND pkt_rate < 100 AND duration > 0.5 AND duration < 300 AND {DIALOG}",
    "rejected_scan": f"{IS_UNSW} AND state = 5 AND bwd_pkts = 0",
    "request_probe": f"{IS_UNSW} AND state = 4",
    "unknown_protocol": f"{IS_UNSW} AND service = 0 AND {UNKNOWN_PROTO} AND duration < 0.001",
    "ftp_probe": f"{IS_UNSW} AND service = 2 AND bwd_pkts = 0",
}


def hits(rules: dict[str, str], separator: str, wording: dict[str, str] | None = None, lead: str = "") -> str:
    shown = {k: lead + (wording[k] if wording else k) for k in rules}
    return f"concat_ws({separator}, " + ", ".join(f"CASE WHEN {test} THEN {text(shown[k])} END" for k, test in rules.items()) + ")"


# ---------------------------------------------------------------- number formats

def p(pattern: str, x: str) -> str:
    return f"printf('{pattern}', CAST({x} AS DOUBLE))"


def fmt_time(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN '0s' WHEN {x} < 0.001 THEN {p('%.0f', f'{x} * 1000000')} || 'μs' WHEN {x} < 1 THEN {p('%.1f', f'{x} * 1000')} || 'ms' "
            f"WHEN {x} < 60 THEN {p('%.2f', x)} || 's' WHEN {x} < 3600 THEN {p('%.1f', f'{x} / 60')} || 'min' ELSE {p('%.1f', f'{x} / 3600')} || 'h' END")


def fmt_bytes(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN '0 B' WHEN {x} < 1024 THEN {p('%.0f', x)} || 'B' WHEN {x} < 1048576 THEN {p('%.1f', f'{x} / 1024')} || 'KB' "
            f"WHEN {x} < 1073741824 THEN {p('%.1f', f'{x} / 1048576')} || 'MB' ELSE {p('%.2f', f'{x} / 1073741824')} || 'GB' END")


def fmt_rate(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR {x} <= 0 THEN '0' WHEN {x} < 1000 THEN {p('%.1f', x)} WHEN {x} < 1000000 THEN {p('%.1f', f'{x} / 1000')} || 'K' "
            f"WHEN {x} < 1000000000 THEN {p('%.1f', f'{x} / 1000000')} || 'M' ELSE {p('%.2f', f'{x} / 1000000000')} || 'G' END")


def fmt_value(x: str) -> str:
    return f"CASE WHEN {x} = trunc({x}) THEN {p('%.0f', x)} ELSE {p('%.3f', x)} END"


def worded(code: str, wording: dict[str, str], value: str) -> str:
    branches = []
    for name, template in wording.items():
        if "{}" in template:
            before, after = template.split("{}")
            branches.append(f"WHEN {text(name)} THEN {text(before)} || ({value}) || {text(after)}")
        else:
            branches.append(f"WHEN {text(name)} THEN {text(template)}")
    return f"CASE {code} {' '.join(branches)} END"


PROTO = f"CASE WHEN proto_number IS NULL THEN 'desconhecido' ELSE {case_map('proto_number', D.PROTOCOL_NAMES, chr(39) + 'protocolo ' + chr(39) + ' || CAST(proto_number AS VARCHAR)')} END"
SIZE_NOTE = "CASE WHEN pkt_max <= 60 AND pkt_mean <= 60 THEN 'small' WHEN pkt_min = pkt_max THEN 'uniform' WHEN pkt_std > pkt_mean THEN 'variable' ELSE '' END"
WINDOW_NOTE = "CASE WHEN fwd_win < 1024 THEN 'small' WHEN fwd_win > 60000 THEN 'large' ELSE '' END"
TTL_NOTE = ("CASE WHEN d_ttl = 0 AND s_ttl > 0 THEN 'dropped' WHEN s_ttl IN (254, 255) THEN 'high' WHEN s_ttl = 64 THEN 'linux' "
            "WHEN s_ttl = 128 THEN 'windows' ELSE '' END")
FLAGS = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN {c} > 0 THEN '{n}=' || CAST({c} AS VARCHAR) END"
    for n, c in (("SYN", "syn"), ("FIN", "fin"), ("RST", "rst"), ("PSH", "psh"), ("ACK", "ack"), ("URG", "urg"), ("ECE", "ece"), ("CWR", "cwr"))) + ")"
FLAGS = f"CASE WHEN {FLAGS} = '' THEN '(nenhuma)' ELSE {FLAGS} END"


def describe_sql() -> str:
    shape_value = f"CASE WHEN shape IN ('EXFILTRAÇÃO', 'UPLOAD') THEN {p('%.0f', 'ratio')} WHEN shape IN ('DOWNLOAD', 'DOWNLOAD-HEAVY') THEN {p('%.0f', '1 / ratio')} ELSE {p('%.2f', 'ratio')} END"
    common = [
        f"'DURAÇÃO: ' || ({worded('duration_class', D.DURATION_TEXT, fmt_time('duration'))})",
        f"'TAXA DE PACOTES: ' || ({worded('packet_class', D.PACKET_RATE_TEXT, fmt_rate('pkt_rate'))})",
        f"'TAXA DE BYTES: ' || ({worded('byte_class', D.BYTE_RATE_TEXT, fmt_rate('byte_rate'))})",
        f"'FORMA DO FLUXO: ' || ({worded('shape', D.SHAPE_TEXT, shape_value)})",
    ]
    volume = lambda a, b: (f"'VOLUME: ' || CAST(fwd_pkts AS VARCHAR) || ' pkts {a} (' || ({fmt_bytes('fwd_bytes')}) || ') | ' || "
                           f"CAST(bwd_pkts AS VARCHAR) || ' pkts {b} (' || ({fmt_bytes('bwd_bytes')}) || ')'")
    marks = f"CASE WHEN sigs <> '' THEN 'ASSINATURAS DETECTADAS:' || chr(10) || sigs END"
    whole = lambda x: f"CAST(CAST(trunc({x}) AS BIGINT) AS VARCHAR)"
    cic = ", ".join([
        f"'=== FLUXO ' || proto || ' ({D.CIC}) ==='", *common, volume("fwd", "bwd"),
        f"CASE WHEN pkt_max > 0 THEN 'TAMANHO PKT: min=' || {whole('pkt_min')} || ', max=' || {whole('pkt_max')} || ', média=' || {whole('pkt_mean')} || ' bytes' || {case_map(f'({SIZE_NOTE})', D.SIZE_NOTES, chr(39) * 2)} END",
        f"'FLAGS TCP: ' || ({FLAGS})",
        f"CASE WHEN patterns <> '' THEN 'PADRÃO DE FLAGS: ' || patterns END",
        f"CASE WHEN fwd_win > 0 THEN 'JANELA TCP: fwd=' || CAST(fwd_win AS VARCHAR) || CASE WHEN bwd_win > 0 THEN ', bwd=' || CAST(bwd_win AS VARCHAR) ELSE '' END || {case_map(f'({WINDOW_NOTE})', D.WINDOW_NOTES, chr(39) * 2)} END",
        marks])
    unsw = ", ".join([
        f"'=== FLUXO ' || proto || ' ({D.UNSW}) ==='",
        f"'SERVIÇO: ' || {case_map('service', D.SERVICE_HINTS, text('outro'))} || ' | ESTADO: ' || {case_map('state', D.STATE_HINTS, text('desconhecido'))} || ' (' || {case_map('state', D.STATE_MEANINGS, text(''))} || ')'",
        *common, volume("src→dst", "dst→src"),
        f"CASE WHEN s_load > 0 OR d_load > 0 THEN 'BPS: src=' || ({fmt_rate('s_load')}) || ', dst=' || ({fmt_rate('d_load')}) END",
        "CASE WHEN s_mean <> 0 OR d_mean <> 0 THEN 'TAMANHO MÉDIO PKT: src=' || CAST(s_mean AS VARCHAR) || 'B, dst=' || CAST(d_mean AS VARCHAR) || 'B' END",
        f"CASE WHEN s_ttl > 0 OR d_ttl > 0 THEN 'TTL: src=' || CAST(s_ttl AS VARCHAR) || ', dst=' || CAST(d_ttl AS VARCHAR) || {case_map(f'({TTL_NOTE})', D.TTL_NOTES, text(''))} END",
        f"CASE WHEN repeats > 0 THEN 'CONEXÕES PRÉVIAS no mesmo state/TTL: ' || CAST(repeats AS VARCHAR) || CASE WHEN repeats >= 5 THEN {text(D.REPEAT_NOTE)} ELSE '' END END",
        f"CASE WHEN same_ends = 1 THEN {text(D.LAND_ANOMALY)} END",
        "CASE WHEN http_methods > 0 THEN 'MÉTODOS HTTP no fluxo: ' || CAST(http_methods AS VARCHAR) END",
        "CASE WHEN ftp_login > 0 OR ftp_commands > 0 THEN 'COMANDOS FTP: ' || CAST(ftp_commands AS VARCHAR) || ' (login=' || CAST(ftp_login AS VARCHAR) || ')' END",
        marks])
    return (f"SELECT flow_id, CASE WHEN {IS_CIC} THEN concat_ws(chr(10), {cic}) ELSE concat_ws(chr(10), {unsw}) END AS description FROM ("
            f"SELECT *, {DURATION_CLASS} AS duration_class, {PACKET_CLASS} AS packet_class, {BYTE_CLASS} AS byte_class, {SHAPE} AS shape, {RATIO} AS ratio, {PROTO} AS proto, "
            f"{hits(SIGNATURES, 'chr(10)', D.SIGNATURE_TEXT, '  ')} AS sigs, {hits(PATTERNS, text('; '), D.FLAG_PATTERN_TEXT)} AS patterns FROM {FL}) d")


# ---------------------------------------------------------------- flagship, scans, unions

ORACLES["triage_overview"] = (
    f"SELECT dataset_source, {SHAPE} AS shape, {PACKET_CLASS} AS rate_class, count(*) AS n_flows, count(*) FILTER ({threat('label')}) AS n_threats, "
    f"round(count(*) FILTER ({threat('label')}) / count(*), 6) AS threat_share FROM {LAB} GROUP BY ALL")
ORACLES["unified_scan"] = (
    f"SELECT dataset_source, count(*) AS n, count(*) FILTER ({IS_CIC}) AS n_cic_packets, count(*) FILTER ({IS_UNSW}) AS n_unsw_packets, "
    f"CAST(sum(fwd_pkts) FILTER ({IS_CIC}) AS BIGINT) AS cic_packets, CAST(sum(fwd_pkts) FILTER ({IS_UNSW}) AS BIGINT) AS unsw_packets FROM {FL} GROUP BY 1")
ORACLES["scan_csv_union"] = (
    f"SELECT {strip('raw_label')} AS label, 2 * count(*) AS n, count(*) AS n_duration, CAST(2 * sum(fwd_pkts) AS BIGINT) AS fwd_packets, "
    f"CAST(sum(bwd_pkts) AS BIGINT) AS bwd_packets FROM {FL} WHERE {IS_CIC} GROUP BY 1")
ORACLES["unified_write"] = (
    f"SELECT label, count(*) AS n, CAST(sum(fwd_pkts) AS BIGINT) AS fwd_pkts, round(sum(fwd_bytes), 2) AS fwd_bytes FROM {LAB} WHERE {IS_UNSW} GROUP BY 1")
ORACLES["scaling_params_reapplied"] = (
    "SELECT l_returnflag, " + ", ".join(f"round(avg(({c} - lo_{c}) / (hi_{c} - lo_{c})), 6) AS {c}" for c in NUMBERS) + " FROM lineitem, (SELECT " +
    ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMBERS) + " FROM lineitem) r GROUP BY 1")
ORACLES["unify"] = (
    f"SELECT flow_id, dataset_source, CASE WHEN {IS_CIC} THEN fwd_pkts ELSE 0 END AS fwd_pkts, "
    f"CASE WHEN {IS_CIC} AND flow_id % 3 <> 0 THEN CAST(k AS DOUBLE) ELSE 0 END AS protocol, "
    f"round(CASE WHEN {IS_UNSW} THEN bwd_bytes ELSE 0 END, 6) AS bwd_bytes, round(CASE WHEN {IS_UNSW} AND flow_id % 5 <> 0 THEN duration ELSE 0 END, 6) AS dur FROM {FL}")
ORACLES["corpus_counts"] = (
    "SELECT source, count(*) AS n_documents FROM (SELECT source, text FROM documents UNION ALL SELECT 'pages', html FROM pages UNION ALL SELECT 'benchmark', text FROM benchmark) u "
    "WHERE text IS NOT NULL GROUP BY ROLLUP (source)")

# ---------------------------------------------------------------- cleaning

ORACLES["drop_identifiers"] = f"SELECT fwd_pkts, bwd_pkts FROM {FL}"
ORACLES["label_map"] = f"SELECT flow_id, label_original, label, dataset_source FROM {LAB}"
ORACLES["label_resolve"] = (
    f"SELECT flow_id, {resolve('raw_label', 'raw_binary')} AS both, {tidy('raw_label')} AS category_only, "
    f"CASE raw_binary WHEN 0 THEN 'Normal' WHEN 1 THEN 'Attack' END AS binary_only FROM {FL}")
ORACLES["unmapped_labels"] = f"SELECT dataset_source, label_original, count(*) AS n FROM {LAB} WHERE label = 'Unknown' GROUP BY ALL"


def fin(x: str) -> str:
    return f"CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END"


FINITE = f"(SELECT flow_id, {fin('flow_rate')} AS flow_rate, fwd_length, total_count FROM {DI})"
PRESENT = f"(SELECT * FROM {FINITE} WHERE coalesce(flow_rate, fwd_length, total_count) IS NOT NULL)"
ORACLES["clean_nonfinite"] = f"SELECT * FROM {FINITE}"
ORACLES["drop_all_null"] = f"SELECT * FROM {PRESENT}"
MEDIANS = f"(SELECT median(flow_rate) AS a, median(fwd_length) AS b, median(total_count) AS c FROM {PRESENT})"
ORACLES["median_impute"] = (
    f"SELECT flow_id, round(coalesce(flow_rate, a), 6) AS flow_rate, round(coalesce(fwd_length, b), 6) AS fwd_length, "
    f"round(coalesce(CAST(total_count AS DOUBLE), c), 6) AS total_count FROM {PRESENT} d, {MEDIANS} m")
ORACLES["clip_negative"] = (
    "SELECT flow_id, CASE WHEN flow_rate < 0 THEN 0 ELSE flow_rate END AS flow_rate, CASE WHEN fwd_length < 0 THEN 0 ELSE fwd_length END AS fwd_length, "
    f"total_count FROM {FINITE}")
ORACLES["coerce_numeric"] = f"SELECT flow_id, try_cast(nullif({strip('mixed')}, '-') AS DOUBLE) AS mixed, service_name FROM {DI}"
ORACLES["label_encode"] = f"SELECT flow_id, service_name, dense_rank() OVER (ORDER BY coalesce(service_name, 'nan')) - 1 AS service_name_code FROM {DI}"
ORACLES["column_medians"] = " UNION ALL ".join(f"SELECT '{c}' AS column_name, median({c}) AS median_value FROM lineitem" for c in NUMBERS)
ORACLES["column_minmax"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, min({c}) + 0.0 AS min_value, max({c}) + 0.0 AS max_value FROM lineitem" for c in NUMBERS)
ORACLES["minmax_scale"] = (
    "SELECT " + ", ".join(f"round(({c} - lo_{c}) / (hi_{c} - lo_{c}), 6) AS {c}" for c in NUMBERS) + ", CAST(0 AS DOUBLE) AS constant FROM lineitem, (SELECT " +
    ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in NUMBERS) + " FROM lineitem) r")
_count = lambda test: f"count(*) FILTER ({test})"
ORACLES["quality_counters"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_count(f'{c} IS NULL')} AS n_null, {_count(f'isnan(CAST({c} AS DOUBLE))')} AS n_nan, {_count(f'isinf(CAST({c} AS DOUBLE))')} AS n_inf, "
    f"{_count(f'{c} < 0 AND isfinite(CAST({c} AS DOUBLE))')} AS n_negative FROM {DI}" for c in ("flow_rate", "fwd_length", "total_count"))
ORACLES["dataset_report"] = (
    "SELECT CAST(sum(n) AS BIGINT) AS records, 6 AS columns, 3 AS numeric_features, string_agg(label || '=' || CAST(n AS VARCHAR), '|' ORDER BY label) AS label_distribution, "
    f"'label|label_original|dataset_source|fwd_pkts|bwd_bytes|flow_id' AS column_names FROM (SELECT label, count(*) AS n FROM {LAB} GROUP BY 1) g")
ORACLES["label_distribution"] = f"SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM {LAB} GROUP BY 1"
ORACLES["source_label_rollup"] = (
    f"SELECT dataset_source, label, count(*) AS n, CAST(grouping_id(dataset_source, label) AS INT) AS level FROM {LAB} GROUP BY ROLLUP (dataset_source, label)")
ORACLES["threat_flag"] = (
    f"SELECT flow_id, {threat('raw_label')} AS threat, {benign('raw_label')} AS benign, CASE WHEN {benign('raw_label')} THEN 0 ELSE 1 END AS target FROM {FL}")

# ---------------------------------------------------------------- reduction

FEATURES = {**{c: c for c in NUMBERS}, "price_twice": "l_extendedprice * 2 + 1", "quantity_back": "l_quantity * -3.0", "price_mix": "l_extendedprice * 2 + l_quantity"}
ALL_FEATURES = {**FEATURES, "always": "7", "one_or_null": "CASE WHEN l_quantity > 25 THEN 1.0 END"}
ORACLES["constant_columns"] = "SELECT column_name FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(DISTINCT {e}) AS d FROM lineitem" for c, e in ALL_FEATURES.items()) + ") u WHERE d <= 1"


def corr_union() -> str:
    names = list(FEATURES)
    return " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, {j} AS pos_b, corr({FEATURES[a]}, {FEATURES[b]}) AS r FROM lineitem"
        for i, a in enumerate(names) for j, b in enumerate(names) if i < j)


ORACLES["corr_pairs"] = f"SELECT col_a, col_b, round(r, 6) AS r FROM ({corr_union()}) u"
ORACLES["corr_pairs_wide"] = (
    "WITH v AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) "
    "SELECT printf('d%02d', a.i) AS col_a, printf('d%02d', b.i) AS col_b, round(corr(a.x, b.x), 6) AS r FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i")
DROPPED = f"SELECT col_b AS column_name, pos_b AS position, round(max(abs(r)), 6) AS max_abs_r FROM ({corr_union()}) u GROUP BY 1, 2 HAVING max(abs(r)) > 0.95"
ORACLES["corr_drop"] = DROPPED
ORACLES["reduced_columns"] = (
    "SELECT i AS position, c AS column_name, c NOT IN ('always', 'one_or_null') AND c NOT IN (SELECT column_name FROM (" + DROPPED + ") d) AS kept FROM (VALUES " +
    ", ".join(f"({i}, '{c}')" for i, c in enumerate(ALL_FEATURES)) + ") n(i, c)")

# ---------------------------------------------------------------- sampling

ORACLES["sample_n"] = f"SELECT flow_id, dataset_source FROM {FL} ORDER BY {md5(42)}, flow_id LIMIT 500"


def stratified(source: str, n: int, seed: int, columns: str = "*") -> str:
    return (f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {md5(seed)}, flow_id) AS rn FROM {source}) s "
            f"WHERE label IS NOT NULL AND rn <= (SELECT greatest(1, {n} // count(DISTINCT label)) FROM {source})")


ORACLES["stratified_sample"] = stratified(LAB, 300, 42, "flow_id, label")
ORACLES["presample"] = (
    f"SELECT flow_id, dataset_source FROM (SELECT *, row_number() OVER (PARTITION BY dataset_source ORDER BY {md5(7)}, flow_id) AS rn FROM {FL}) s WHERE rn <= 250")
ORACLES["fraction_sample"] = f"SELECT flow_id FROM {FL} WHERE CAST(concat('0x', left({md5(42)}, 7)) AS BIGINT) / 268435456 < 0.2"
ORACLES["stratified_split"] = (
    f"SELECT flow_id, label, row_number() OVER (PARTITION BY label ORDER BY {md5(42)}, flow_id) <= floor(count(*) OVER (PARTITION BY label) * 0.2 + 0.5) AS is_test FROM {LAB}")
ORACLES["pick_record"] = f"SELECT flow_id, label, fwd_pkts FROM {LAB} WHERE flow_id = 42"

# ---------------------------------------------------------------- classes and descriptions

ORACLES["packet_rate_class"] = f"SELECT flow_id, {PACKET_CLASS} AS guarded, {rate_class('pkt_rate', None, 0, PACKET_LIMITS, None)} AS plain FROM {FL}"
ORACLES["byte_rate_class"] = f"SELECT flow_id, {BYTE_CLASS} AS guarded, {rate_class('byte_rate', None, 0, BYTE_LIMITS, None)} AS plain FROM {FL}"
ORACLES["duration_class"] = f"SELECT flow_id, {DURATION_CLASS} AS duration_class FROM {FL}"
ORACLES["flow_shape"] = f"SELECT flow_id, {SHAPE} AS shape FROM {FL}"
ORACLES["flag_patterns"] = f"SELECT flow_id, {hits(PATTERNS, text('|'))} AS patterns FROM {FL}"
ORACLES["signature_hits"] = f"SELECT flow_id, {hits(SIGNATURES, text('|'))} AS signatures FROM {FL}"
ORACLES["flag_text"] = f"SELECT flow_id, {FLAGS} AS flags FROM {FL}"
ORACLES["describe_flow"] = describe_sql()
_floats = {"value", "fwd_bytes", "bwd_bytes", "pkt_mean"}
_generic = ", ".join(
    f"CASE WHEN {c} IS NOT NULL AND {c} <> 0 THEN '{c}=' || ({fmt_value(c) if c in _floats else f'CAST({c} AS VARCHAR)'}) END" for c in GENERIC_COLUMNS if c != "dataset_source")
ORACLES["describe_generic"] = (
    f"SELECT flow_id, {text(D.GENERIC_LEAD + ': ')} || array_to_string(list_slice(list_filter([{_generic}], lambda x: x IS NOT NULL), 1, 15), ', ') || '.' AS description FROM {FL}")
ORACLES["proto_name"] = f"SELECT flow_id, {PROTO} AS proto FROM {FL}"
ORACLES["hint_lookup"] = (
    f"SELECT flow_id, {case_map('service', D.SERVICE_HINTS, text('outro'))} AS service_hint, {case_map('state', D.STATE_HINTS, text('desconhecido'))} AS state_hint, "
    f"{case_map('state', D.STATE_MEANINGS, text(''))} AS state_meaning FROM {FL}")
ORACLES["size_notes"] = f"SELECT flow_id, {SIZE_NOTE} AS size_note, {WINDOW_NOTE} AS window_note, {TTL_NOTE} AS ttl_note FROM {FL}"
ORACLES["fmt_numbers"] = (
    f"SELECT flow_id, {fmt_time('t')} AS time_text, {fmt_bytes('b')} AS bytes_text, {fmt_rate('r')} AS rate_text, "
    f"replace(format('{{:,}}', CAST(trunc(b) AS BIGINT)), ',', '.') AS count_text, {fmt_value('v')} AS value_text "
    f"FROM (SELECT flow_id, duration_s * 40 AS t, fwd_bytes * 30 AS b, byte_rate * 9 AS r, value / 4 AS v FROM {FL}) x")

# ---------------------------------------------------------------- knowledge

BLANK = "[\\s\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x0b\\x1c-\\x1f]+"


def clean(x: str) -> str:
    step = f"regexp_replace({x}, '\\(Citation:[^)]+\\)', '', 'g')"
    step = f"regexp_replace({step}, '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g')"
    step = f"regexp_replace({step}, '<[^>]+>', '', 'g')"
    return f"trim(regexp_replace({step}, '{BLANK}', ' ', 'g'))"


ORACLES["clean_text"] = f"SELECT page_id, {clean('html')} AS text FROM pages"
EDGES = (
    "(SELECT l_orderkey * 8 + l_linenumber AS position, 'S' || l_suppkey AS s, 'P' || l_partkey AS t FROM lineitem "
    "WHERE NOT (l_linestatus = 'F' AND l_quantity < 5) AND l_returnflag = 'R')")
PARTS_TEXT = "'Uses [' || p_name || '](http://x/' || p_partkey || ')  <b>' || p_type || '</b> (Citation: ' || p_brand || ')'"
NAMED = (
    f"(SELECT 'P' || p_partkey AS id, p_name AS name, {PARTS_TEXT} AS description FROM part UNION ALL "
    "SELECT 'S' || s_suppkey, s_name, CASE WHEN s_suppkey % 7 <> 0 THEN 'Supplier <i>' || s_name || '</i> (Citation: a)' END FROM supplier)")
RELATED = (
    "(SELECT id, rank, name, description FROM (SELECT e.id, n.name, n.description, row_number() OVER (PARTITION BY e.id ORDER BY position, direction, related_id) AS rank "
    f"FROM (SELECT s AS id, t AS related_id, 0 AS direction, position FROM {EDGES} UNION ALL SELECT t, s, 1, position FROM {EDGES}) e JOIN {NAMED} n ON n.id = e.related_id "
    "WHERE n.name <> '' AND n.description <> '') q WHERE rank <= 5)")
ORACLES["adjacency_top5"] = f"SELECT * FROM {RELATED}"
ORACLES["technique_doc"] = (
    "SELECT 'T' || (1000 + p_partkey) AS id, 'T' || (1000 + p_partkey) || ' - ' || p_name AS title, concat_ws(chr(10), "
    "'Técnica MITRE ATT&CK: T' || (1000 + p_partkey) || ' - ' || p_name, 'Táticas: ' || upper(left(p_type, 1)) || lower(substring(p_type, 2)) || ' And Control', "
    f"'Plataformas: ' || p_brand || ', ' || p_type, 'Descrição: ' || {clean(PARTS_TEXT)}, "
    "CASE WHEN lines IS NOT NULL THEN 'Mitigações:' || chr(10) || lines END, CASE WHEN p_size % 3 = 0 THEN 'Detecção: Watch ' || p_brand END) AS text "
    f"FROM part LEFT JOIN (SELECT id, string_agg('  - ' || name || ': ' || {clean('description')}, chr(10) ORDER BY rank) AS lines FROM {RELATED} GROUP BY id) m ON m.id = 'P' || p_partkey "
    "WHERE p_size % 10 <> 0 AND p_partkey % 23 <> 0 AND p_partkey % 17 <> 0")
RULE_TITLE = "p_name || ' ' || p_partkey"
ORACLES["rule_doc"] = (
    f"SELECT CASE WHEN p_partkey % 11 = 0 THEN sha256({RULE_TITLE}) ELSE 'r-' || p_partkey END AS id, {RULE_TITLE} AS title, concat_ws(chr(10), "
    f"'Regra Sigma: ' || {RULE_TITLE}, 'Severidade: ' || CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'low' END, 'Status: unknown', "
    "CASE WHEN p_size % 4 <> 0 THEN 'Descrição: Finds ' || p_type END, 'Tags MITRE ATT&CK: attack.t' || p_size, 'Fonte de log: product=' || p_brand || ', service=s1', "
    "'Lógica de detecção: Condição: selection or words' || chr(10) || '  selection: Image=' || p_type || ', Size=' || p_size || chr(10) || '  words: [a1, a2, a3, a4, a5, a6, a7, a8, a9, a10]', "
    "CASE WHEN p_size % 5 <> 0 THEN 'Falsos positivos conhecidos: admin ' || p_brand || '; backup' END) AS text FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 13 <> 0")
ORACLES["rule_rejects"] = (
    "SELECT CASE WHEN p_partkey % 17 = 0 THEN 'not YAML' ELSE 'no title' END AS error, count(*) AS n_files FROM part WHERE p_partkey % 17 = 0 OR p_partkey % 13 = 0 GROUP BY 1")

# ---------------------------------------------------------------- retrieval

CENTROIDS = (
    "(SELECT label AS query_id, list(m ORDER BY pos) AS q FROM (SELECT label, pos, avg(v) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS pos, "
    "CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) u GROUP BY 1, 2) g GROUP BY 1)")
LETTER_COUNTS = "[" + ", ".join(f"CAST(length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{x}{x.upper()}', '')) AS DOUBLE)" for x in ascii_lowercase) + "]"
CORPUS = f"(SELECT doc_id AS id, text, source, 'doc ' || doc_id AS title, {LETTER_COUNTS} AS embedding FROM documents)"


def dense(queries: str, corpus: str, k: int) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ("
            f"SELECT query_id, id, round(greatest(0, coalesce(nullif(list_cosine_distance(q, CAST(embedding AS DOUBLE[])), CAST('NaN' AS DOUBLE)), 1)), 12) AS distance FROM {queries} qq, {corpus} cc) dd) rr WHERE rank <= {k}")


VECTORS = "(SELECT vec_id AS id, embedding, label FROM embeddings)"
TEXT_QUERIES = f"(SELECT item_id AS query_id, text AS query_text, {LETTER_COUNTS} AS q FROM benchmark)"
ORACLES["doc_embed_join"] = (
    "SELECT coalesce(doc_id, vec_id) AS id, source, n_chars, CAST(len(embedding) AS INT) AS dimension, CAST(length(text) AS INT) AS text_length, "
    "CASE WHEN embedding IS NULL THEN 'no vector' WHEN text IS NULL THEN 'no document' ELSE 'paired' END AS pairing FROM documents FULL JOIN embeddings ON doc_id = vec_id")
ORACLES["knn_topk"] = f"SELECT query_id, id, round(distance, 6) AS distance, rank FROM ({dense(CENTROIDS, VECTORS, 10)}) t"
ORACLES["knn_filtered"] = f"SELECT query_id, id, rank, round(distance, 6) AS distance FROM ({dense(TEXT_QUERIES, f'(SELECT * FROM {CORPUS} WHERE source = {chr(39)}src7{chr(39)})', 3)}) t"


def reranked(pool: str, score: str, joins: str) -> str:
    return ("SELECT query_id, id, dense_distance, score, distance, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM ("
            "SELECT query_id, id, dense_distance, score, round(1 - 1 / (1 + exp(-score)), 12) AS distance FROM ("
            f"SELECT p.query_id, p.id, p.distance AS dense_distance, {score} AS score FROM ({pool}) p {joins}) s1) s2) s3 WHERE rank <= 5")


BY_LABEL = reranked(dense(CENTROIDS, VECTORS, 20), "CASE WHEN e.label = p.query_id THEN 2.0 ELSE 0.0 END - p.distance", "JOIN embeddings e ON e.vec_id = p.id")
ORACLES["knn_rerank"] = f"SELECT query_id, id, rank, round(dense_distance, 6) AS dense_distance, round(score, 6) AS score, round(distance, 6) AS distance FROM ({BY_LABEL}) t"
ORACLES["context_gate"] = (
    f"SELECT query_id, round(min(dense_distance), 6) AS best_distance, min(dense_distance) <= 0.25 AS use_context FROM ({BY_LABEL}) t GROUP BY 1")
_words = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
ORACLES["bm25_rerank"] = (
    f"WITH corpus AS (SELECT * FROM {CORPUS}), tq AS (SELECT DISTINCT query_id, unnest({_words('query_text')}) AS term FROM {TEXT_QUERIES}), "
    f"tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_words('text')}) AS term FROM corpus) w GROUP BY 1, 2), "
    f"df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), ln AS (SELECT id, len({_words('text')}) AS n FROM corpus), st AS (SELECT count(*) AS docs, avg(n) AS mean FROM ln), "
    f"pool AS ({dense(TEXT_QUERIES, CORPUS, 20)}), "
    "sc AS (SELECT pool.query_id, pool.id, sum(ln(1.0 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))) AS score "
    "FROM pool JOIN tq ON tq.query_id = pool.query_id JOIN tf ON tf.id = pool.id AND tf.term = tq.term JOIN df ON df.term = tf.term JOIN ln ON ln.id = pool.id, st GROUP BY 1, 2) "
    "SELECT query_id, id, rank, round(dense_distance, 6) AS dense_distance, round(score, 6) AS score, round(distance, 6) AS distance FROM (" +
    reranked("SELECT * FROM pool", "coalesce(sc.score, 0.0)", "LEFT JOIN sc ON sc.query_id = p.query_id AND sc.id = p.id") + ") t")


def packed(k: int = 5, budget: int = 2800) -> str:
    steps = f"SELECT *, 0 AS total0, false AS full0 FROM w"
    for i in range(1, k + 1):
        room = f"({budget} - total{i - 1} - length('[' || s{i} || '] ' || t{i}) - 20)"
        shown = f"CASE WHEN length(x{i}) > {room} THEN left(x{i}, CAST({room} AS BIGINT)) || '...' ELSE x{i} END"
        block = f"CASE WHEN s{i} IS NOT NULL AND NOT full{i - 1} AND {room} > 0 THEN '--- Reference {i} (' || s{i} || ') ---' || chr(10) || {shown} END"
        steps = (f"SELECT *, total{i - 1} + coalesce(length(b{i}), 0) AS total{i} FROM (SELECT *, {block} AS b{i}, full{i - 1} OR {room} <= 0 AS full{i} FROM ({steps}) y{i}) z{i}")
    wide = ", ".join(f"max(CASE WHEN rank = {i} THEN source END) AS s{i}, max(CASE WHEN rank = {i} THEN title END) AS t{i}, max(CASE WHEN rank = {i} THEN text END) AS x{i}" for i in range(1, k + 1))
    blocks = ", ".join(f"b{i}" for i in range(1, k + 1))
    counted = " + ".join(f"CASE WHEN b{i} IS NULL THEN 0 ELSE 1 END" for i in range(1, k + 1))
    return (f"WITH hits AS ({dense(TEXT_QUERIES, CORPUS, k)}), w AS (SELECT query_id, {wide} FROM hits JOIN {CORPUS} c USING (id) GROUP BY 1) "
            f"SELECT query_id, concat_ws(chr(10) || chr(10), {blocks}) AS context, {counted} AS n_blocks, CAST(total{k} AS BIGINT) AS n_chars, concat_ws('|', {', '.join(f't{i}' for i in range(1, k + 1))}) AS titles FROM ({steps}) f")


ORACLES["context_pack"] = packed()
ORACLES["vec_upsert"] = (
    "WITH inc AS (SELECT vec_id + 250 AS id, label + 100 AS label, vec_id AS seq FROM embeddings UNION ALL SELECT vec_id % 100, label + 200, vec_id + 10000 FROM embeddings), "
    "last AS (SELECT id, arg_max(label, seq) AS label FROM inc GROUP BY 1) SELECT vec_id AS id, label FROM embeddings WHERE vec_id NOT IN (SELECT id FROM last) UNION ALL SELECT id, label FROM last")
ORACLES["collection_size"] = (
    "SELECT count(*) AS n, max(id) AS last_id FROM (SELECT vec_id AS id FROM embeddings UNION SELECT vec_id + 250 FROM embeddings) u")

# ---------------------------------------------------------------- responses and outcomes

BLOCK = "regexp_extract(response, '\\{.*\\}', 0)"
FIXED = f"regexp_replace({BLOCK}, ',\\s*([}}\\]])', '\\1', 'g')"
DOC = (f"CASE WHEN response IS NULL OR response = '' THEN NULL WHEN json_valid({strip('response')}) THEN {strip('response')} "
       f"WHEN {BLOCK} = '' THEN NULL ELSE {FIXED} END")
_js = lambda f: f"json_extract_string(doc, '$.{f}')"
_kind = lambda f: f"coalesce(json_type(doc, '$.{f}'), 'NULL')"
_field_names = ("attack_type", "severity", "confidence", "mitre_techniques", "explanation", "recommendations")
PARSED = (
    "(SELECT *, coalesce(json_type(doc) = 'OBJECT', false) AS is_object, " + ", ".join(
        f"CASE WHEN json_type(doc) = 'OBJECT' THEN {_js(f)} END AS {f}, CASE WHEN json_type(doc) = 'OBJECT' THEN {_kind(f)} ELSE 'NULL' END AS {f}_kind" for f in _field_names) +
    f" FROM (SELECT *, {DOC} AS doc FROM {RE}) p0)")
ORACLES["parse_responses"] = f"SELECT flow_id, doc IS NOT NULL AS parsed, is_object, attack_type, severity, try_cast(confidence AS DOUBLE) AS confidence, explanation FROM {PARSED}"
CONF = "try_cast(confidence AS DOUBLE)"
SCALED = f"CASE WHEN {CONF} > 1 THEN {CONF} / 100 ELSE {CONF} END"
TECHNIQUES = ("array_to_string(list_filter(list_transform(CASE WHEN mitre_techniques_kind = 'ARRAY' THEN json_extract_string(mitre_techniques, '$[*]') ELSE [] END, "
              "lambda x: regexp_extract(x, 'T\\d{4}(?:\\.\\d{3})?', 0)), lambda x: x <> ''), '|')")
RECOMMENDATIONS = "array_to_string(CASE WHEN recommendations_kind = 'ARRAY' THEN json_extract_string(recommendations, '$[*]') ELSE [] END, '|')"
ERR = D.VALIDATION_TEXT


def _wrap(key: str, value: str) -> str:
    before, after = ERR[key].split("{}")
    return f"{text(before)} || {value} || {text(after)}"


def _errors(attack: str | None, severity: str, confidence: str, conf_kind: str, mitre: bool) -> str:
    parts = []
    if attack:
        parts.append(f"CASE WHEN {attack} IS NULL OR {attack} = '' THEN {text(ERR['missing'].format('attack_type'))} WHEN {attack} NOT IN {texts(D.ATTACK_CLASSES)} THEN {_wrap('attack_type', attack)} END")
    parts.append(f"CASE WHEN {severity} IS NULL OR {severity} = '' THEN {text(ERR['missing'].format('severity'))} WHEN lower({severity}) NOT IN {texts(D.SEVERITIES)} THEN {_wrap('severity', severity)} END")
    parts.append(f"CASE WHEN {conf_kind} = 'NULL' THEN {text(ERR['missing'].format('confidence'))} WHEN {confidence} IS NULL THEN {_wrap('confidence_type', 'confidence')} "
                 f"WHEN {confidence} < 0 OR {confidence} > 1 THEN {_wrap('confidence_range', f'CAST({confidence} AS VARCHAR)')} END")
    if mitre:
        parts.append(f"CASE WHEN mitre_techniques_kind = 'NULL' THEN {text(ERR['missing'].format('mitre_techniques'))} WHEN mitre_techniques_kind <> 'ARRAY' THEN {text(ERR['list'].format('mitre_techniques'))} END")
    parts.append(f"CASE WHEN explanation_kind <> 'VARCHAR' OR explanation = '' THEN {text(ERR['explanation'])} END")
    parts.append(f"CASE WHEN recommendations_kind = 'NULL' THEN {text(ERR['missing'].format('recommendations'))} WHEN recommendations_kind <> 'ARRAY' THEN {text(ERR['list'].format('recommendations'))} END")
    return f"CASE WHEN is_object THEN concat_ws('|', {', '.join(parts)}) ELSE {text(ERR['not_object'])} END"


RAW_ERRORS = _errors("attack_type", "severity", CONF, "confidence_kind", True)
NORMAL_ERRORS = _errors(None, "lower(severity)", f"({SCALED})", "confidence_kind", False)
NORMAL = (
    f"(SELECT flow_id, {attack_norm('attack_type')} AS attack_type, lower(severity) AS severity, {SCALED} AS confidence, {TECHNIQUES} AS techniques, coalesce(explanation, '') AS explanation, "
    f"{RECOMMENDATIONS} AS recommendations, {NORMAL_ERRORS} AS errors, is_object, doc FROM {PARSED})")
ORACLES["normalise_response"] = (
    f"SELECT flow_id, attack_type, severity, round(confidence, 6) AS confidence, techniques, explanation, recommendations, errors FROM {NORMAL} WHERE is_object")
ORACLES["validate_output"] = f"SELECT flow_id, errors = '' AS valid, errors FROM (SELECT flow_id, {RAW_ERRORS} AS errors FROM {PARSED}) e"
ORACLES["technique_ids"] = (
    "SELECT flow_id, array_to_string(list_filter(list_transform(['T1' || lpad(CAST(k AS VARCHAR), 3, '0') || '.00' || (k % 10), 'none', 'see T' || (flow_id % 2000), 'T1498 and T1499'], "
    f"lambda x: regexp_extract(x, 'T\\d{{4}}(?:\\.\\d{{3}})?', 0)), lambda x: x <> ''), '|') AS techniques FROM {FL}")
ORACLES["attack_type_norm"] = (
    f"SELECT flow_id, {attack_norm('t')} AS attack_type FROM (SELECT flow_id, [{', '.join(text(t) for t in FREE_TEXTS)}][CAST(flow_id % 16 + 1 AS INT)] AS t FROM {FL}) x")
ORACLES["label_match"] = (
    f"SELECT flow_id, {match('t', 'label')} AS is_match FROM (SELECT flow_id, label, [{', '.join(text(t) for t in PREDICTED)}][CAST(flow_id % 10 + 1 AS INT)] AS t FROM {LAB}) x")
FIRST_WORD = f"regexp_extract(upper({strip('stage1_response')}), '^[^\\s]*', 0)"
DECISION = f"CASE WHEN stage1_response IS NULL THEN 'ERROR' WHEN contains({FIRST_WORD}, 'BENIGN') THEN 'BENIGN' ELSE 'THREAT' END"
ORACLES["stage1_decide"] = f"SELECT flow_id, {DECISION} AS decision FROM {RE}"
_lead, _rest = D.FLOW_PROMPT.split("{description}")
_middle, _tail = _rest.split("{context}")
_head1, _tail1 = D.STAGE1_PROMPT.split("{description}")
ORACLES["build_prompt"] = (
    f"SELECT conv_id, turn, {text(_lead)} || {strip('text')} || {text(_middle)} || CASE WHEN turn % 3 = 2 THEN role ELSE {text(D.NO_CONTEXT_TEXT)} END || {text(_tail)} AS prompt, "
    f"{text(_head1)} || {strip('text')} || {text(_tail1)} AS stage1_prompt FROM conversations")
SETTLED = "(rf_label = 'Benign' AND rf_confidence >= 0.95)"
ORACLES["rf_skip"] = f"SELECT flow_id, {SETTLED} AS skipped, CASE WHEN {SETTLED} THEN 'rf' ELSE 'open' END AS route FROM {RE}"


def outcome_sql(source: str, use_rf: str, two_stage: str, extra: str = "") -> str:
    """Final state per record of ``source`` (response columns, normal_* columns, label)."""
    settled = f"({use_rf} AND {SETTLED})"
    stage1 = f"CASE WHEN {two_stage} AND NOT {settled} THEN {DECISION} END"
    state = (f"CASE WHEN {settled} THEN 'rf' WHEN ({stage1}) = 'BENIGN' THEN 'stage1' WHEN response_error IS NOT NULL THEN 'error' WHEN doc IS NULL THEN 'unparsed' ELSE 'answer' END")
    return f"(SELECT *, {stage1} AS stage1_decision, {state} AS st {extra} FROM {source})"


TRIAGE_SOURCE = (
    f"(SELECT r.*, n.attack_type AS n_attack, n.severity AS n_severity, n.confidence AS n_confidence, n.techniques AS n_techniques, n.explanation AS n_explanation, "
    f"n.recommendations AS n_recommendations, n.errors AS n_errors, n.doc AS doc, n.is_object AS is_object FROM {RE} r JOIN {NORMAL} n USING (flow_id))")
FAILURE = f"CASE WHEN st = 'error' THEN {text(D.ERROR_MODEL_PREFIX)} || response_error ELSE {text(D.ERROR_NOT_JSON)} END"


def by_state(skip: str, answer: str, failed: str) -> str:
    return f"CASE WHEN st IN ('rf', 'stage1') THEN {skip} WHEN st = 'answer' THEN {answer} ELSE {failed} END"


ANSWER = {
    "attack_type": by_state("'Benign'", "n_attack", "'Unknown'"),
    "severity": by_state("'informational'", "CASE WHEN is_object THEN n_severity ELSE 'informational' END", "'informational'"),
    "confidence": by_state("CASE WHEN st = 'rf' THEN rf_confidence ELSE 0.75 END", "CASE WHEN is_object THEN n_confidence ELSE 0 END", "0"),
    "errors": by_state("''", "n_errors", FAILURE),
}
ORACLES["triage_outcome"] = (
    f"SELECT flow_id AS record_key, {ANSWER['attack_type']} AS attack_type, {ANSWER['severity']} AS severity, round({ANSWER['confidence']}, 6) AS confidence, "
    f"{by_state(text(''), 'n_techniques', text(''))} AS techniques, "
    f"{by_state('CASE WHEN st = ' + text('rf') + ' THEN ' + text(D.SKIP_TEXT['rf_prefilter']) + ' ELSE ' + text(D.SKIP_TEXT['stage1_benign']) + ' END', 'n_explanation', text(D.ERROR_TEXT_PREFIX) + ' || ' + FAILURE)} AS explanation, "
    f"{by_state(text(''), 'n_recommendations', text(''))} AS recommendations, 'flow ' || flow_id AS record_description, "
    "CASE WHEN st IN ('rf', 'stage1') THEN '' ELSE 't' || k END AS titles, CASE WHEN st IN ('rf', 'stage1') THEN NULL ELSE round(rf_confidence / 2, 6) END AS distance, "
    f"round(elapsed_seconds, 2) AS elapsed_seconds, 'model' AS model_name, CASE WHEN {IS_CIC} THEN {strip('raw_label')} ELSE raw_label END AS ground_truth, "
    f"CAST(CASE WHEN st IN ('answer', 'unparsed') THEN length(coalesce(response, '')) ELSE 0 END AS INT) AS raw_length, {ANSWER['errors']} AS errors, stage1_decision, "
    f"CASE st WHEN 'rf' THEN 'rf_prefilter' WHEN 'stage1' THEN 'stage1_benign' END AS stage_skipped FROM {outcome_sql(TRIAGE_SOURCE, 'true', 'true')} o")

# ---------------------------------------------------------------- evaluation


def figures(source: str, by: str, predicted: str = "attack_type", actual: str = "ground_truth", valid: str = "n_errors = 0",
            elapsed: str = "avg_elapsed_seconds", digits: int | None = None) -> str:
    tp, tn = f"count(*) FILTER ({threat(predicted)} AND {threat(actual)})", f"count(*) FILTER (NOT {threat(predicted)} AND NOT {threat(actual)})"
    fp, fn = f"count(*) FILTER ({threat(predicted)} AND NOT {threat(actual)})", f"count(*) FILTER (NOT {threat(predicted)} AND {threat(actual)})"
    mean = "avg(elapsed_seconds)" if digits is None else f"round(avg(elapsed_seconds), {digits})"
    keys = by + ", " if by else ""
    return (f"SELECT {keys}n_records, n_valid, {elapsed}, round(hit / n_records, 4) AS accuracy_exact, round((tp + tn) / n_records, 4) AS accuracy_binary, "
            "round(prec, 4) AS precision, round(rec, 4) AS recall, round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 4) AS f1, tp, tn, fp, fn FROM ("
            "SELECT *, tp / nullif(tp + fp, 0) AS prec, tp / nullif(tp + fn, 0) AS rec FROM ("
            f"SELECT {keys}count(*) AS n_records, count(*) FILTER ({valid}) AS n_valid, {mean} AS {elapsed}, count(*) FILTER ({match(predicted, actual)}) AS hit, "
            f"{tp} AS tp, {tn} AS tn, {fp} AS fp, {fn} AS fn FROM {source} s{' GROUP BY ' + by if by else ''}) g0) g1")


_t, _a = threat("attack_type"), threat("ground_truth")
_known = "NOT (config = '3_rag_only')"
ORACLES["confusion"] = "SELECT config, count(*) AS n_records, " + ", ".join(
    f"CASE WHEN config = '3_rag_only' THEN NULL ELSE count(*) FILTER ({test}) END AS {name}" for name, test in (
        ("tp", f"{_t} AND {_a}"), ("tn", f"NOT {_t} AND NOT {_a}"), ("fp", f"{_t} AND NOT {_a}"), ("fn", f"NOT {_t} AND {_a}"))) + f" FROM {RUNS} GROUP BY config"
ORACLES["triage_metrics"] = (
    f"SELECT *, 'reference' AS mode FROM ({figures(RUNS, 'config', digits=4)}) a UNION ALL SELECT *, 'valid_only' AS mode FROM ({figures(f'(SELECT * FROM {RUNS} WHERE n_errors = 0)', 'config', digits=4)}) b")
ORACLES["triage_summary"] = " UNION ALL ".join(
    f"SELECT '{item}' AS item, {name} AS name, count(*) AS n, round(avg(confidence), 4) AS avg_confidence, round(avg(elapsed_seconds), 4) AS avg_elapsed_seconds, "
    f"count(*) FILTER (n_errors = 0) AS n_valid FROM {RUNS} GROUP BY 2" for item, name in (("attack_type", "attack_type"), ("severity", "severity"), ("all", "CAST(NULL AS VARCHAR)")))
ORACLES["config_ranking"] = (
    "SELECT config, count(*) AS runs, round(avg(accuracy_exact), 4) AS avg_exact, round(avg(accuracy_binary), 4) AS avg_binary, round(avg(precision), 4) AS avg_precision, "
    f"round(avg(recall), 4) AS avg_recall, round(avg(avg_elapsed), 1) AS avg_time FROM ({figures(RUNS, 'config, dataset_source, k', elapsed='avg_elapsed')}) r GROUP BY 1")


def difference(first: str, second: str) -> str:
    side = lambda where: f"(SELECT flow_id, ground_truth, attack_type, {match('attack_type', 'ground_truth')} AS hit FROM {RUNS} WHERE {where})"
    return ("SELECT coalesce(a.flow_id, b.flow_id) AS record_key, coalesce(a.ground_truth, b.ground_truth) AS ground_truth, a.attack_type AS attack_type_a, b.attack_type AS attack_type_b, "
            "CASE WHEN a.attack_type IS NULL THEN 'only_b' WHEN b.attack_type IS NULL THEN 'only_a' WHEN a.hit AND b.hit THEN 'both_right' WHEN a.hit THEN 'lost' WHEN b.hit THEN 'gained' ELSE 'both_wrong' END AS outcome "
            f"FROM {side(first)} a FULL JOIN {side(second)} b ON a.flow_id = b.flow_id")


ORACLES["run_diff"] = difference("config = '1_baseline_norag'", "config = '5_rag_rerank_rf'")
ORACLES["run_outcome_matrix"] = (
    f"SELECT outcome, attack_type_a, attack_type_b, count(*) AS n FROM ({difference('config = ' + text('1_baseline_norag'), 'config = ' + text('6_rag_rerank_rf_2stage'))}) d GROUP BY ALL")
ORACLES["batch_progress"] = (
    "SELECT run, record_key, i AS ordinal, round(100.0 * i / n, 4) AS pct, round(s, 4) AS elapsed_total, round(s / i, 4) AS avg_elapsed, round(s / i * (n - i), 4) AS remaining FROM ("
    "SELECT config AS run, record_key, count(*) OVER w AS i, sum(elapsed_seconds) OVER w AS s, count(*) OVER (PARTITION BY config) AS n "
    f"FROM {RUNS} WINDOW w AS (PARTITION BY config ORDER BY record_key ROWS UNBOUNDED PRECEDING)) p")
ORACLES["latest_run"] = "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) e WHERE rn = 1"
ORACLES["run_tag"] = (
    "SELECT event_id, concat_ws('_', 'run', strftime(ts, '%Y%m%d_%H%M%S'), CASE WHEN event_id % 2 = 0 THEN 'rag' ELSE 'norag' END, CASE WHEN event_id % 6 = 0 THEN 'rerank' END, "
    "CASE WHEN event_id % 5 = 0 THEN '2stage' END, CASE WHEN event_id % 7 = 0 THEN 'rf' END, CASE WHEN event_id % 11 = 0 THEN 'stratified' ELSE 'random' END, 'n' || (event_id % 100)) AS run_tag FROM events")
ORACLES["result_preview"] = (
    "SELECT conv_id, turn, CASE WHEN length(text) > 150 THEN left(text, 150) || '...' ELSE text END AS explanation FROM conversations ORDER BY conv_id, turn LIMIT 3")
GRID_SOURCE = f"(SELECT t.*, l.label AS label FROM {TRIAGE_SOURCE} t JOIN {LAB} l USING (flow_id))"
GRID_SAMPLES = " UNION ALL ".join(
    f"SELECT * FROM ({stratified(GRID_SOURCE, n, seed, f'*, {n} AS n, {seed} AS seed')}) q{n}_{seed}" for n in (150, 400) for seed in (1, 2))
GRID_RUNS = f"(SELECT * FROM ({GRID_SAMPLES}) s CROSS JOIN (VALUES {GRID_ROWS}) g(config, c, use_rag, rerank, two_stage, use_rf))"
GRID_RESULTS = (
    f"(SELECT config, n, seed, round(elapsed_seconds, 2) AS elapsed_seconds, label AS ground_truth, {ANSWER['attack_type']} AS attack_type, {ANSWER['errors']} AS errors FROM {outcome_sql(GRID_RUNS, 'use_rf', 'two_stage')} o)")
ORACLES["config_grid"] = figures(GRID_RESULTS, "config, n, seed", valid="errors = ''", elapsed="avg_elapsed", digits=4)
_tags = {}
for _config, _rag, _rerank, _two, _rf in D.CONFIG_GRID:
    _parts = ["run", "rag" if _rag else "norag"] + (["rerank"] if _rag and _rerank else []) + (["2stage"] if _two else []) + (["rf"] if _rf else [])
    _tags[_config] = "_".join(_parts + ["stratified", "n9"])
ORACLES["runs_scan"] = (
    f"SELECT {case_map('config', _tags, 'NULL')} AS run_dir, n_records, n_valid, accuracy_exact, accuracy_binary, precision, recall, tp, fn, r.use_rag, r.use_rag AND r.rerank AS rerank, r.two_stage, r.use_rf, "
    f"true AS stratified, 9 AS n FROM ({figures(RUNS, 'config, use_rag, rerank, two_stage, use_rf')}) r")
ORACLES["results_write"] = f"SELECT attack_type, count(*) AS n, CAST(sum(n_errors) AS BIGINT) AS n_errors FROM {RUNS} WHERE config = '4_rag_rerank' GROUP BY 1"

# ---------------------------------------------------------------- classifier

ORACLES["class_weights"] = (
    "SELECT target, n, round(t / (2.0 * n), 6) AS weight FROM (SELECT target, count(*) AS n, sum(count(*)) OVER () AS t FROM ("
    f"SELECT CASE WHEN {benign('label')} THEN 0 ELSE 1 END AS target FROM {LAB}) y GROUP BY 1) z")
_y = f"(CASE WHEN {benign('raw_label')} THEN 0 ELSE 1 END)"
_p = "(CASE WHEN rf_label = 'Benign' THEN 0 ELSE 1 END)"
_sure = "(CASE WHEN rf_label = 'Benign' THEN rf_confidence ELSE 1 - rf_confidence END) >= 0.9"
ORACLES["coverage_risk"] = (
    "SELECT n, tn, fp, fn, tp, round((tp + tn) / n, 6) AS accuracy, round(pr, 6) AS precision_threat, round(rc, 6) AS recall_threat, round(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0), 6) AS f1_threat, "
    "round(coalesce(sb / nullif(tn + fp, 0), 0), 6) AS benign_high_confidence_coverage, round(coalesce(sm / nullif(tp + fn, 0), 0), 6) AS threat_misclassified_high_conf FROM ("
    "SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pr, coalesce(tp / nullif(tp + fn, 0), 0) AS rc FROM (SELECT count(*) AS n, "
    f"count(*) FILTER ({_y} = 0 AND {_p} = 0) AS tn, count(*) FILTER ({_y} = 0 AND {_p} = 1) AS fp, count(*) FILTER ({_y} = 1 AND {_p} = 0) AS fn, count(*) FILTER ({_y} = 1 AND {_p} = 1) AS tp, "
    f"count(*) FILTER ({_y} = 0 AND {_sure}) AS sb, count(*) FILTER ({_y} = 1 AND {_sure}) AS sm FROM {RE}) a) b")

# ---------------------------------------------------------------- whole preprocessing

CIC_ROWS = f"(SELECT d.*, {strip('f.raw_label')} AS label_original FROM {FINITE} d JOIN {FL} f USING (flow_id) WHERE f.dataset_source = '{D.CIC}' AND coalesce(d.flow_rate, d.fwd_length, d.total_count) IS NOT NULL)"
_clip = lambda x: f"round(greatest(0, {x}), 6)"
ORACLES["preprocess_cic"] = (
    f"SELECT {_clip('coalesce(flow_rate, a)')} AS flow_rate, {_clip('coalesce(fwd_length, b)')} AS fwd_length, {_clip('coalesce(CAST(total_count AS DOUBLE), c)')} AS total_count, "
    f"coalesce(m.label, 'Unknown') AS label, label_original, '{D.CIC}' AS dataset_source FROM {CIC_ROWS} d LEFT JOIN (VALUES {LABEL_ROWS}) m(src, raw, label) ON m.src = '{D.CIC}' AND m.raw = d.label_original, "
    f"(SELECT median(flow_rate) AS a, median(fwd_length) AS b, median(total_count) AS c FROM {CIC_ROWS}) q")
UNSW_ROWS = (
    f"(SELECT {fin('d.flow_rate')} AS rate, try_cast(nullif({strip('d.mixed')}, '-') AS DOUBLE) AS ct_ftp_cmd, dense_rank() OVER (ORDER BY coalesce(d.service_name, 'nan')) - 1 AS service, "
    f"{resolve('f.raw_label', 'f.raw_binary')} AS label_original FROM {DI} d JOIN {FL} f USING (flow_id) WHERE f.dataset_source = '{D.UNSW}')")
ORACLES["preprocess_unsw"] = (
    f"SELECT round(coalesce(rate, a), 6) AS rate, round(coalesce(ct_ftp_cmd, b), 6) AS ct_ftp_cmd, service, coalesce(m.label, 'Unknown') AS label, label_original, '{D.UNSW}' AS dataset_source "
    f"FROM {UNSW_ROWS} d LEFT JOIN (VALUES {LABEL_ROWS}) m(src, raw, label) ON m.src = '{D.UNSW}' AND m.raw = d.label_original, "
    f"(SELECT median(rate) AS a, median(ct_ftp_cmd) AS b FROM {UNSW_ROWS}) q")
