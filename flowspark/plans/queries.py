"""Every operator as a query over the given tables: name -> (session, folder) -> DataFrame.

Results are flat: arrays are joined with "|" and doubles rounded, so that they can be compared
with any other engine by value.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.functions import flow_classes as C
from flowspark.functions import labels as L
from flowspark.functions import responses as R
from flowspark.functions import text as X
from flowspark.functions.describe import describe, flow_classes, flow_measures, generic_text
from flowspark.operators import classifier as M
from flowspark.operators import cleaning as P
from flowspark.operators import evaluation as E
from flowspark.operators import reduction as B
from flowspark.operators import retrieval as V
from flowspark.operators import sampling as S
from flowspark.operators import summaries as A
from flowspark.operators.bounded import spread
from flowspark.operators.triage import confident_benign, outcomes, with_route
from flowspark.plans import grid, knowledge_build, preprocess, training, triage_run
from flowspark.plans.views import dirty, flows, labelled, responses, runs, table, wide_flows
from flowspark.session import shared_folder, use_settings, written
from flowspark.sources import knowledge as K
from flowspark.sources import tables as T
from flowspark.sources.collection import Collection
from flowspark.sources.flow_csv import read_cic
from flowspark.sources.postings import Postings
from flowspark.sources.runs import append_summary, read_runs, write_results, write_summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return function(use_settings(spark), folder)

    QUERIES[function.__name__] = run
    return run


def joined(col: Column | str) -> Column:
    return F.array_join(col, "|")


def rounded(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---------------------------------------------------------------- flagship

@query
def triage_overview(spark, folder):
    df = labelled(flows(spark, folder)).select(
        "dataset_source",
        C.flow_shape(F.col("fwd_pkts"), F.col("bwd_pkts"), F.col("fwd_bytes"), F.col("bwd_bytes")).alias("shape"),
        C.packet_rate_class(F.col("pkt_rate"), F.col("total_pkts"), F.col("duration")).alias("rate_class"),
        L.is_threat(F.col("label")).alias("threat"))
    return df.groupBy("dataset_source", "shape", "rate_class").agg(
        F.count("*").alias("n_flows"), F.count_if("threat").alias("n_threats"),
        F.round(F.count_if("threat") / F.count("*"), 6).alias("threat_share"),
    ).orderBy("dataset_source", "shape", "rate_class")


# ---------------------------------------------------------------- scans, sinks, unions

@query
def unified_scan(spark, folder):
    df = wide_flows(labelled(flows(spark, folder)).drop("raw_label").withColumnRenamed("label", "raw_label"))
    base = shared_folder(spark)
    paths = {}
    for choice, source in T.SOURCE_OF.items():
        own = D.CIC_FLOW_COLUMNS if source == D.CIC else D.UNSW_FLOW_COLUMNS
        part = df.filter(F.col("dataset_source") == source).select("flow_id", "dataset_source", *own)
        paths[choice] = f"{base}/{choice}"
        T.write_clean(part, paths[choice])
    both = T.read_clean(spark, paths, "unified")
    return both.groupBy("dataset_source").agg(
        F.count("*").alias("n"), F.count("Total Fwd Packets").alias("n_cic_packets"), F.count("Spkts").alias("n_unsw_packets"),
        F.sum("Total Fwd Packets").cast("bigint").alias("cic_packets"), F.sum("Spkts").cast("bigint").alias("unsw_packets"))


@query
def scan_csv_union(spark, folder):
    df = flows(spark, folder).filter(F.col("dataset_source") == D.CIC)
    base = shared_folder(spark)
    narrow = df.select(
        F.col("raw_label").alias(" Label"), F.col("fwd_pkts").alias(" Total Fwd Packets"), F.col("duration_s").alias("Flow Duration "))
    late = df.select(F.col("bwd_pkts").alias("Total Backward Packets"), F.col("raw_label").alias(" Label"), F.col("fwd_pkts").alias("Total Fwd Packets"))
    for name, part in (("early", narrow), ("late", late)):
        part.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{base}/{name}")
    both = read_cic(spark, f"{base}/*/*.csv")
    return both.groupBy(X.strip(F.col("Label")).alias("label")).agg(
        F.count("*").alias("n"), F.count("Flow Duration").alias("n_duration"),
        F.sum("Total Fwd Packets").cast("bigint").alias("fwd_packets"),
        F.sum("Total Backward Packets").cast("bigint").alias("bwd_packets"))


@query
def unified_write(spark, folder):
    target = shared_folder(spark)
    df = labelled(flows(spark, folder)).select("flow_id", "label", "label_original", "dataset_source", "fwd_pkts", "fwd_bytes")
    T.write_unified(df, target)
    back = spark.read.parquet(target)
    return back.filter(F.col("dataset_source") == D.UNSW).groupBy("label").agg(
        F.count("*").alias("n"), F.sum("fwd_pkts").alias("fwd_pkts"), F.round(F.sum("fwd_bytes"), 2).alias("fwd_bytes"))


@query
def scaling_params_reapplied(spark, folder):
    df = table(spark, folder, "lineitem")
    target = shared_folder(spark)
    T.write_ranges(df, NUMBERS, target)
    scaled = P.scale(df.select("l_returnflag", *NUMBERS), T.read_ranges(spark, target))
    return scaled.groupBy("l_returnflag").agg(*[F.round(F.avg(c), 6).alias(c) for c in NUMBERS])


@query
def unify(spark, folder):
    df = flows(spark, folder)
    left = df.filter(F.col("dataset_source") == D.CIC).select(
        "flow_id", "dataset_source", "fwd_pkts", F.when(F.col("flow_id") % 3 == 0, "tcp").otherwise(F.col("k").cast("string")).alias("protocol"))
    right = df.filter(F.col("dataset_source") == D.UNSW).select(
        "flow_id", "dataset_source", "bwd_bytes", F.when(F.col("flow_id") % 5 == 0, F.lit(None)).otherwise(F.col("duration")).alias("dur"))
    return rounded(P.unify(left, right), ["bwd_bytes", "dur"])


@query
def corpus_counts(spark, folder):
    parts = [
        table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", "source"),
        table(spark, folder, "pages").select(F.col("url").alias("id"), F.col("html").alias("text"), F.lit("pages").alias("source")),
        table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text", F.lit("benchmark").alias("source")),
    ]
    return A.corpus_counts(K.corpus(*parts).filter(F.col("text").isNotNull()))


# ---------------------------------------------------------------- cleaning

@query
def drop_identifiers(spark, folder):
    df = flows(spark, folder).select(
        F.col("flow_id").alias("Flow ID"), F.col("user_id").alias("src_ip"), F.col("user_id").alias("srcip"),
        F.col("k").alias("dsport"), F.col("value").alias("Timestamp"), "fwd_pkts", "bwd_pkts")
    return P.drop_columns(df, D.CIC_IDENTIFIERS + D.UNSW_IDENTIFIERS)


@query
def label_map(spark, folder):
    df = flows(spark, folder)
    cic = P.map_labels(df.filter(F.col("dataset_source") == D.CIC).select("flow_id", "raw_label"), "raw_label", D.CIC)
    unsw = df.filter(F.col("dataset_source") == D.UNSW).select(
        "flow_id", P.resolve_label(F.col("raw_label"), F.col("raw_binary")).alias("raw_label"))
    return cic.unionByName(P.map_labels(unsw, "raw_label", D.UNSW))


@query
def label_resolve(spark, folder):
    category, binary = F.col("raw_label"), F.col("raw_binary")
    return flows(spark, folder).select(
        "flow_id", P.resolve_label(category, binary).alias("both"), P.resolve_label(category, None).alias("category_only"),
        P.resolve_label(None, binary).alias("binary_only"))


@query
def unmapped_labels(spark, folder):
    return A.unmapped_labels(labelled(flows(spark, folder)))


@query
def clean_nonfinite(spark, folder):
    return P.finite_only(dirty(spark, folder), ["flow_rate", "fwd_length", "total_count"]).select(
        "flow_id", "flow_rate", "fwd_length", "total_count")


DIRTY_COLUMNS = ["flow_rate", "fwd_length", "total_count"]


@query
def drop_all_null(spark, folder):
    clean = P.finite_only(dirty(spark, folder), DIRTY_COLUMNS)
    return P.drop_empty_rows(clean, DIRTY_COLUMNS).select("flow_id", *DIRTY_COLUMNS)


@query
def median_impute(spark, folder):
    clean = P.drop_empty_rows(P.finite_only(dirty(spark, folder), DIRTY_COLUMNS), DIRTY_COLUMNS)
    filled = P.impute_medians(clean, DIRTY_COLUMNS)
    return filled.select("flow_id", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in DIRTY_COLUMNS])


@query
def clip_negative(spark, folder):
    df = P.finite_only(dirty(spark, folder), DIRTY_COLUMNS).withColumnsRenamed(
        {"flow_rate": "Flow Rate", "fwd_length": "Fwd Length", "total_count": "count of total"})
    clipped = P.clip_negatives(df, ["Flow Rate", "Fwd Length", "count of total"])
    return clipped.select(
        "flow_id", F.col("Flow Rate").alias("flow_rate"), F.col("Fwd Length").alias("fwd_length"), F.col("count of total").alias("total_count"))


@query
def coerce_numeric(spark, folder):
    df = dirty(spark, folder).select("flow_id", "mixed", "service_name")
    return P.coerce_numeric(df, keep=("service_name",))


@query
def label_encode(spark, folder):
    return P.encode_categories(dirty(spark, folder).select("flow_id", "service_name"), ["service_name"], "_code").select(
        "flow_id", "service_name", "service_name_code")


@query
def column_medians(spark, folder):
    df = table(spark, folder, "lineitem")
    medians = P.exact_medians(df, NUMBERS, window_rows=20_000)
    return spark.createDataFrame([(c, m) for c, m in medians.items()], "column_name string, median_value double")


@query
def column_minmax(spark, folder):
    ranges = P.range_table(table(spark, folder, "lineitem"), NUMBERS)
    return ranges.withColumns({c: F.col(c) + 0.0 for c in ("min_value", "max_value")})  # -0.0 and 0.0 are one value


@query
def minmax_scale(spark, folder):
    df = table(spark, folder, "lineitem").select(*NUMBERS, F.lit(3.5).alias("constant"))
    columns = NUMBERS + ["constant"]
    return rounded(P.scale(df, P.column_ranges(df, columns)), columns)


@query
def quality_counters(spark, folder):
    return P.quality_counts(dirty(spark, folder), DIRTY_COLUMNS)


@query
def dataset_report(spark, folder):
    df = labelled(flows(spark, folder)).select("label", "label_original", "dataset_source", "fwd_pkts", "bwd_bytes", "flow_id")
    report = A.dataset_report(df)
    pairs = F.transform(F.map_entries("label_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return report.select("records", "columns", "numeric_features", joined(pairs).alias("label_distribution"), joined("column_names").alias("column_names"))


@query
def label_distribution(spark, folder):
    return A.label_distribution(labelled(flows(spark, folder)))


@query
def source_label_rollup(spark, folder):
    return A.source_label_rollup(labelled(flows(spark, folder)))


@query
def threat_flag(spark, folder):
    label = F.col("raw_label")
    return flows(spark, folder).select(
        "flow_id", L.is_threat(label).alias("threat"), L.is_benign(label).alias("benign"), L.threat_target(label).cast("int").alias("target"))


# ---------------------------------------------------------------- reduction

def _features(df: DataFrame) -> DataFrame:
    return df.select(
        *NUMBERS, (F.col("l_extendedprice") * 2 + 1).alias("price_twice"), (F.col("l_quantity") * -3.0).alias("quantity_back"),
        (F.col("l_extendedprice") * 2 + F.col("l_quantity")).alias("price_mix"), F.lit(7).alias("always"),
        F.when(F.col("l_quantity") > 25, 1.0).alias("one_or_null"))


@query
def constant_columns(spark, folder):
    names = B.constant_columns(_features(table(spark, folder, "lineitem")))
    return spark.createDataFrame([(n,) for n in names], "column_name string")


@query
def corr_pairs(spark, folder):
    df = B.remove_constant(_features(table(spark, folder, "lineitem")))
    return B.correlations(df, df.columns).select("col_a", "col_b", F.round("r", 6).alias("r"))


@query
def corr_pairs_wide(spark, folder):
    vectors = table(spark, folder, "embeddings")
    df = vectors.select(*[F.col("embedding")[i].cast("double").alias(f"d{i:02d}") for i in range(64)])
    return B.correlations(df, df.columns).select("col_a", "col_b", F.round("r", 6).alias("r"))


@query
def corr_drop(spark, folder):
    df = B.remove_constant(_features(table(spark, folder, "lineitem")))
    return B.correlated_columns(df).select("column_name", "position", F.round("max_abs_r", 6).alias("max_abs_r"))


@query
def reduced_columns(spark, folder):
    df = _features(table(spark, folder, "lineitem"))
    return B.kept_columns(df, B.remove_correlated(B.remove_constant(df)))


# ---------------------------------------------------------------- sampling

@query
def sample_n(spark, folder):
    return S.sample_n(flows(spark, folder).select("flow_id", "dataset_source"), 500, "flow_id")


@query
def stratified_sample(spark, folder):
    return S.stratified_sample(labelled(flows(spark, folder)).select("flow_id", "label"), 300, "flow_id")


@query
def presample(spark, folder):
    return S.presample(flows(spark, folder).select("flow_id", "dataset_source"), 5, "flow_id", seed=7)


@query
def fraction_sample(spark, folder):
    return S.fraction_sample(flows(spark, folder).select("flow_id"), 0.2, "flow_id")


@query
def stratified_split(spark, folder):
    return S.train_test_split(labelled(flows(spark, folder)).select("flow_id", "label"), "flow_id", "label")


@query
def pick_record(spark, folder):
    return S.record_at(labelled(flows(spark, folder)).select("flow_id", "label", "fwd_pkts"), "flow_id", 42)


# ---------------------------------------------------------------- flow classes and descriptions

@query
def packet_rate_class(spark, folder):
    rate = F.col("pkt_rate")
    return flows(spark, folder).select(
        "flow_id", C.packet_rate_class(rate, F.col("total_pkts"), F.col("duration")).alias("guarded"),
        C.packet_rate_class(rate).alias("plain"))


@query
def byte_rate_class(spark, folder):
    rate = F.col("byte_rate")
    return flows(spark, folder).select(
        "flow_id", C.byte_rate_class(rate, F.col("total_bytes"), F.col("duration")).alias("guarded"),
        C.byte_rate_class(rate).alias("plain"))


@query
def duration_class(spark, folder):
    return flows(spark, folder).select("flow_id", C.duration_class(F.col("duration")).alias("duration_class"))


@query
def flow_shape(spark, folder):
    return flows(spark, folder).select("flow_id", C.flow_shape(
        F.col("fwd_pkts"), F.col("bwd_pkts"), F.col("fwd_bytes"), F.col("bwd_bytes")).alias("shape"))


@query
def flag_patterns(spark, folder):
    flags = [F.col(c) for c in ("syn", "ack", "fin", "rst", "psh", "urg")]
    return flows(spark, folder).select("flow_id", joined(C.flag_patterns(*flags)).alias("patterns"))


@query
def signature_hits(spark, folder):
    df = flow_classes(flow_measures(wide_flows(flows(spark, folder))))
    return df.select("flow_id", joined("classes.signatures").alias("signatures"))


@query
def flag_text(spark, folder):
    counts = {flag: F.col(c) for flag, c in (
        ("SYN", "syn"), ("FIN", "fin"), ("RST", "rst"), ("PSH", "psh"), ("ACK", "ack"), ("URG", "urg"), ("ECE", "ece"), ("CWR", "cwr"))}
    return flows(spark, folder).select("flow_id", C.flag_text(counts).alias("flags"))


@query
def describe_flow(spark, folder):
    return describe(wide_flows(flows(spark, folder))).select("flow_id", "description")


GENERIC_COLUMNS = [
    "user_id", "value", "k", "fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "syn", "ack", "fin", "rst", "psh", "urg", "ece",
    "proto_number", "service", "state", "pkt_min", "pkt_mean", "dataset_source",
]


@query
def describe_generic(spark, folder):
    df = flows(spark, folder).select("flow_id", *GENERIC_COLUMNS)
    return df.select("flow_id", generic_text(df, GENERIC_COLUMNS).alias("description"))


@query
def proto_name(spark, folder):
    return flows(spark, folder).select("flow_id", C.protocol_name(F.col("proto_number")).alias("proto"))


@query
def hint_lookup(spark, folder):
    return flows(spark, folder).select(
        "flow_id", C.service_hint(F.col("service")).alias("service_hint"), C.state_hint(F.col("state")).alias("state_hint"),
        C.state_meaning(F.col("state")).alias("state_meaning"))


@query
def size_notes(spark, folder):
    return flows(spark, folder).select(
        "flow_id", C.size_note(F.col("pkt_min"), F.col("pkt_max"), F.col("pkt_mean"), F.col("pkt_std")).alias("size_note"),
        C.window_note(F.col("fwd_win")).alias("window_note"), C.ttl_note(F.col("s_ttl"), F.col("d_ttl")).alias("ttl_note"))


@query
def fmt_numbers(spark, folder):
    return flows(spark, folder).select(
        "flow_id", X.format_time(F.col("duration_s") * 40).alias("time_text"), X.format_bytes(F.col("fwd_bytes") * 30).alias("bytes_text"),
        X.format_rate(F.col("byte_rate") * 9).alias("rate_text"), X.format_count(F.col("fwd_bytes") * 30).alias("count_text"),
        X.format_value(F.col("value") / 4, True).alias("value_text"))


# ---------------------------------------------------------------- knowledge

@query
def clean_text(spark, folder):
    return table(spark, folder, "pages").select("page_id", X.clean_markup(F.col("html")).alias("text"))


def stix_objects(spark, folder) -> DataFrame:
    """Parts as techniques, suppliers as mitigations, line items as relationships."""
    empty = "cast(null as array<struct<source_name string, external_id string, url string>>) AS external_references"
    parts = table(spark, folder, "part").selectExpr(
        "p_partkey AS position", "concat('P', p_partkey) AS id", "'attack-pattern' AS type", "p_name AS name",
        "concat('Uses [', p_name, '](http://x/', p_partkey, ')  <b>', p_type, '</b> (Citation: ', p_brand, ')') AS description",
        "p_size % 10 = 0 AS revoked", "p_partkey % 23 = 0 AS x_mitre_deprecated",
        "CASE WHEN p_size % 3 = 0 THEN concat('Watch <i>', p_brand, '</i>') END AS x_mitre_detection",
        "array(p_brand, p_type) AS x_mitre_platforms",
        "array(named_struct('source_name', 'other', 'external_id', 'X1', 'url', ''), named_struct('source_name', "
        "CASE WHEN p_partkey % 17 = 0 THEN 'elsewhere' ELSE 'mitre-attack' END, 'external_id', concat('T', 1000 + p_partkey), 'url', 'u')) AS external_references",
        "array(named_struct('kill_chain_name', 'mitre-attack', 'phase_name', concat(lower(p_type), '-and-control')), "
        "named_struct('kill_chain_name', 'other', 'phase_name', 'none')) AS kill_chain_phases",
        "cast(null as string) AS source_ref", "cast(null as string) AS target_ref", "cast(null as string) AS relationship_type")
    suppliers = table(spark, folder, "supplier").selectExpr(
        "s_suppkey AS position", "concat('S', s_suppkey) AS id", "'course-of-action' AS type", "s_name AS name",
        "CASE WHEN s_suppkey % 7 <> 0 THEN concat('Supplier <i>', s_name, '</i> (Citation: a)') END AS description",
        "false AS revoked", "false AS x_mitre_deprecated")
    edges = table(spark, folder, "lineitem").selectExpr(
        "l_orderkey * 8 + l_linenumber AS position", "'relationship' AS type", "l_linestatus = 'F' AND l_quantity < 5 AS revoked",
        "concat('S', l_suppkey) AS source_ref", "concat('P', l_partkey) AS target_ref",
        "CASE WHEN l_returnflag = 'R' THEN 'mitigates' ELSE 'uses' END AS relationship_type")
    return T.union_all([parts, suppliers, edges])


@query
def adjacency_top5(spark, folder):
    objects = stix_objects(spark, folder)
    return K.first_related(K.relation_pairs(objects), objects, "mitigates")


@query
def technique_doc(spark, folder):
    return K.technique_documents(stix_objects(spark, folder)).select("id", "title", "text")


RULE_YAML = (
    "CASE WHEN p_partkey % 17 = 0 THEN 'title: [unclosed' WHEN p_partkey % 13 = 0 THEN 'status: stable' ELSE concat("
    "'title: ', p_name, ' ', CAST(p_partkey AS STRING), chr(10), CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat('id: r-', CAST(p_partkey AS STRING), chr(10)) END, "
    "CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('description: Finds ', p_type, chr(10)) END, 'level: ', CASE WHEN p_size % 2 = 0 THEN 'high' ELSE 'low' END, chr(10), "
    "'tags:', chr(10), '  - attack.t', CAST(p_size AS STRING), chr(10), '  - other', chr(10), 'logsource:', chr(10), '  service: s1', chr(10), '  product: ', p_brand, chr(10), "
    "'detection:', chr(10), '  selection:', chr(10), '    Image: ', p_type, chr(10), '    Size: ', CAST(p_size AS STRING), chr(10), "
    "'  words:', chr(10), '    - a1', chr(10), '    - a2', chr(10), '    - a3', chr(10), '    - a4', chr(10), '    - a5', chr(10), '    - a6', chr(10), "
    "'    - a7', chr(10), '    - a8', chr(10), '    - a9', chr(10), '    - a10', chr(10), '    - a11', chr(10), '  condition: selection or words', chr(10), "
    "CASE WHEN p_size % 5 = 0 THEN '' ELSE concat('falsepositives:', chr(10), '  - admin ', p_brand, chr(10), '  - backup', chr(10)) END) END"
)


def _rule_files(spark, folder) -> DataFrame:
    return spread(table(spark, folder, "part")).selectExpr("concat('/rules/net/r', p_partkey, '.yml') AS path", f"{RULE_YAML} AS content")


@query
def rule_doc(spark, folder):
    return K.rule_documents(K.parse_rules(_rule_files(spark, folder))).select("id", "title", "text")


@query
def rule_rejects(spark, folder):
    return K.rule_rejects(K.parse_rules(_rule_files(spark, folder)))


# ---------------------------------------------------------------- retrieval

def _vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").withColumnRenamed("vec_id", "id")


def _centroids(spark, folder) -> DataFrame:
    """One query per embedding label: the mean vector."""
    spread = table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("pos", "v"))
    means = spread.groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"])
    return means.groupBy(F.col("label").alias("query_id")).agg(ordered.alias("query_embedding"))


@query
def doc_embed_join(spark, folder):
    """Every document and every vector; those without a partner are reported, not dropped."""
    documents = table(spark, folder, "documents").withColumnRenamed("doc_id", "id")
    paired = V.pairing(documents, _vectors(spark, folder))
    return paired.select("id", "source", "n_chars", F.size("embedding").alias("dimension"), F.length("text").alias("text_length"), "pairing")


@query
def knn_topk(spark, folder):
    hits = V.nearest(_centroids(spark, folder), _vectors(spark, folder), 10)
    return rounded(hits, ["distance"])


def _corpus(spark, folder) -> DataFrame:
    """Every document, with a vector of its own text."""
    return spread(table(spark, folder, "documents")).select(
        F.col("doc_id").alias("id"), "text", "source", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "n_chars",
        X.letter_profile(F.col("text")).alias("embedding"))


@query
def knn_filtered(spark, folder):
    hits = V.retrieve(_text_queries(spark, folder), _corpus(spark, folder), top_k=3, source="src7")
    return hits.select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def _label_scorer(corpus: DataFrame) -> V.PairScorer:
    """Pairs of equal label first, then by dense distance."""
    def score(pool: DataFrame) -> DataFrame:
        return pool.join(corpus.select("id", "label"), "id").withColumn(
            "score", F.when(F.col("label") == F.col("query_id"), 2.0).otherwise(0.0) - F.col("distance"))
    return score


@query
def knn_rerank(spark, folder):
    vectors = _vectors(spark, folder)
    hits = V.retrieve(_centroids(spark, folder), vectors, top_k=5, scorer=_label_scorer(vectors))
    return hits.select("query_id", "id", "rank", *[F.round(c, 6).alias(c) for c in ("dense_distance", "score", "distance")])


@query
def context_gate(spark, folder):
    queries, vectors = _centroids(spark, folder), _vectors(spark, folder)
    hits = V.retrieve(queries, vectors, top_k=5, scorer=_label_scorer(vectors))
    return rounded(V.context_gate(hits, queries, threshold=0.25), ["best_distance"])


def _text_queries(spark, folder) -> DataFrame:
    """Benchmark passages as queries, each with a vector of its own text."""
    return table(spark, folder, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"), X.letter_profile(F.col("text")).alias("query_embedding"))


def _text_hits(spark, folder, top_k: int = 5) -> DataFrame:
    queries, corpus = _text_queries(spark, folder), _corpus(spark, folder)
    index = Postings.build(corpus.select("id", "text"), shared_folder(spark))
    return V.retrieve(queries, corpus, top_k=top_k, scorer=index.scorer(queries))


@query
def bm25_rerank(spark, folder):
    return _text_hits(spark, folder).select(
        "query_id", "id", "rank", *[F.round(c, 6).alias(c) for c in ("dense_distance", "score", "distance")])


@query
def context_pack(spark, folder):
    hits = V.retrieve(_text_queries(spark, folder), _corpus(spark, folder), top_k=5)
    details = hits.join(_corpus(spark, folder).select("id", "title", "text", "source"), "id")
    packed = V.pack_context(details, max_tokens=700)
    return packed.select("query_id", "context", "n_blocks", F.col("n_chars").cast("bigint").alias("n_chars"), joined("titles").alias("titles"))


@query
def vec_upsert(spark, folder):
    existing = _vectors(spark, folder).select("id", "label")
    shifted = existing.select((F.col("id") + 250).alias("id"), (F.col("label") + 100).alias("label"), F.col("id").alias("seq"))
    repeated = existing.select((F.col("id") % 100).alias("id"), (F.col("label") + 200).alias("label"), (F.col("id") + 10_000).alias("seq"))
    kept = Collection.create(existing, shared_folder(spark))
    kept.upsert(shifted)
    kept.upsert(shifted.unionByName(repeated))
    return kept.rows().select("id", "label")


@query
def collection_size(spark, folder):
    existing = _vectors(spark, folder)
    kept = Collection.create(existing, shared_folder(spark))
    kept.upsert(existing.withColumns({"id": F.col("id") + 250, "seq": F.col("id")}))
    return kept.rows().agg(F.lit(kept.size()).cast("long").alias("n"), F.max("id").alias("last_id"))


@query
def embed_documents(spark, folder):
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    model = V.embed_texts(documents)
    vectors = V.apply_embedder(model, documents)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.select("id", F.size("embedding").alias("dimension"), F.round(norm, 3).alias("norm"))


@query
def retrieval_suite(spark, folder):
    corpus = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), "text", "source", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"))
    model, collection, _ = knowledge_build.build(corpus, shared_folder(spark))
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return knowledge_build.suite(model, collection, queries)


# ---------------------------------------------------------------- responses and outcomes

def _parsed(spark, folder) -> DataFrame:
    return R.parse(responses(spark, folder))


@query
def parse_responses(spark, folder):
    fields = [F.col(f"fields.{f}").alias(f) for f in ("attack_type", "severity", "explanation")]
    fields.append(F.col("fields.confidence").try_cast("double").alias("confidence"))
    return _parsed(spark, folder).select(
        "flow_id", "fields.parsed", "fields.is_object", *fields)


@query
def normalise_response(spark, folder):
    df = R.normalise_response(_parsed(spark, folder)).filter(F.col("fields.is_object"))
    return df.select(
        "flow_id", "normalised.attack_type", "normalised.severity", F.round("normalised.confidence", 6).alias("confidence"),
        joined("normalised.mitre_techniques").alias("techniques"), "normalised.explanation",
        joined("normalised.recommendations").alias("recommendations"), joined("normalised.validation_errors").alias("errors"))


@query
def validate_output(spark, folder):
    df = _parsed(spark, folder).withColumn("errors", R.validation_errors())
    return df.select("flow_id", (F.size("errors") == 0).alias("valid"), joined("errors").alias("errors"))


@query
def technique_ids(spark, folder):
    items = F.array(F.concat(F.lit("T1"), F.lpad(F.col("k").cast("string"), 3, "0"), F.lit(".00"), (F.col("k") % 10).cast("string")),
                    F.lit("none"), F.concat(F.lit("see T"), (F.col("flow_id") % 2000).cast("string")), F.lit("T1498 and T1499"))
    return flows(spark, folder).select("flow_id", joined(R.technique_ids(items)).alias("techniques"))


FREE_TEXTS = (
    "C2 Communication", "network traffic analysis", "ddos attack", "network scan", "something else", "", " Denial-of-Service ", "SQL Injection try",
    "not benign", "Credential Stuffing", "udp flood", "xss", "potential reverse shell activity", "WORMS", "exploitation of a service")


@query
def attack_type_norm(spark, folder):
    text = F.try_element_at(F.array(*[F.lit(t) for t in FREE_TEXTS]), (F.col("flow_id") % 16 + 1).cast("int"))
    return flows(spark, folder).select("flow_id", L.normalise_attack_type(text).alias("attack_type"))


PREDICTED = ("Benign", "normal", "DDoS", " bruteforce ", "web-attack", "Denial of Service", "", "Botnet", "Background")


@query
def label_match(spark, folder):
    predicted = F.try_element_at(F.array(*[F.lit(t) for t in PREDICTED]), (F.col("flow_id") % 10 + 1).cast("int"))
    return labelled(flows(spark, folder)).select("flow_id", L.labels_match(predicted, F.col("label")).alias("is_match"))


@query
def stage1_decide(spark, folder):
    return responses(spark, folder).select("flow_id", R.stage1_decision(F.col("stage1_response")).alias("decision"))


@query
def build_prompt(spark, folder):
    df = table(spark, folder, "conversations")
    context = F.when(F.col("turn") % 3 == 0, F.lit("")).when(F.col("turn") % 3 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "role", F.lit("\n")))
    return df.select("conv_id", "turn", R.flow_prompt(F.col("text"), context).alias("prompt"), R.stage1_prompt(F.col("text")).alias("stage1_prompt"))


@query
def rf_skip(spark, folder):
    df = with_route(responses(spark, folder), use_rf=True, two_stage=False)
    return df.select("flow_id", confident_benign().alias("skipped"), "route")


def _triage_input(spark, folder) -> DataFrame:
    df = responses(spark, folder)
    label = F.when(F.col("dataset_source") == D.CIC, X.strip(F.col("raw_label"))).otherwise(F.col("raw_label"))
    return df.withColumns({
        "record_key": F.col("flow_id"), "description": F.concat(F.lit("flow "), F.col("flow_id").cast("string")), "label": label,
        "model_name": F.lit("model"), "context_titles": F.array(F.concat(F.lit("t"), F.col("k").cast("string"))),
        "context_distances": F.array(F.col("rf_confidence") / 2)})


@query
def triage_outcome(spark, folder):
    results = outcomes(_triage_input(spark, folder))
    return results.select(
        "record_key", "attack_type", "severity", F.round("confidence", 6).alias("confidence"), joined("mitre_techniques").alias("techniques"),
        "explanation", joined("recommendations").alias("recommendations"), "record_description",
        joined("retrieved_context_titles").alias("titles"), F.round(F.try_element_at("rag_distances", F.lit(1)), 6).alias("distance"),
        "elapsed_seconds", "model_name", "ground_truth", F.length("raw_llm_response").alias("raw_length"),
        joined("validation_errors").alias("errors"), "stage1_decision", "stage_skipped")


@query
def triage_flow(spark, folder):
    """The whole triage chain: describe, score, retrieve, gate, pack, answer, settle."""
    df = wide_flows(labelled(flows(spark, folder)), keep=("label", *FOREST_FEATURES))
    records = triage_run.described(df, models=_forests(spark, folder))
    notes = K.class_notes(spark)
    model, collection, _ = knowledge_build.build(notes, shared_folder(spark), dimension=128)
    embed = lambda queries: V.apply_embedder(model, queries)
    context = triage_run.contexts(records, collection, embed, top_k=3, threshold=0.9)
    answers = responses(spark, folder).select(
        F.col("flow_id").alias("record_key"), "stage1_response", "response", "response_error", "elapsed_seconds", F.lit("model").alias("model_name"))
    return E.run_summary(triage_run.results(records, answers, context)).select(
        "item", "name", "n", "n_valid", F.round("avg_confidence", 4).alias("avg_confidence"))


# ---------------------------------------------------------------- evaluation

def _runs(spark, folder) -> DataFrame:
    return runs(labelled(flows(spark, folder)))


@query
def confusion(spark, folder):
    gaps = F.when((F.col("config") == "3_rag_only") & (F.col("flow_id") % 97 == 0), F.lit(None)).otherwise(F.col("ground_truth"))
    return E.confusion(_runs(spark, folder).withColumn("ground_truth", gaps), by=("config",))


@query
def triage_metrics(spark, folder):
    parts = [E.metrics(_runs(spark, folder), by=("config",), mode=mode).withColumn("mode", F.lit(mode)) for mode in ("reference", "valid_only")]
    return rounded(parts[0].unionByName(parts[1]), ["avg_elapsed_seconds"], 4)


@query
def triage_summary(spark, folder):
    return rounded(E.run_summary(_runs(spark, folder)), ["avg_confidence", "avg_elapsed_seconds"], 4)


def _run_rows(spark, folder) -> DataFrame:
    """One run per (config, dataset, k): thousands of runs to rank."""
    figures = E.metrics(_runs(spark, folder), by=("config", "dataset_source", "k"))
    return figures.withColumnRenamed("avg_elapsed_seconds", "avg_elapsed")


@query
def config_ranking(spark, folder):
    return E.ranking(_run_rows(spark, folder))


@query
def run_diff(spark, folder):
    made = _runs(spark, folder)
    return E.run_differences(
        made.filter(F.col("config") == "1_baseline_norag"), made.filter(F.col("config") == "5_rag_rerank_rf"))


@query
def run_outcome_matrix(spark, folder):
    made = _runs(spark, folder)
    return E.outcome_matrix(E.run_differences(
        made.filter(F.col("config") == "1_baseline_norag"), made.filter(F.col("config") == "6_rag_rerank_rf_2stage")))


@query
def batch_progress(spark, folder):
    df = _runs(spark, folder).withColumnRenamed("config", "run")
    return rounded(E.running_progress(df, block_width=1000), ["pct", "elapsed_total", "avg_elapsed", "remaining"], 4)


@query
def latest_run(spark, folder):
    df = table(spark, folder, "events").select("user_id", "ts", "event_id", "event_type")
    return E.latest(df, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query
def run_tag(spark, folder):
    flag = lambda m: F.col("event_id") % m == 0
    tag = E.run_tag(flag(2), flag(3), flag(5), flag(7), flag(11), F.col("event_id") % 100, F.date_format("ts", "yyyyMMdd_HHmmss"))
    return table(spark, folder, "events").select("event_id", tag.alias("run_tag"))


@query
def result_preview(spark, folder):
    df = table(spark, folder, "conversations").select("conv_id", "turn", F.col("text").alias("explanation"))
    return E.preview(df, ["conv_id", "turn"])


@query
def config_grid(spark, folder):
    records = _triage_input(spark, folder).drop("label").join(labelled(flows(spark, folder)).select("flow_id", "label"), "flow_id")
    return rounded(grid.evaluate(records, sizes=(150, 400), seeds=(1, 2)), ["avg_elapsed"], 4)


@query
def runs_scan(spark, folder):
    base = shared_folder(spark)
    made = _runs(spark, folder)
    for config, rag, rerank, two_stage, forest in D.CONFIG_GRID:
        flags = [F.lit(b) for b in (rag, rerank, two_stage, forest, True)]
        tag = spark.range(1).select(E.run_tag(*flags, F.lit(9))).first()[0]
        write_summary(made.filter(F.col("config") == config), f"{base}/{tag}/results.json")
    scanned = read_runs(spark, f"{base}/run_*/results.json/*.json")
    index = f"{base}/index"
    append_summary(scanned, index)
    return spark.read.parquet(index).select(
        "run_dir", "n_records", "n_valid", "accuracy_exact", "accuracy_binary", "precision", "recall", "confusion.tp", "confusion.fn",
        "use_rag", "rerank", "two_stage", "use_rf", "stratified", "n")


@query
def results_write(spark, folder):
    base = shared_folder(spark)
    write_results(_runs(spark, folder).select("config", "record_key", "attack_type", "ground_truth", "n_errors"), base)
    return spark.read.parquet(base).filter(F.col("config") == "4_rag_rerank").groupBy("attack_type").agg(
        F.count("*").alias("n"), F.sum("n_errors").alias("n_errors"))


# ---------------------------------------------------------------- classifier

FOREST_ROWS = 200_000  # at most so many labelled rows per dataset are fitted
FOREST_FEATURES = ["fwd_pkts", "bwd_pkts", "fwd_bytes", "bwd_bytes", "duration", "syn", "ack", "psh", "pkt_rate", "byte_rate"]


def _forest_input(spark, folder) -> DataFrame:
    """Flows with a target the features can explain, apart from some noise; written once, as sampling, splits and scoring each read it."""
    df = labelled(flows(spark, folder)).select("flow_id", "dataset_source", *FOREST_FEATURES)
    calm = (F.col("syn") < 4) & (F.col("fwd_pkts") < 30)
    noisy = F.when(F.col("flow_id") % 37 == 0, ~calm).otherwise(calm)
    return written(spread(df.withColumn("label", F.when(noisy, "Benign").otherwise("DoS"))))


_TRAINED: dict[tuple[str, str], tuple[str, list]] = {}  # (application, folder) -> where its models are, and their figures


def _trained(spark, folder, df=None) -> tuple[str, list]:
    """Models of both datasets, trained on ``df`` or a new input and stored once per application and folder."""
    place = (spark.sparkContext.applicationId, folder)
    if place not in _TRAINED:
        target = shared_folder(spark)
        models, figures = training.train_all(
            _forest_input(spark, folder) if df is None else df, "flow_id", (D.CIC, D.UNSW), FOREST_ROWS, target, features=FOREST_FEATURES)
        _TRAINED[place] = target, list(models)
    return _TRAINED[place]


def _forests(spark, folder, df=None) -> dict:
    target, sources = _trained(spark, folder, df)
    return training.load_all(target, tuple(sources))


@query
def rf_train(spark, folder):
    return spark.read.json(f"{_trained(spark, folder)[0]}/metrics")


@query
def rf_score(spark, folder):
    df = _forest_input(spark, folder)
    model = _forests(spark, folder, df)[D.CIC]
    scored = M.score(df.filter(F.col("dataset_source") == D.CIC), model)
    return scored.select("flow_id", "rf_label", F.round("rf_confidence", 6).alias("rf_confidence"))


@query
def rf_route(spark, folder):
    df = _forest_input(spark, folder)
    rerouted = df.withColumn("dataset_source", F.when(F.col("flow_id") % 10 == 0, "OTHER").otherwise(F.col("dataset_source")))
    scored = M.score_by_source(rerouted, _forests(spark, folder, df))
    return scored.groupBy("dataset_source", "rf_label").agg(F.count("*").alias("n"))


@query
def rf_metrics(spark, folder):
    """Both models together, on the rows that their training left out."""
    df = _forest_input(spark, folder)
    models = _forests(spark, folder, df)
    splits = [M.holdout_split(df.filter(F.col("dataset_source") == s), "flow_id", sample_size=FOREST_ROWS) for s in models]
    held = reduce(lambda a, b: a.unionByName(b), splits).filter("is_test")
    return M.holdout_metrics(M.score_by_source(held, models))


@query
def class_weights(spark, folder):
    return M.class_weights(labelled(flows(spark, folder))).withColumn("weight", F.round("weight", 6))


@query
def coverage_risk(spark, folder):
    df = responses(spark, folder).withColumns({
        "rf_benign": F.when(F.col("rf_label") == "Benign", F.col("rf_confidence")).otherwise(1 - F.col("rf_confidence")),
        "label": F.col("raw_label")})
    metrics = M.holdout_metrics(df, confident=0.9)
    return rounded(metrics, [c for c in metrics.columns if c not in ("n", "tn", "fp", "fn", "tp")])


# ---------------------------------------------------------------- whole preprocessing

@query
def preprocess_cic(spark, folder):
    raw = dirty(spark, folder).select(
        F.col("flow_id").alias("Flow ID"), F.col("flow_rate").alias("Flow Rate"), F.col("fwd_length").alias("Fwd Length"),
        F.col("total_count").alias("Total Count"))
    labels = flows(spark, folder).filter(F.col("dataset_source") == D.CIC).select(F.col("flow_id").alias("Flow ID"), F.col("raw_label").alias("Label"))
    clean = preprocess.preprocess_cic(raw.join(labels, "Flow ID"))
    return clean.select(
        *[F.round(F.col(c).cast("double"), 6).alias(c.lower().replace(" ", "_")) for c in ("Flow Rate", "Fwd Length", "Total Count")],
        "label", "label_original", "dataset_source")


@query
def preprocess_unsw(spark, folder):
    raw = dirty(spark, folder).select(
        F.col("flow_id").alias("srcip"), F.col("flow_rate").alias("rate"), F.col("mixed").alias("ct_ftp_cmd"), F.col("service_name").alias("service"))
    labels = flows(spark, folder).filter(F.col("dataset_source") == D.UNSW).select(
        F.col("flow_id").alias("srcip"), F.col("raw_label").alias("attack_cat"), F.col("raw_binary").alias("Label"))
    clean = preprocess.preprocess_unsw(raw.join(labels, "srcip"))
    return clean.select(
        F.round("rate", 6).alias("rate"), F.round("ct_ftp_cmd", 6).alias("ct_ftp_cmd"), "service", "label", "label_original", "dataset_source")


@query
def preprocess_unified(spark, folder):
    wide = wide_flows(flows(spark, folder))
    cic = wide.filter(F.col("dataset_source") == D.CIC).select(F.col("raw_label").alias("Label"), *[F.col(f"`{c}`") for c in D.CIC_FLOW_COLUMNS])
    unsw = wide.filter(F.col("dataset_source") == D.UNSW).select(
        F.col("raw_label").alias("attack_cat"), F.col("raw_binary").alias("label"), *D.UNSW_FLOW_COLUMNS)
    folders = preprocess.run(written(cic), written(unsw), shared_folder(spark))
    scaled = spark.read.parquet(folders["unified"])
    features = P.numeric_columns(scaled)
    low = reduce(lambda a, b: F.least(a, b), [F.min(f"`{c}`") for c in features])
    high = reduce(lambda a, b: F.greatest(a, b), [F.max(f"`{c}`") for c in features])
    return scaled.groupBy("dataset_source", "label").agg(F.count("*").alias("n"), low.alias("lowest"), F.round(high, 6).alias("highest"))
