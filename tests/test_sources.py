import json

import pytest
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.functions.describe import describe
from flowspark.operators import classifier as M
from flowspark.plans import knowledge_build, training, triage_run
from flowspark.sources import flow_csv as S
from flowspark.sources import knowledge as K
from flowspark.sources import runs as R
from flowspark.sources import tables as T
from flowspark.sources import vectors as U
from flowspark.streaming.flow_stream import describe_stream


def test_cic_files_with_mixed_headers_and_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text(" Label, Total Fwd Packets\nBENIGN,1\nWeb Attack – XSS,2\n", encoding="utf-8")
    (tmp_path / "b.csv").write_bytes("Flow Duration, Label\n5.5,Web Attack \x96 XSS\nInfinity,Bot\n".encode("latin-1"))
    df = S.read_cic(spark, f"{tmp_path}/*.csv")
    assert set(df.columns) == {"Label", "Total Fwd Packets", "Flow Duration"}
    rows = {r["Label"]: r for r in df.collect()}
    assert set(rows) == {"BENIGN", "Web Attack – XSS", "Web Attack \x96 XSS", "Bot"}
    assert rows["BENIGN"]["Total Fwd Packets"] == 1.0 and rows["BENIGN"]["Flow Duration"] is None
    assert rows["Bot"]["Flow Duration"] == float("inf")


def test_no_files_is_an_error(spark, tmp_path):
    with pytest.raises(Exception):
        S.read_cic(spark, f"{tmp_path}/*.csv")


def test_unsw_train_and_test(spark, tmp_path):
    (tmp_path / "train.csv").write_text("id,dur,proto,spkts,attack_cat,label\n1,0.5,tcp,3,Normal,0\n")
    (tmp_path / "test.csv").write_text("id,dur,proto,spkts,attack_cat,label\n1,0.7,udp,-,DoS,1\n")
    df = S.read_unsw(spark, f"{tmp_path}/train.csv", f"{tmp_path}/test.csv")
    assert "id" not in df.columns and df.count() == 2
    assert dict(df.dtypes)["dur"] == "double" and dict(df.dtypes)["proto"] == "string"
    assert "Spkts" in S.describer_names(df).columns


def test_unsw_numbered_files_take_names_from_the_features_file(spark, tmp_path):
    (tmp_path / "UNSW-NB15_1.csv").write_text("1.1.1.1,80,tcp,0.5\n")
    (tmp_path / "UNSW-NB15_2.csv").write_text("1.1.1.2,81,udp,0.25\n")
    (tmp_path / "features.csv").write_bytes("No.,Name,Note\n1,srcip,caf\xe9\n2,sport,\n3,proto,\n4,dur,\n".encode("latin-1"))
    named = S.read_unsw_numbered(spark, f"{tmp_path}/UNSW-NB15_[1-4].csv", f"{tmp_path}/features.csv")
    assert named.columns == ["srcip", "sport", "proto", "dur"] and named.agg(F.sum("dur")).first()[0] == 0.75
    assert S.read_unsw_numbered(spark, f"{tmp_path}/UNSW-NB15_[1-4].csv").columns[0] == "_c0"


def bundle():
    ext = lambda i: [{"source_name": "other", "external_id": "X"}, {"source_name": "mitre-attack", "external_id": i, "url": "u"}]
    tech = lambda n, **more: {"id": f"a{n}", "type": "attack-pattern", "name": f"Name {n}", "external_references": ext(f"T100{n}"), **more}
    objects = [
        tech(1, description="Use [tool](http://x) <code>now</code>.(Citation: A)\n\nEnd", x_mitre_platforms=["Windows", "Linux"], x_mitre_detection="Look",
             kill_chain_phases=[{"kill_chain_name": "mitre-attack", "phase_name": "command-and-control"}, {"kill_chain_name": "other", "phase_name": "no"}]),
        tech(2, revoked=True), tech(3, x_mitre_deprecated=True), {**tech(4), "external_references": [{"source_name": "other", "external_id": "Y"}]}, tech(5)]
    for i in range(8):
        objects.append({"id": f"m{i}", "type": "course-of-action", "name": f"M{i}", "description": "" if i == 1 else f"Do {i} (Citation: B)"})
        objects.append({"type": "relationship", "id": f"r{i}", "relationship_type": "mitigates", "source_ref": f"m{i}", "target_ref": "a1", "revoked": i == 2})
    objects.append({"type": "relationship", "id": "r9", "relationship_type": "uses", "source_ref": "m0", "target_ref": "a5"})
    return {"type": "bundle", "objects": objects}


RULE = """title: Odd login
id: 11-22
description: Finds it
level: high
status: test
tags:
  - attack.t1110
  - cve.1
logsource:
  product: linux
  category: auth
falsepositives:
  - Admins
detection:
  selection:
    User: root
    Port: 22
  words: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11]
  timeframe: 5m
  condition: selection and words
"""


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    root = tmp_path_factory.mktemp("sources")
    (root / "stix.json").write_text(json.dumps(bundle(), indent=1))
    rules = root / "sigma" / "rules" / "linux"
    rules.mkdir(parents=True)
    (rules / "good.yml").write_text(RULE)
    (rules / "noid.yml").write_text("title: No id\ntags: []\n")
    (rules / "notitle.yml").write_text("id: 5\n")
    (rules / "broken.yml").write_text("title: [oops\n")
    (rules / "nulltags.yml").write_text("title: T\ntags:\n")
    outside = root / "sigma" / "tests"
    outside.mkdir()
    (outside / "skip.yml").write_text("title: outside\n")
    return root


def test_techniques(spark, sources):
    docs = {r["id"]: r for r in K.technique_documents(K.read_stix(spark, str(sources / "stix.json"))).collect()}
    assert set(docs) == {"T1001", "T1005"}
    assert docs["T1001"]["text"].split("\n") == [
        "Técnica MITRE ATT&CK: T1001 - Name 1", "Táticas: Command And Control", "Plataformas: Windows, Linux", "Descrição: Use tool now. End", "Mitigações:",
        "  - M0: Do 0", "  - M3: Do 3", "  - M4: Do 4", "  - M5: Do 5", "  - M6: Do 6", "Detecção: Look"]
    assert docs["T1005"]["text"] == "Técnica MITRE ATT&CK: T1005 - Name 5" and docs["T1001"]["metadata"]["tactics"] == "Command And Control"


def test_rules(spark, sources):
    rules = K.read_rules(spark, str(sources / "sigma")).cache()
    docs = {r["title"]: r for r in K.rule_documents(rules).collect()}
    assert set(docs) == {"Odd login", "No id"}
    assert docs["Odd login"]["text"].split("\n") == [
        "Regra Sigma: Odd login", "Severidade: high", "Status: test", "Descrição: Finds it", "Tags MITRE ATT&CK: attack.t1110", "Fonte de log: category=auth, product=linux",
        "Lógica de detecção: Condição: selection and words", "  selection: User=root, Port=22", "  words: [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]", "  timeframe: 5m",
        "Falsos positivos conhecidos: Admins"]
    assert len(docs["No id"]["id"]) == 64 and "Fonte de log: não especificado" in docs["No id"]["text"]
    assert sum(r["n_files"] for r in K.rule_rejects(rules).collect()) == 3


def test_rules_without_rule_folders(spark, tmp_path):
    for part in ("deep/a", "config", ".github"):
        (tmp_path / part).mkdir(parents=True)
        (tmp_path / part / "r.yml").write_text(f"title: {part}\n")
    assert [r["title"] for r in K.rule_documents(K.read_rules(spark, str(tmp_path))).collect()] == ["deep/a"]


def test_knowledge_base_end_to_end(spark, sources, tmp_path):
    corpus = knowledge_build.documents(spark, str(sources / "stix.json"), str(sources / "sigma"))
    model, collection, counts = knowledge_build.build(corpus, str(tmp_path / "kb"), dimension=256)
    assert {r["source"]: r["n_documents"] for r in counts.collect()} == {"ids_classes": 16, "mitre_attack": 2, "sigma_rules": 2, None: 20}
    hits = knowledge_build.suite(model, collection, knowledge_build.suite_queries(spark)).collect()
    assert {(r["query_id"], r["rank"]) for r in hits} == {(q, k) for q in range(1, 9) for k in (1, 2, 3)}
    assert "CLASS-DDOS" in {r["id"] for r in hits if r["query_id"] == 2}


def test_metadata_is_flattened(spark):
    df = spark.createDataFrame([("t", None, (["a", "b"], 5, None, {"k": "v"}, "own"))],
                               "title string, source string, metadata struct<tags array<string>, n int, gone string, deep map<string,string>, title string>")
    assert df.select(U.flat_metadata(df)).first()[0] == {"title": "own", "source": "", "tags": "a, b", "n": "5"}


def test_runs_round_trip(spark, tmp_path):
    rows = [("DoS", "DoS", 1.0, []), ("Benign", "DoS", 2.0, ["x"])]
    df = spark.createDataFrame(rows, "attack_type string, ground_truth string, elapsed_seconds double, validation_errors array<string>")
    R.write_summary(df, f"{tmp_path}/run_20260101_000000_rag_rf_random_n2/results.json")
    row = R.read_runs(spark, f"{tmp_path}/run_*/results.json/*.json").first()
    assert (row["n_records"], row["accuracy_exact"], row["confusion"]["fn"]) == (2, 0.5, 1)
    assert (row["use_rag"], row["rerank"], row["use_rf"], row["stratified"], row["n"]) == (True, False, True, False, 2)


def flows(spark, n=400):
    rows = [(i, D.CIC if i % 2 else D.UNSW, "BENIGN" if i % 10 < 6 else "DoS", float(i % 10), float(i * 7 % 13)) for i in range(n)]
    df = spark.createDataFrame(rows, "flow_id long, dataset_source string, label string, signal double, noise double")
    return df.withColumns({"Flow Duration": F.lit(2e6) + F.col("flow_id") * 1000, "Total Fwd Packets": F.col("flow_id") % 5, "dur": F.lit(1.5), "Spkts": F.col("flow_id") % 3})


def test_forest_trains_routes_and_persists(spark, tmp_path):
    df = flows(spark)
    models, table = training.train_all(df, "flow_id", (D.CIC, D.UNSW, "absent"), sample_size=300, target=str(tmp_path), trees=5, depth=3, features=["signal", "noise"])
    rows = {r["dataset"]: r for r in table.collect()}
    assert set(rows) == {D.CIC, D.UNSW} and rows[D.CIC]["n_train"] + rows[D.CIC]["n_test"] == 200 and rows[D.CIC]["accuracy"] > 0.95
    again = training.load_all(str(tmp_path), (D.CIC, D.UNSW))
    assert M.feature_list(again[D.CIC]) == ["signal", "noise"]
    probe = df.limit(50).withColumn("dataset_source", F.when(F.col("flow_id") < 5, "other").otherwise(F.col("dataset_source")))
    probe = probe.withColumn("noise", F.lit(float("nan")))
    a, b = [sorted(M.score_by_source(probe, m).select("flow_id", "rf_label", "rf_confidence").collect()) for m in (models, again)]
    assert a == b and len(a) == 50
    assert [r["rf_label"] for r in a[:5]] == ["Unknown"] * 5 and {r["rf_confidence"] for r in a[:5]} == {0.0}


def test_one_class_cannot_be_trained(spark):
    with pytest.raises(Exception, match="both classes"):
        M.train_forest(flows(spark).filter("label = 'DoS'"), ["signal"], trees=1, depth=1)


def test_triage_chain(spark, tmp_path):
    records = triage_run.described(flows(spark, 60)).cache()
    model, collection, _ = knowledge_build.build(K.class_notes(spark), str(tmp_path / "kb"), dimension=128)
    from flowspark.operators.retrieval import apply_embedder

    context = triage_run.contexts(records, collection, lambda q: apply_embedder(model, q), top_k=3, threshold=2.0)
    asked = triage_run.prompts(records, context)
    assert asked.count() == 60 and asked.filter(F.col("prompt").contains("--- Reference 1 (IDS Class Reference) ---")).count() == 60
    answer = '{"attack_type": "DoS", "severity": "high", "confidence": 90, "mitre_techniques": [], "explanation": "x", "recommendations": []}'
    answers = records.select("record_key", F.lit("THREAT").alias("stage1_response"), F.lit(answer).alias("response"), F.lit(None).cast("string").alias("response_error"),
                             F.lit(1.0).alias("elapsed_seconds"), F.lit("m").alias("model_name"))
    results = triage_run.results(records, answers, context, use_rf=False).collect()
    assert len(results) == 60 and all(r["confidence"] == 0.9 and len(r["rag_distances"]) == 3 and not r["validation_errors"] for r in results)


def test_stream_equals_batch(spark, tmp_path):
    df = flows(spark, 30)
    T.write_unified(df, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    describe_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r["flow_id"]: r["description"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["flow_id"]: r["description"] for r in describe(df).collect()} and len(got) == 30


def test_partitioned_table_prunes_files(spark, tmp_path):
    T.write_unified(flows(spark, 30), str(tmp_path))
    plan = spark.read.parquet(str(tmp_path)).filter(F.col("dataset_source") == D.CIC).select("signal")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dataset_source" in plan and "ReadSchema: struct<signal:double>" in plan


def test_rules_are_read_by_many_tasks_and_as_the_python_parser_reads_them(spark, monkeypatch):
    yaml = pytest.importorskip("yaml")
    texts = ["title: a\nid: 1", "title: [unclosed", "title: a\nlogsource:\tb", "title: !", "a: [b?:c]", "title: >#\n  x", "- - a", "date: 2020-99-99"]
    slow, calls = yaml.safe_load, []
    monkeypatch.setattr(yaml, "safe_load", lambda text: calls.append(text) or slow(text))

    def outcome(read, text):
        try:
            return repr(read(text))
        except yaml.YAMLError:
            return "not YAML"
        except ValueError as problem:
            return repr(problem)

    assert [outcome(K._load_yaml, t) for t in texts] == [outcome(slow, t) for t in texts]
    assert texts[0] not in calls or not yaml.__with_libyaml__
    assert K._rule_record(None) == {"error": "malformed: AttributeError"}
    one = spark.createDataFrame([("p", t) for t in texts], "path string, content string").coalesce(1)
    assert K.parse_rules(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
