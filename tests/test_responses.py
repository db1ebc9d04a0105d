import pytest
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.functions import labels as L
from flowspark.functions import responses as R
from flowspark.operators.triage import outcomes

GOOD = '{"attack_type": "DDoS", "severity": "high", "confidence": 0.87, "mitre_techniques": ["T1498", "T1499"], "explanation": "e", "recommendations": ["a", "b"]}'


def parsed(spark, values):
    df = spark.createDataFrame(list(enumerate(values)), "i int, response string")
    df = R.normalise_response(R.parse(df)).withColumn("errors", R.validation_errors())
    return [r for r in df.orderBy("i").collect()]


@pytest.mark.parametrize("text,expected", [
    ('{"attack_type": "DDoS", "confidence": 0.9}', '{"attack_type": "DDoS", "confidence": 0.9}'),
    ('text\n{"a": 1}', '{"a": 1}'), ('{"confidence": 0.5} trailing', '{"confidence": 0.5}'),
    ('{"attack_type": "DoS", "severity": "high",}', '{"attack_type": "DoS", "severity": "high"}'),
    ('{"outer": {"inner": 1}, "value": 2}', '{"outer": {"inner": 1}, "value": 2}'),
    ('x {"a": "b } {", "c": "\\"}"} y', '{"a": "b } {", "c": "\\"}"}'),
    ("", None), (None, None), ("no braces", None), ("{'a': 1}", None), ("{ never closed", None), ("null", None), ("[1, 2]", "[1, 2]")])
def test_extraction(text, expected):
    assert R.repaired(text) == expected


def test_normal_answer(spark):
    row = parsed(spark, [GOOD])[0]
    n = row["normalised"]
    assert (n["attack_type"], n["severity"], n["confidence"]) == ("DDoS", "high", 0.87)
    assert n["mitre_techniques"] == ["T1498", "T1499"] and n["recommendations"] == ["a", "b"]
    assert n["validation_errors"] == [] and row["errors"] == []


def test_malformed_fields_never_fail(spark):
    rows = parsed(spark, [
        GOOD.replace("0.87", "85"), GOOD.replace("0.87", "null"), GOOD.replace('"high"', "null"), "[1, 2]", GOOD.replace("0.87", '"abc"'),
        GOOD.replace('["T1498", "T1499"]', '"T1498"'), GOOD.replace('["a", "b"]', "5"), GOOD.replace('"e"', '""')])
    n = [r["normalised"] for r in rows]
    assert n[0]["confidence"] == 0.85 and n[0]["validation_errors"] == []
    assert n[1]["validation_errors"] == ["campo 'confidence' ausente"]
    assert n[2]["validation_errors"] == ["campo 'severity' ausente"]
    assert n[3]["validation_errors"] == [D.VALIDATION_TEXT["not_object"]]
    assert n[4]["validation_errors"] == ["confidence não é numérica: abc"]
    assert n[5]["mitre_techniques"] == [] and rows[5]["errors"] == ["mitre_techniques deve ser uma lista"]
    assert n[6]["validation_errors"] == ["recommendations deve ser uma lista"]
    assert n[7]["validation_errors"] == [D.VALIDATION_TEXT["explanation"]]


def test_validation_of_raw_answers(spark):
    rows = parsed(spark, [
        GOOD.replace('"DDoS"', '"Nope"'), GOOD.replace('"high"', '"huge"'), GOOD.replace("0.87", "1.5"), GOOD.replace("0.87", "-0.1"),
        GOOD.replace('["T1498", "T1499"]', "[]"), GOOD.replace('"attack_type": "DDoS", ', "")])
    assert [r["errors"] for r in rows] == [
        ["attack_type inválido: 'Nope'"], ["severity inválida: 'huge'"], ["confidence fora do intervalo [0,1]: 1.5"],
        ["confidence fora do intervalo [0,1]: -0.1"], [], ["campo 'attack_type' ausente"]]


def test_all_classes_and_severities_are_valid(spark):
    values = [GOOD.replace('"DDoS"', f'"{a}"').replace('"high"', f'"{s}"') for a in D.ATTACK_CLASSES for s in D.SEVERITIES]
    assert all(r["errors"] == [] for r in parsed(spark, values))


@pytest.mark.parametrize("raw,label", [
    ("C2 Communication", "Botnet"), ("network traffic analysis", "Analysis"), ("ddos attack", "DoS"), ("network scan", "Generic"),
    ("something else", "Generic"), (None, "Generic"), ("", "Generic"), ("not benign", "Benign"), (" DDoS ", "DDoS")])
def test_class_normalisation(spark, raw, label):
    assert spark.range(1).select(L.normalise_attack_type(F.lit(raw).cast("string"))).first()[0] == label


@pytest.mark.parametrize("predicted,actual,match", [
    ("ddos", "DDoS", True), ("Benign", "Normal", True), ("bruteforce", "Brute Force", True), ("Web Attack", "webattack", True),
    ("DDoS", "DoS", False), ("Benign", "Botnet", False), ("", "DoS", False), (None, "DoS", False), ("DoS", None, False)])
def test_label_match(spark, predicted, actual, match):
    p, a = [F.lit(x).cast("string") for x in (predicted, actual)]
    assert spark.range(1).select(L.labels_match(p, a)).first()[0] is match


@pytest.mark.parametrize("answer,decision", [
    ("BENIGN", "BENIGN"), (" benign.\nbecause", "BENIGN"), ("It is BENIGN", "THREAT"), ("", "THREAT"), ("THREAT", "THREAT"), (None, "ERROR")])
def test_stage1(spark, answer, decision):
    assert spark.range(1).select(R.stage1_decision(F.lit(answer).cast("string"))).first()[0] == decision


def test_prompts(spark):
    row = spark.range(1).select(
        R.flow_prompt(F.lit(" flow \n"), F.lit("ctx ")), R.flow_prompt(F.lit("flow"), F.lit(None).cast("string")), R.stage1_prompt(F.lit("flow "))).first()
    assert "\n\nflow\n\n" in row[0] and "\n\nctx\n\n" in row[0]
    assert D.NO_CONTEXT_TEXT in row[1]
    assert row[2].startswith("flow\n\nDecision")


def test_outcome_priority(spark):
    base = dict(description="d", label="DoS", elapsed_seconds=1.234, model_name="m", rf_label="Threat", rf_confidence=0.99,
                stage1_response="THREAT", response=GOOD, response_error=None, context_titles=["t"], context_distances=[0.1])
    cases = [
        dict(rf_label="Benign", stage1_response="BENIGN"), dict(stage1_response="BENIGN", response_error="x"), dict(response_error="timeout"),
        dict(response="nothing"), dict(stage1_response=None), dict(rf_label="Benign", rf_confidence=0.5)]
    rows = [dict(base, record_key=i, **{}) | case for i, case in enumerate(cases)]
    schema = ("record_key int, description string, label string, elapsed_seconds double, model_name string, rf_label string, rf_confidence double, "
              "stage1_response string, response string, response_error string, context_titles array<string>, context_distances array<double>")
    names = [part.split(" ")[0] for part in schema.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = outcomes(df).orderBy("record_key").collect()
    assert [r["stage_skipped"] for r in got] == ["rf_prefilter", "stage1_benign", None, None, None, None]
    assert [r["attack_type"] for r in got] == ["Benign", "Benign", "Unknown", "Unknown", "DDoS", "DDoS"]
    assert [r["confidence"] for r in got[:3]] == [0.99, 0.75, 0.0]
    assert got[2]["validation_errors"] == ["LLM falhou: timeout"] and got[3]["validation_errors"] == [D.ERROR_NOT_JSON]
    assert got[4]["stage1_decision"] == "ERROR" and got[0]["retrieved_context_titles"] == [] and got[3]["retrieved_context_titles"] == ["t"]
    assert got[0]["elapsed_seconds"] == 1.23
