"""Kept run figures and resumable answers: what came twice counts once, what was stopped goes on."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from flowspark.operators import evaluation as E
from flowspark.operators import kept_metrics as N
from flowspark.operators import responder as R
from flowspark.functions import responses as P

RESULTS = "config string, attack_type string, ground_truth string, elapsed_seconds double, validation_errors array<string>"


@pytest.fixture(scope="module")
def results(spark):
    rng = random.Random(2)
    labels = ["Benign", "DDoS", "DoS", None]
    rows = [(f"c{i % 2}", rng.choice(labels[:3]), rng.choice(labels[: 3 if i % 2 else 4]), None if i % 9 == 0 else float(i % 7), ["x"] if i % 5 == 0 else []) for i in range(300)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {RESULTS}").cache()


def test_state_adds_up(spark, results, tmp_path):
    path = str(tmp_path / "m")
    for b in range(3):
        N.add_results(results.where(F.col("i") % 3 == b), path, "r", str(b), ("config",))
    N.add_results(results.where(F.col("i") % 3 == 1), path, "r", "1", ("config",))  # the same batch again
    N.add_results(results.where("i < 5"), path, "other", "0", ("config",))
    got = {r["config"]: r for r in N.kept_metrics(spark, path, "config string").where("run = 'r'").collect()}
    want = {r["config"]: r for r in E.metrics(results, by=("config",)).collect()}
    assert set(got) == set(want) and all({k: v for k, v in got[c].asDict().items() if k != "run"} == want[c].asDict() for c in want)
    N.replace_run(results.where("i < 100"), path, "r", ("config",))
    N.add_results(results.where("i >= 100 AND i < 120"), path, "r", "late", ("config",))
    again = {r["config"]: r["n_records"] for r in N.kept_metrics(spark, path, "config string").where("run = 'r'").collect()}
    assert again == {"c0": 60, "c1": 60}


def flaky(good: bool):
    """Fails for prompts with a 9 until it is told better."""
    def respond(prompts: list[str]) -> list[str]:
        if not good and any("9" in p for p in prompts):
            raise TimeoutError("no answer")
        return [p.upper() for p in prompts]

    return respond


def test_answers_are_resumed(spark, tmp_path):
    path = str(tmp_path / "a")
    requests = spark.range(200).selectExpr("id as record_key", "concat('p', id) as prompt").repartition(3)
    part = R.answer(requests, path, flaky(True), only_slices=4, slices=8)
    assert 0 < part.count() < 200
    whole = R.answer(requests, path, flaky(True), slices=8).collect()
    assert sorted(r["record_key"] for r in whole) == list(range(200)) and all(r["response"] == f"P{r['record_key']}" for r in whole)
    assert R.answered(requests, path).count() == 200  # each key was stored once
    assert R.answer(requests, path, flaky(False)).count() == 200  # nothing is open, so nothing fails


def test_failures_are_bounded_and_asked_again(spark, tmp_path):
    path = str(tmp_path / "a")
    requests = spark.range(40).selectExpr("cast(id as string) as record_key", "cast(id as string) as prompt")
    first = {r["record_key"]: r for r in R.answer(requests, path, flaky(False), batch_size=1, attempts=2).collect()}
    failed = {k for k, r in first.items() if r["response_error"]}
    assert failed == {"9", "19", "29", "39"} and first["9"]["attempts"] == 2 and first["9"]["response_error"] == "TimeoutError: no answer" and first["8"]["attempts"] == 1
    assert {r["record_key"] for r in R.answer(requests, path, flaky(True)).collect() if r["response_error"]} == failed
    again = R.answer(requests, path, flaky(True), again=True).collect()
    assert len(again) == 40 and all(r["response"] == r["record_key"] and r["response_error"] is None for r in again)


@pytest.mark.parametrize(("text", "want"), [
    ('{"confidence": NaN, "x": [NaN, {"confidence": -Infinity}]}', '{"confidence": "nan", "x": [0, {"confidence": "-inf"}]}'),
    ('say {"a": Infinity}', '{"a": 0}')])
def test_answers_without_numbers(text, want):
    assert P.repaired(text) == want
