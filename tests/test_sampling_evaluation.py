import hashlib

import pytest
from pyspark.sql import functions as F

from flowspark.operators import evaluation as E
from flowspark.operators import sampling as S


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, "Benign" if i < 500 else "DDoS" if i < 800 else "DoS" if i < 990 else None) for i in range(1000)]
    return spark.createDataFrame(rows, "id long, label string").repartition(4).cache()


def first(ids, n, seed):
    return set(sorted(ids, key=lambda i: hashlib.md5(f"{seed}-{i}".encode()).hexdigest())[:n])


@pytest.mark.parametrize("n", [1, 10, 700, 5000])
def test_sample_is_exact(labelled, n):
    assert {r["id"] for r in S.sample_n(labelled, n, "id", seed=3).collect()} == first(range(1000), min(n, 1000), 3)


@pytest.mark.parametrize("n", [2, 30, 900])
def test_stratified_sample_is_exact(labelled, n):
    got = {r["id"] for r in S.stratified_sample(labelled, n, "id").collect()}
    per_class = max(1, n // 3)
    assert got == first(range(500), per_class, 42) | first(range(500, 800), per_class, 42) | first(range(800, 990), per_class, 42)


def test_seed_decides_rows(labelled):
    a, b, c = [{r["id"] for r in S.select_records(labelled, 50, "id", seed=s).collect()} for s in (1, 1, 2)]
    assert a == b != c


def test_split_keeps_class_shares(labelled):
    rows = S.train_test_split(labelled, "id", "label").groupBy("label", "is_test").count().collect()
    assert {(r["label"], r["is_test"]): r["count"] for r in rows} == {
        ("Benign", True): 100, ("Benign", False): 400, ("DDoS", True): 60, ("DDoS", False): 240, ("DoS", True): 38, ("DoS", False): 152}


def test_empty_and_tiny_strata(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id long, label string")
    assert S.train_test_split(df, "id", "label").filter("is_test").isEmpty()
    assert S.sample_n(df.filter("id > 9"), 5, "id").isEmpty()


def test_record_by_key(labelled):
    assert S.record_at(labelled, "id", 501).first()["label"] == "DDoS"
    with pytest.raises(ValueError):
        S.record_at(labelled, "id", 5000)


def test_hot_class_is_never_sorted_whole(labelled):
    plan = S.stratified_sample(labelled, 30, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") == 1 and "_bucket" in plan.split("windowspecdefinition(")[1]


def results(spark, rows):
    full = [(i, p, t, "high", c, e, [] if ok else ["bad"]) for i, (p, t, c, e, ok) in enumerate(rows)]
    return spark.createDataFrame(full, "record_key int, attack_type string, ground_truth string, severity string, confidence double, elapsed_seconds double, validation_errors array<string>")


def test_metrics(spark):
    df = results(spark, [("DoS", "DoS", 0.9, 1.0, True), ("Benign", "Normal", 0.8, 2.0, True), ("DDoS", "benign", 0.7, 3.0, True), ("Unknown", "DoS", 0.0, 4.0, False)])
    row = E.metrics(df).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (2, 1, 1, 0)
    assert (row["accuracy_exact"], row["accuracy_binary"], row["precision"], row["recall"]) == (0.5, 0.75, 0.6667, 1.0)
    assert row["n_valid"] == 3 and row["avg_elapsed_seconds"] == 2.5
    assert E.metrics(df, mode="valid_only").first()["accuracy_binary"] == 0.6667


def test_missing_truth_blanks_the_figures(spark):
    df = results(spark, [("DoS", "DoS", 0.9, 1.0, True), ("DoS", None, 0.9, 1.0, True)])
    row = E.metrics(df).first()
    assert row["accuracy_exact"] is None and row["tp"] is None and row["f1"] is None and row["n_records"] == 2
    assert E.confusion(df).first()["tp"] is None


def test_zero_rows_give_nulls(spark):
    row = E.metrics(results(spark, [("DoS", "DoS", 0.9, 1.0, True)]).filter("false")).first()
    assert row["n_records"] == 0 and row["accuracy_exact"] is None and row["avg_elapsed_seconds"] == 0.0


@pytest.mark.parametrize("width", [3, 1000])
def test_running_progress(spark, width):
    df = spark.createDataFrame([("r", i, float(i % 3 + 1)) for i in range(20)] + [("s", 100, 5.0)], "run string, record_key long, elapsed_seconds double")
    rows = E.running_progress(df, block_width=width).filter("run = 'r'").orderBy("ordinal").collect()
    total = 0.0
    for i, r in enumerate(rows, 1):
        total += (i - 1) % 3 + 1
        assert (r["ordinal"], r["record_key"], r["elapsed_total"]) == (i, i - 1, total)
        assert r["pct"] == pytest.approx(5 * i) and r["remaining"] == pytest.approx(total / i * (20 - i))


def test_run_differences(spark):
    a = results(spark, [("DoS", "DoS", 0.0, 0.0, True), ("DoS", "Benign", 0.0, 0.0, True), ("x", "DoS", 0.0, 0.0, True)])
    b = results(spark, [("DDoS", "DoS", 0.0, 0.0, True), ("normal", "Benign", 0.0, 0.0, True)])
    got = {r["record_key"]: r["outcome"] for r in E.run_differences(a, b).collect()}
    assert got == {0: "lost", 1: "gained", 2: "only_a"}


def test_run_tag(spark):
    flags = lambda *values: [F.lit(v) for v in values]
    row = spark.range(1).select(E.run_tag(*flags(True, True, False, True, True), F.lit(7), F.lit("20260504_124624")), E.run_tag(*flags(False, True, True, False, False), F.lit(9))).first()
    assert tuple(row) == ("run_20260504_124624_rag_rerank_rf_stratified_n7", "run_norag_2stage_random_n9")


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_bottom_k_takes_the_same_rows_as_flag_first(spark, labelled, k):
    from flowspark.operators.bottom_k import bottom_k, stratified_samples

    got = bottom_k(labelled.repartition(7), "id", k, (3, 8), "label").collect()
    for seed in (3, 8):
        want = S.flag_first(labelled, lambda rows: F.lit(k), "id", seed=seed, strata=("label",)).where("picked")
        assert sorted(r["id"] for r in got if r["seed"] == seed) == sorted(r["id"] for r in want.collect())
    ranks = {}
    for r in got:
        ranks.setdefault((r["seed"], r["stratum"]), []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in ranks.values())
    both = stratified_samples(labelled, (k, 50), (3,), "id").collect()
    for n in {k, 50}:
        want = {r["id"] for r in S.stratified_sample(labelled, n, "id", seed=3).collect()}
        assert {r["id"] for r in both if r["n"] == n} == want
    assert bottom_k(labelled.limit(0), "id", k, (3,), "label").collect() == []
