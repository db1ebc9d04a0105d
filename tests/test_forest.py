"""Forests: bins and trees against plain loops, MLlib's model as arrays, training that is no job per level."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from flowspark.operators import classifier as M
from flowspark.operators import forest as R

FEATURES = ["a", "b", "c d", "e.f"]


def rows(n=900, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c, d = rng.normal(size=n), rng.integers(0, 4, n).astype(float), rng.exponential(size=n), rng.integers(0, 60, n).astype(float)
    threat = ((a > 0.3) & (b < 2)) ^ (rng.random(n) < 0.05)
    return [(*map(float, x), "DoS" if y else "BENIGN") for *x, y in zip(a, b, c, d, threat)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), "a double, b double, `c d` double, `e.f` double, label string").cache()


def test_cut_points_leave_bins_of_about_equal_weight():
    rng = np.random.default_rng(2)
    for n, bins in ((5, 4), (400, 32), (3000, 16), (50, 2)):
        values, weight = np.round(rng.normal(size=n), 2), rng.choice([0.5, 2.0], n)
        distinct = sorted(set(values))
        counts = [weight[values == v].sum() for v in distinct]
        expected, target, upto = [], weight.sum() / bins, counts[0]
        for i in range(1, len(distinct)):
            before, upto = upto, upto + counts[i]
            if len(distinct) <= bins or abs(before - target) < abs(upto - target):
                expected.append((distinct[i - 1] + distinct[i]) / 2)
                target += weight.sum() / bins
        assert R.cut_points(values, weight, bins) == pytest.approx(expected)


def test_best_split_is_that_of_a_plain_search():
    rng = np.random.default_rng(3)
    counts, weights = rng.integers(0, 4, (20, 2, 5, 2)).astype(float), (0.7, 1.9)
    counts[:, 1] = rng.permuted(counts[:, 0], axis=1)
    counts[0] = 0
    counts[0, :, 2] = 3  # one bin holds all: no split
    feature, split, left = R.best_splits(counts, weights)
    assert feature[0] == -1
    impurity = lambda c: 0.0 if not c.any() else 2 * np.prod(c * weights) / (c * weights).sum()
    for i in range(1, 20):
        whole = counts[i, 0].sum(axis=0)
        gains = {(f, b): impurity(whole) - impurity(counts[i, f, : b + 1].sum(axis=0)) - impurity(counts[i, f, b + 1 :].sum(axis=0)) for f in range(2) for b in range(4)}
        if feature[i] >= 0:
            assert gains[feature[i], split[i]] == pytest.approx(max(gains.values()))
            assert left[i].tolist() == counts[i, feature[i], : split[i] + 1].sum(axis=0).tolist()
        else:
            assert max(gains.values()) == pytest.approx(0, abs=1e-9)


def test_leaves_hold_the_shares_of_the_rows_that_reach_them(monkeypatch):
    monkeypatch.setattr(R, "SLICE", 3)
    rng = np.random.default_rng(4)
    codes, target, weights = rng.integers(0, 8, (5, 300)).astype(np.uint8), rng.integers(0, 2, 300), (0.8, 1.25)
    nodes, benign = R.grown(codes, target, weights, 8, 6, 3, np.random.default_rng(9))
    drawn, reached, depth = np.random.default_rng(9).poisson(1.0, 300), {}, []
    for i in range(300):
        at, steps = 0, 0
        while nodes[at] & 0xFFFF != R.LEAF:
            at, steps = int(nodes[at] >> 32) + int(codes[nodes[at] >> 16 & 0xFFFF, i] > (nodes[at] & 0xFFFF)), steps + 1
        reached.setdefault(at, []).append(i)
        depth.append(steps)
    assert max(depth) == 6 and len(nodes) == 2 * sum(nodes & 0xFFFF == R.LEAF) - 1
    for at, own in reached.items():
        weight = [sum(drawn[i] * weights[c] for i in own if target[i] == c) for c in (0, 1)]
        if sum(weight):
            assert benign[at] == pytest.approx(weight[0] / sum(weight))
        assert R.shares(codes.T[own], [(nodes, benign)]) == pytest.approx(benign[at])
    inner = np.flatnonzero(nodes & 0xFFFF != R.LEAF)
    leaf = {i for i in range(len(nodes))} - set(inner)
    pairs = [(first, first + 1) for first in nodes[inner] >> 32]
    assert all((benign[a] >= 0.5) != (benign[b] >= 0.5) for a, b in pairs if {a, b} <= leaf)


def test_training_has_no_job_per_level_and_does_not_depend_on_partitions(spark, table):
    context = spark.sparkContext
    context.setJobGroup("forest", "training")
    try:
        model = M.train_forest(table, FEATURES, trees=6, depth=20)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("forest")) <= 8  # MLlib: one per level and more
    other = M.train_forest(table.repartition(5).orderBy("a"), FEATURES, trees=6, depth=20)
    assert all((x[0] == y[0]).all() and (x[1] == y[1]).all() for x, y in zip(model.trees, other.trees, strict=True))
    assert M.holdout_metrics(M.score(table, model)).first()["accuracy"] > 0.93


def test_rows_beyond_a_task_are_fitted_distributed(spark, table, tmp_path):
    model = M.train_forest(table, FEATURES, trees=8, depth=6, in_tasks=3000)
    M.save_model(model, str(tmp_path))
    again = M.load_model(str(tmp_path))
    assert again.features == FEATURES and len(again.trees) == 8
    a, b = (sorted(M.score(table, m).collect()) for m in (model, again))
    assert a == b and M.holdout_metrics(M.score(table, model)).first()["accuracy"] > 0.93


def test_scores_are_those_of_the_model_of_mllib(spark, table):
    numbered = VectorAssembler(inputCols=["a", "b", "c d"], outputCol="x").transform(table.withColumns({"target": (F.col("label") == "DoS").cast("double"), "weight": F.col("b") + 1}))
    fitted = RandomForestClassifier(featuresCol="x", labelCol="target", weightCol="weight", numTrees=7, maxDepth=5, seed=3).fit(numbered)
    forest = M.from_stored(spark, fitted, ["a", "b", "c d"])
    pairs = M.score(fitted.transform(numbered), forest).select("rf_benign", "rf_label", vector_to_array("probability")[0].alias("p")).collect()
    assert [r["rf_benign"] for r in pairs] == pytest.approx([r["p"] for r in pairs], abs=1e-12)
    assert all((r["rf_label"] == "Benign") == (r["rf_benign"] >= 0.5) for r in pairs)


def test_odd_values_score_as_zero(spark, table):
    model = M.train_forest(table, FEATURES, trees=3, depth=4)
    odd = spark.createDataFrame([("x", None, float("nan"), 1), ("0", 0.0, float("-inf"), 2)], "a string, b double, `c d` double, id int")
    found = M.score(odd, model).collect()
    assert found[0]["rf_benign"] == found[1]["rf_benign"] and found[0]["a"] == "x" and np.isnan(found[0]["c d"])


def test_sources_are_scored_in_one_pass(spark, table):
    one, two = M.train_forest(table, ["a", "b"], trees=3, depth=4), M.train_forest(table, ["c d", "a"], trees=4, depth=3)
    named = table.withColumns({"rf_origin": F.when(F.col("b") == 0, "x").when(F.col("b") == 1, "y").when(F.col("b") == 2, "z"), "id": F.monotonically_increasing_id()})
    found = M.score_by_source(named, {"x": one, "y": two}, "rf_origin")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1  # one per source before, over as many scans
    assert found.columns == [*named.columns, "rf_label", "rf_confidence", "rf_benign"]
    got = {r["id"]: (r["rf_label"], r["rf_confidence"], r["rf_benign"]) for r in found.collect()}
    alone = {r["id"]: (r["rf_label"], r["rf_confidence"], r["rf_benign"]) for s, m in (("x", one), ("y", two)) for r in M.score(named.filter(F.col("rf_origin") == s), m).collect()}
    assert len(got) == 900 and {k: got[k] for k in alone} == alone
    assert {v for k, v in got.items() if k not in alone} == {("Unknown", 0.0, None)}
    assert {r["rf_label"] for r in M.score_by_source(named, {}, "rf_origin").collect()} == {"Unknown"}


def test_split_of_a_sample_does_not_read_its_source_again(spark, tmp_path):
    spark.range(500).selectExpr("id", "if(id % 3 = 0, 'BENIGN', 'DoS') label").write.parquet(str(tmp_path / "flows"))
    source = spark.read.parquet(str(tmp_path / "flows"))
    split = M.holdout_split(source, "id", sample_size=200)
    assert not set(split.inputFiles()) & set(source.inputFiles())  # before, each pass of the split sampled anew
    assert split.count() == 200 and split.filter("is_test").count() == 40
