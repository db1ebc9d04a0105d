"""Medians from kept sketches are exact, part by part."""

import math
import random
import statistics

import pytest

from flowspark.operators import kept_medians as K
from flowspark.operators.cleaning import exact_medians


def test_parts_are_added_one_by_one(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i % 3, rng.gauss(0, 1), rng.choice([1, 1, 1, 2, 5]), float(i) if i % 2 else None, None if i % 5 else math.inf) for i in range(20_000)]
    df = spark.createDataFrame(rows, "part int, a double, b int, c double, d double").repartition(5).cache()
    columns, path = ["a", "b", "c", "d"], str(tmp_path / "k")
    for last in range(3):
        K.add_part(df.where(f"part = {last}"), columns, str(last), path)
        K.add_part(df.where(f"part = {last}"), columns, str(last), path)  # again: replaces
        own = [r for r in rows if r[0] <= last]
        got = K.kept_medians(df.where(f"part <= {last}"), columns, path)
        assert got == {"a": statistics.median(r[1] for r in own), "b": statistics.median(r[2] for r in own), "c": statistics.median(r[3] for r in own if r[3] is not None), "d": None}
        assert got == exact_medians(df.where(f"part <= {last}"), columns)
    assert K.kept_parts(spark, path).count() == 12


def test_bracket_is_widened_and_wrong_sketches_are_noticed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(K, "SLACK", 1e-9)
    df = spark.range(5000).selectExpr("cast(id * id as double) as x")
    K.add_part(df, ["x"], "a", f"{tmp_path}/k")
    assert K.kept_medians(df, ["x"], f"{tmp_path}/k") == {"x": (2499.0**2 + 2500.0**2) / 2}
    with pytest.raises(ValueError):
        K.kept_medians(df.selectExpr("x + 1e9 as x"), ["x"], f"{tmp_path}/k")
    one = spark.createDataFrame([(4.0,), (None,)], "x double")
    K.add_part(one, ["x"], "a", f"{tmp_path}/one")
    assert K.kept_medians(one, ["x"], f"{tmp_path}/one") == {"x": 4.0}
