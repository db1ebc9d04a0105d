import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark import domains as D
from flowspark.operators import cleaning as C
from flowspark.operators import reduction as R
from flowspark.plans import preprocess


@pytest.fixture(scope="module")
def cic(spark):
    rng = random.Random(42)
    labels = ["BENIGN", "DDoS", "PortScan", "Bot", "FTP-Patator"]
    rows = []
    for i in range(200):
        bytes_rate = {197: math.inf, 198: -math.inf, 199: math.nan}.get(i, rng.expovariate(1e-4))
        mean = {198: -5.0, 199: -10.0}.get(i, rng.random() * 500)
        rows.append((f"f{i}", "1.1.1.1", "2.2.2.2", "t", i, 80, rng.expovariate(1e-6), rng.randint(1, 999), rng.randint(0, 499),
                     bytes_rate, rng.expovariate(1e-2), mean, f" {labels[i % 5]} "))
    schema = ("`Flow ID` string, `Source IP` string, `Destination IP` string, `Timestamp` string, `Source Port` int, `Destination Port` int, "
              "`Flow Duration` double, `Total Fwd Packets` int, `Total Backward Packets` int, `Flow Bytes/s` double, `Flow Packets/s` double, "
              "`Fwd Packet Length Mean` double, `Label` string")
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def clean_cic(cic):
    return preprocess.preprocess_cic(cic).cache()


@pytest.fixture(scope="module")
def clean_unsw(spark):
    rng = random.Random(7)
    kinds = ["Normal", "DoS", "Exploits", "Fuzzers", "Reconnaissance", " ", "Generic", None]
    rows = [(f"10.0.0.{i}", i, "x", 80, ["tcp", "udp", "icmp"][i % 3], ["http", "dns", "ssh", "-", "ftp", None][i % 6],
             ["FIN", "CON", "INT", "REQ"][i % 4], rng.random(), rng.randint(0, 9999), "-" if i % 10 == 0 else str(i), kinds[i % 8],
             0 if kinds[i % 8] in ("Normal", " ") or i % 16 == 7 else 1) for i in range(160)]
    schema = ("srcip string, sport int, dstip string, dsport int, proto string, service string, state string, dur double, sbytes int, "
              "ct_ftp_cmd string, attack_cat string, label int")
    return preprocess.preprocess_unsw(spark.createDataFrame(rows, schema)).cache()


def test_cic_identifiers_gone(clean_cic):
    assert not set(D.CIC_IDENTIFIERS) & set(clean_cic.columns)
    assert {"label", "label_original", "dataset_source"} <= set(clean_cic.columns)


def test_cic_numbers_are_finite_and_not_negative(clean_cic):
    pdf = clean_cic.toPandas()
    numbers = pdf[C.numeric_columns(clean_cic)].to_numpy(dtype=float)
    assert len(pdf) == 200
    assert np.isfinite(numbers).all() and (numbers >= 0).all()


def test_cic_labels(clean_cic):
    assert {r[0] for r in clean_cic.select("label").distinct().collect()} == {"Benign", "DDoS", "Reconnaissance", "Botnet", "Brute Force"}
    assert clean_cic.filter("dataset_source <> 'CIC-IDS2017'").isEmpty()


def test_cic_without_label_fails(spark):
    with pytest.raises(ValueError):
        preprocess.preprocess_cic(spark.createDataFrame([(1.0,)], "a double"))


def test_unsw(clean_unsw):
    pdf = clean_unsw.toPandas()
    assert not {"srcip", "sport", "dstip", "dsport", "attack_cat"} & set(pdf.columns)
    assert "Unknown" not in set(pdf["label"])
    assert set(pdf.loc[pdf["label_original"] == "Normal", "label"]) == {"Benign"}
    assert {"Attack"} <= set(pdf["label"])  # no category but binary 1
    assert pdf[["proto", "service", "state", "ct_ftp_cmd", "sbytes"]].notna().all().all()
    assert sorted(pdf["proto"].unique()) == [0, 1, 2]


def test_category_codes_are_alphabetical(spark):
    df = spark.createDataFrame([("tcp",), ("udp",), (None,), ("icmp",), ("tc",), ("tcp",), ("-",)], "proto string")
    codes = {r["proto"]: r["code"] for r in C.encode_categories(df, ["proto"], "_x").withColumnRenamed("proto_x", "code").collect()}
    order = sorted(["tcp", "udp", "nan", "icmp", "tc", "-"])
    assert codes == {("nan" if k == "nan" else k) if k != "nan" else None: order.index(k) for k in order}


def test_binary_only_labels(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0)], "label int, dur double")
    got = {r["label_original"]: r["label"] for r in preprocess.preprocess_unsw(df).collect()}
    assert got == {"Normal": "Benign", "Attack": "Attack"}


@pytest.mark.parametrize("window_rows", [10, 1_000_000])
def test_exact_medians_match_numpy(spark, window_rows):
    rng = np.random.default_rng(3)
    n = 5000
    skewed = np.where(rng.random(n) < 0.34, 0.0, rng.exponential(1e6, n))  # one value holds a third of all rows
    rows = [(float(a), float(b), int(c), None if i % 7 else float(i)) for i, (a, b, c) in enumerate(zip(rng.normal(size=n), skewed, rng.integers(0, 9, n)))]
    rows[5] = (math.nan, math.inf, 3, None)
    df = spark.createDataFrame(rows, "a double, b double, c int, d double").repartition(5)
    got = C.exact_medians(df, ["a", "b", "c", "d"], window_rows=window_rows, accuracy=200)
    for j, c in enumerate("abcd"):
        values = [r[j] for r in rows if r[j] is not None and math.isfinite(r[j])]
        assert got[c] == pytest.approx(float(np.median(values)), abs=1e-12)


def test_median_of_empty_column_is_none(spark):
    df = spark.createDataFrame([(None, 1.0)], "a double, b double")
    assert C.exact_medians(df, ["a", "b"]) == {"a": None, "b": 1.0}


def test_scaling(spark):
    df = spark.createDataFrame([(float(i), i * 10, 5) for i in range(1, 6)], "a double, b int, c int")
    ranges = C.column_ranges(df, ["a", "b", "c"])
    assert ranges["a"] == {"min": 1.0, "max": 5.0}
    rows = C.scale(df, ranges).orderBy("a").collect()
    assert [r["a"] for r in rows] == [0, 0.25, 0.5, 0.75, 1.0]
    assert {r["c"] for r in rows} == {0.0}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1, float(i), None, math.nan if i else 2.0) for i in range(4)], "a int, b double, c double, d double")
    assert R.constant_columns(df) == ["a", "c", "d"]


def test_correlation_drop_is_not_greedy(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=400)
    b = a + rng.normal(scale=0.2, size=400)
    c = b + rng.normal(scale=0.2, size=400)
    free = rng.normal(size=400)
    df = spark.createDataFrame([tuple(map(float, row)) for row in zip(a, b, c, free)], "a double, b double, c double, free double")
    ab, bc, ac = np.corrcoef(a, b)[0, 1], np.corrcoef(b, c)[0, 1], np.corrcoef(a, c)[0, 1]
    threshold = (min(ab, bc) + ac) / 2
    assert ac < threshold < min(ab, bc)
    assert R.remove_correlated(df, threshold).columns == ["a", "free"]


def test_correlated_pair_keeps_first(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, float(v)) for i, v in enumerate([5, 3, 1, 4, 2], 1)], "a double, b double, c double")
    assert R.remove_correlated(df).columns == ["a", "c"]


def test_wide_correlations_with_gaps_match_pandas(spark):
    import pandas as pd

    rng = np.random.default_rng(1)
    data = pd.DataFrame(rng.normal(loc=1e6, size=(300, 12)), columns=[f"c{i}" for i in range(12)])
    data["c3"] = data["c1"] * 2 + rng.normal(size=300)
    data = data.mask(rng.random(data.shape) < 0.1)
    data["flat"] = 4.0
    rows = [tuple(None if v != v else float(v) for v in row) for row in data.to_numpy()]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data.columns)).repartition(4)
    expected = data.corr()
    got = R.correlations(df, list(data.columns)).collect()
    assert len(got) == 78
    for r in got:
        want = expected.loc[r["col_a"], r["col_b"]]
        assert (r["r"] is None and math.isnan(want)) or r["r"] == pytest.approx(want, abs=1e-9)


def test_column_artifact_applies_to_new_data(spark):
    df = spark.createDataFrame([(1, float(i), i) for i in range(3)], "a int, b double, c int")
    artifact = R.kept_columns(df, R.remove_constant(df))
    assert R.apply_columns(df, artifact).columns == ["b", "c"]


def test_clip_needs_matching_name(spark):
    df = spark.createDataFrame([(-1.0, -1.0, None)], "`Fwd Len` double, `fwd len2` double, `Total` double")
    assert tuple(C.clip_negatives(df, df.columns).first()) == (0.0, -1.0, None)


def test_label_columns_differing_in_case(spark):
    df = spark.createDataFrame([(1,)], "LABEL int")
    assert C.resolve_column(df, ["Label"]) == "LABEL"
    assert C.resolve_column(df, ["other"]) is None


def test_dash_variants(spark):
    df = spark.createDataFrame([("Web Attack – XSS",), ("Web Attack \x96 XSS",), ("Web Attack - XSS",), ("Web Attack  XSS",)], "Label string")
    tidy = {r[0] for r in C.map_labels(df, "Label", D.CIC, tidy_dashes=True).select("label").collect()}
    exact = sorted(r[0] for r in C.map_labels(df, "Label", D.CIC).select("label").collect())
    assert tidy == {"Web Attack"}
    assert exact == ["Unknown", "Unknown", "Web Attack", "Web Attack"]


def test_unify_fills_gaps(spark):
    left = spark.createDataFrame([("x", "CIC-IDS2017", "6", 1.0)], "label string, dataset_source string, protocol string, a double")
    right = spark.createDataFrame([("y", "UNSW-NB15", 2, math.nan)], "label string, dataset_source string, b int, a double")
    rows = {r["label"]: r for r in C.unify(left, right).collect()}
    assert rows["x"]["b"] == 0 and rows["x"]["protocol"] == 6.0
    assert rows["y"]["protocol"] == 0.0 and rows["y"]["a"] == 0.0


def test_whole_job(spark, cic, tmp_path):
    unsw = spark.createDataFrame([("tcp", float(i), i * 2, "DoS" if i % 2 else "Normal", i % 2) for i in range(40)],
                                 "proto string, dur double, sbytes int, attack_cat string, label int")
    folders = preprocess.run(cic, unsw, str(tmp_path))
    unified = spark.read.parquet(folders["unified"])
    assert unified.count() == 240
    features = C.numeric_columns(unified)
    spread = unified.agg(*[F.min(C.name(c)).alias(f"a{i}") for i, c in enumerate(features)]).first()
    assert all(v >= 0 for v in spread)
    from flowspark.sources.tables import read_ranges

    assert set(read_ranges(spark, folders["ranges"])) == set(features)
    report = spark.read.json(folders["report"])
    assert {r["dataset"]: r["records"] for r in report.collect()} == {"cic": 200, "unsw": 40, "unified": 240}


def test_codes_of_values_with_a_long_common_prefix(spark):
    values = spark.createDataFrame([(f"customer#{i * 7919 % 3000:09d}",) for i in range(3000)], "v string")
    got = [r[0] for r in C.ordered_codes(values, "v", "code").orderBy("v").select("code").collect()]
    assert got == list(range(3000))
