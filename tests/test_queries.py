"""Every registered query against its SQL, and the shape of the driver contract."""

import pytest

import check_oracles
import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SLOW = {"triage_flow", "preprocess_unified", "config_grid", "runs_scan"}


@pytest.fixture(scope="module")
def duck():
    return check_oracles.connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in SLOW])
def test_query_equals_sql(spark, duck, name):
    status, rows, detail = check_oracles.compare(spark, duck, FOLDER, name)
    assert status in ("ok", "rows") and rows > 0, detail


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["dataset_source", "shape", "rate_class", "n_flows", "n_threats", "threat_share"] and not df.isEmpty()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
