"""Inputs as they come: repeated header names, rules with impossible dates, bytes that are no UTF-8."""

from flowspark.sources.flow_csv import read_cic
from flowspark.sources.raw_csv import numbered
from flowspark.sources.knowledge import read_rules


def test_repeated_header_names_are_numbered(spark, tmp_path):
    assert numbered(["a", " a", "b", "a "]) == ["a", "a.1", "b", "a.2"]
    (tmp_path / "day.csv").write_text("Flow ID, Fwd Header Length,Label, Fwd Header Length\nx,1,BENIGN,2\n")
    row = read_cic(spark, str(tmp_path / "*.csv")).first().asDict()
    assert (row["Fwd Header Length"], row["Fwd Header Length.1"]) == (1.0, 2.0)


def test_bad_rules_are_rejected_not_fatal(spark, tmp_path):
    folder = tmp_path / "rules"
    folder.mkdir()
    (folder / "date.yml").write_text("title: a\ndate: 2024-13-45\n")
    (folder / "latin.yml").write_bytes("title: caf\xe9\ndetection:\n  sel:\n    x: 1\n    y: [a]\n  many: [p, q]\n  condition: sel\n".encode("latin-1"))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read_rules(spark, str(tmp_path)).collect()}
    assert rows["date.yml"]["error"] == "malformed: ValueError"
    assert rows["latin.yml"]["title"] == "caf�"
    assert rows["latin.yml"]["detection"] == "Condição: sel\n  sel: x=1, y=['a']\n  many: [p, q]"
