"""Large JSON documents in byte ranges: the same objects whatever the cut, with strings that look like structure."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest

from flowspark.sources import json_split as J
from flowspark.sources import knowledge as K


def bundle(seed: int, n: int) -> dict:
    rng = random.Random(seed)
    odd = ['"', "\\", "\\\\", '\\"', "{", "}", "[", "]", "],", ":", '"objects": [', "é", "\n", " ", "x"]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
    objects = [{"id": f"o{i}", "type": "attack-pattern", "name": text(), "description": text(), "x_mitre_platforms": [text(), "]"],
                "external_references": [{"source_name": text(), "external_id": "{"}]} for i in range(n)]
    return {"type": "bundle", "notes": [{"id": "no", "name": text()}, [{"id": "no"}]], "meta": {"objects": [{"id": "no"}]}, "objects": objects, "after": [{"id": "no"}]}


def test_quotes_and_levels():
    data = np.frombuffer(b'{"a\\"{": "\\\\", "b": [1]}', np.uint8)
    text = data.tobytes()
    assert [i for i in np.flatnonzero(J.quotes(data))] == [i for i, c in enumerate(text) if c == 34 and i != 4]
    step, after = J.levels(data, False, 0)
    assert after[-1] == 0 and after.max() == 2
    for cut in range(1, len(text)):  # either half alone, with the state that the other leaves
        if text[cut - 1] == 92:
            continue
        odd, outside, _ = J.summary(data[:cut])
        other, out, ins = J.summary(data[cut:])
        assert outside + (ins if odd else out) == 0 and odd == other


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_same_objects_for_every_cut(spark, tmp_path, indent, ascii_only):
    docs = [bundle(1, 40), bundle(2, 3)]
    for name, doc in zip("ab", docs, strict=True):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii_only), encoding="utf-8")
    (tmp_path / "c.json").write_text('{"objects": [], "x": 1}')
    (tmp_path / "d.json").write_text("")
    for size in (97, 1000, 1 << 20):
        rows = J.array_objects(spark, f"{tmp_path}/*.json", "objects", size).collect()
        got = sorted((r.file, r.position, json.loads(r.body)["id"]) for r in rows)
        assert got == [(f, i, o["id"]) for f, doc in enumerate(docs) for i, o in enumerate(doc["objects"])], size


def test_stix_rows_equal_the_json_reader(spark, tmp_path):
    path = str(tmp_path / "x.json")
    with open(path, "w", encoding="utf-8") as out:
        json.dump(bundle(5, 60), out, ensure_ascii=False)
    plain = spark.read.schema(f"objects array<struct<{K.STIX_OBJECT}>>").option("multiLine", True).json(path)
    want = plain.selectExpr("posexplode(objects) as (position, o)").select("position", "o.*").collect()
    got = K.read_stix(spark, path, 512)
    assert got.columns == plain.selectExpr("posexplode(objects) as (position, o)").select("position", "o.*").columns
    assert sorted(got.collect(), key=lambda r: r.position) == sorted(want, key=lambda r: r.position)
