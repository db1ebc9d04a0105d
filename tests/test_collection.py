"""The bucketed collection: upserts touch their buckets only, versions are whole, a crash before the commit changes nothing."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from flowspark.sources.collection import Collection, VersionTaken


@pytest.fixture
def kept(spark, tmp_path):
    return Collection.create(spark.range(5000).selectExpr("id", "concat('t', id) as text", "array(cast(id as float)) as v"), f"{tmp_path}/c", buckets=32)


def files(kept):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(kept.path) if "/data/" in d for f in names if f.endswith(".parquet")}


def test_upsert_against_a_dict(spark, kept):
    rng, want = random.Random(1), {i: f"t{i}" for i in range(5000)}
    for step in range(3):
        batch = [(rng.randrange(6000), f"{step}-{k}", k) for k in range(300)]
        kept.upsert(spark.createDataFrame(batch, "id long, text string, seq long").repartition(4))
        want.update({i: t for i, t, _ in batch})
    got = kept.rows()
    assert got.columns == ["id", "text", "v"] and {r.id: r.text for r in got.collect()} == want and got.count() == len(want) == kept.size()
    assert kept.rows(0).count() == 5000 and kept.versions() == [0, 1, 2, 3]


def test_small_batch_leaves_other_buckets_alone(spark, kept):
    before, first = files(kept), kept.manifest()
    same = [r.id for r in kept.rows().where(F.pmod(F.xxhash64("id"), F.lit(32)).isin(3, 7)).orderBy("id").limit(50).collect()]
    after = kept.upsert(spark.createDataFrame([(i, "new", 0) for i in same], "id long, text string, seq long"))
    changed = {b for b in after.folders if after.folders[b] != first.folders[b]}
    assert changed == {3, 7} and before.items() <= files(kept).items()
    assert kept.rows().where("text = 'new'").count() == 50 and kept.rows().count() == 5000


def test_crash_before_the_commit(spark, kept, monkeypatch):
    def crash(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m, pytest.raises(OSError):
        m.setattr(Collection, "_commit", crash)
        kept.upsert(spark.createDataFrame([(1, "x", 0)], "id long, text string, seq long"))
    again = Collection(spark, kept.path)
    assert again.versions() == [0] and again.rows().where("text = 'x'").count() == 0
    assert again.vacuum() == 1 and again.rows().count() == 5000  # the orphan of the crash


def test_second_writer_of_a_version_tries_again(spark, kept):
    batch = spark.createDataFrame([(1, "mine", 0)], "id long, text string, seq long")
    stale = kept._merged(kept.manifest(), batch, "seq")
    kept.upsert(spark.createDataFrame([(2, "theirs", 0)], "id long, text string, seq long"))
    with pytest.raises(VersionTaken):
        kept._commit(stale)
    kept.upsert(batch)
    assert {r.id: r.text for r in kept.lookup(spark.createDataFrame([(1,), (2,), (99999,)], "id long")).collect()} == {1: "mine", 2: "theirs"}


def test_delete_reset_and_empty(spark, kept, tmp_path):
    kept.delete(spark.range(10))
    assert kept.rows().count() == 4990 == kept.size()
    assert kept.upsert(kept.rows().limit(0).withColumn("seq", F.lit(0))).version == 1
    kept.reset()
    assert kept.rows().collect() == [] and kept.size() == 0 and kept.rows(0).count() == 5000
    kept.upsert(spark.createDataFrame([(7, "back", 0)], "id long, text string, seq long"))
    assert [(r.id, r.text, r.v) for r in kept.rows().collect()] == [(7, "back", None)]
    assert kept.vacuum() > 0 and kept.versions() == [3] and kept.rows().count() == 1
    empty = Collection.create(spark.createDataFrame([], "id long, x int"), f"{tmp_path}/e")
    assert empty.rows().collect() == [] and empty.size() == 0
    with pytest.raises(VersionTaken):
        Collection.create(spark.createDataFrame([], "id long, x int"), f"{tmp_path}/e")
