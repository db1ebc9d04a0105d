"""The stored index: same scores as direct computation, whole blocks left out, no text read at query time."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from flowspark.operators import retrieval as V
from flowspark.sources.postings import Postings


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return {i: " ".join(rng.choices(vocabulary, weights, k=rng.choice([0, 3, 10, 80]))).title() if i % 40 else None for i in range(400)}


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    corpus = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(3)
    return Postings.build(corpus, str(tmp_path_factory.mktemp("index") / "p"), buckets=8, block_docs=16)


def plain(texts, query):
    docs = {i: (t or "").lower().split() for i, t in texts.items()}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(w for d in docs.values() for w in set(d))
    out = {}
    for i, d in docs.items():
        tf = Counter(d)
        parts = [math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(d) / mean)) for w in set(query.lower().split()) if tf[w]]
        if parts:
            out[i] = sum(parts)
    return out


QUERIES = {1: "w0 w1", 2: "w59", 3: "w40 W41 w42 w0", 4: "absent", 5: "", 6: "w2 w2 w3 absent"}


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_search_against_all_documents(spark, index, texts, k):
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id int, query_text string")
    got = index.search(queries, k).collect()
    for q, text in QUERIES.items():
        want = sorted(((-round(s, 12), i) for i, s in plain(texts, text).items()))[:k]
        mine = sorted((r["rank"], r["id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in mine] == [i for _, i in want]
        assert [s for *_, s in mine] == pytest.approx([-s for s, _ in want])


def test_blocks_are_left_out(spark, index):
    queries = spark.createDataFrame([(1, "w59 w58 w57")], "query_id int, query_text string")
    asked, first, open_ = index.probes(queries, 1)
    assert open_.count() < index._bounds(asked).count() - 2


def test_scorer_equals_the_direct_one_and_reads_no_text(spark, index, texts):
    corpus = spark.createDataFrame([(i, t or "") for i, t in texts.items()], "id long, text string")
    queries = spark.createDataFrame(list(QUERIES.items()), "query_id int, query_text string")
    pool = spark.createDataFrame([(q, d) for q in QUERIES for d in range(0, 400, 7)], "query_id int, id long")
    scored = index.scorer(queries)(pool)
    want = {(r["query_id"], r["id"]): r["score"] for r in V.bm25_scorer(queries, corpus)(pool).collect()}
    assert {(r["query_id"], r["id"]): r["score"] for r in scored.collect()} == pytest.approx(want)
    assert "text" not in scored._jdf.queryExecution().executedPlan().toString().replace("query_text", "")


def test_nothing_to_index(spark, tmp_path):
    empty = Postings.build(spark.createDataFrame([], "id long, text string"), f"{tmp_path}/p")
    assert empty.search(spark.createDataFrame([(1, "a")], "query_id int, query_text string")).collect() == []


def test_a_block_leaves_its_best_only(spark, index):
    """What a search keeps of a block does not grow with the documents that hold the query's words."""
    queries = spark.createDataFrame([(1, "w0 w1 w2"), (2, "w0 w3")], "query_id int, query_text string")
    _, first, _ = index.probes(queries, 1)
    assert 2 <= first.count() <= 8  # two blocks of about 16 documents for either query, nearly all of which hold w0


def test_copies_tie_in_any_block(spark, tmp_path):
    rng = random.Random(9)
    text = " ".join(f"v{rng.randrange(90)}" for _ in range(200))
    rows = [(f"d{i:03}", text if i % 3 else " ".join(rng.choices(text.split(), k=40))) for i in range(90)]
    index = Postings.build(spark.createDataFrame(rows, "id string, text string"), f"{tmp_path}/p", block_docs=10)
    got = index.search(spark.createDataFrame([("q", text)], "query_id string, query_text string"), 7).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [i for i, t in rows if t == text][:7]
