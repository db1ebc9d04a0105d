import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import retrieval as V


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 16))
    base[100:200] = base[0]  # a third of all vectors are copies of one
    base[250] = 0.0
    return base


def brute(queries, corpus, k):
    unit = lambda m: m / np.where(np.linalg.norm(m, axis=1, keepdims=True) > 0, np.linalg.norm(m, axis=1, keepdims=True), 1)
    d = np.round(np.maximum(0, 1 - unit(queries) @ unit(corpus).T), 12)
    return {(q, r + 1): (int(i), d[q, i]) for q in range(len(queries)) for r, i in enumerate(np.lexsort((np.arange(len(corpus)), d[q]))[:k])}


@pytest.mark.parametrize("block_rows, held_bytes", [(7, 0), (64, 0), (4096, 0), (64, 1 << 13), (64, 1 << 20)])
def test_nearest_equals_brute_force_for_any_block_size(spark, vectors, block_rows, held_bytes):
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    wide = np.array([[np.float64(np.float32(x)) for x in v] for v in vectors])
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide[:40])], "query_id long, query_embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["id"], r["distance"]) for r in V.nearest(queries, corpus, 6, block_rows=block_rows, held_bytes=held_bytes).collect()}
    want = brute(wide[:40], wide, 6)
    assert got.keys() == want.keys()
    assert all(got[key][0] == want[key][0] and got[key][1] == pytest.approx(want[key][1], abs=1e-9) for key in want)


def test_a_small_corpus_is_held_for_many_queries(spark, vectors):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    queries, corpus = spark.createDataFrame(rows, "query_id long, query_embedding array<double>"), spark.createDataFrame(rows[:20], "id long, embedding array<double>")
    hits = lambda held: sorted(map(tuple, V.nearest(queries, corpus, 3, block_rows=50, held_bytes=held).select("query_id", "id", "rank").collect()))
    assert hits(20 * (8 * 16 + 64)) == hits(0)


def test_held_side_leaves_no_exchange_below_python(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, embedding array<float>")
    plan = V.nearest(df.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding")), df, 2)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in text and "Exchange" not in text[text.index("MapInPandas"):]


def test_pairing_reports_both_sides(spark):
    documents = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    embeddings = spark.createDataFrame([(2, [1.0]), (3, [2.0])], "id int, embedding array<float>")
    assert {r["id"]: r["pairing"] for r in V.pairing(documents, embeddings).collect()} == {1: "no vector", 2: "paired", 3: "no document"}
    with pytest.raises(Exception, match="do not pair"):
        V.zip_embeddings(documents, embeddings).collect()


def test_no_cross_join_and_no_full_group(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, embedding array<float>")
    plan = V.nearest(df.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_embedding")), df, 2, block_rows=5, held_bytes=0)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in text and "NestedLoop" not in text and "WindowGroupLimit" in text


def test_rescoring_keeps_pool_order_for_single_hit(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.2], "s1"), (2, [0.1, 1.0], "s2"), (3, [0.9, 0.1], "s2")], "id long, embedding array<float>, source string")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, query_embedding array<double>")
    scorer = lambda pool: pool.withColumn("score", F.col("id").cast("double"))
    both = V.retrieve(queries, corpus, top_k=2, scorer=scorer).orderBy("rank").collect()
    assert [r["id"] for r in both] == [3, 2]
    assert both[0]["distance"] == pytest.approx(1 - 1 / (1 + math.exp(-3)), abs=1e-9)
    single = V.retrieve(queries, corpus, top_k=2, scorer=scorer, source="s1").collect()
    assert len(single) == 1 and single[0]["distance"] == single[0]["dense_distance"]


def test_bm25_matches_direct_computation(spark):
    texts = ["Port scan of ports", "brute force login login", "the quiet port", "login from the port scan host"]
    corpus = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    queries = spark.createDataFrame([(0, "login scan scan"), (1, "absent")], "query_id int, query_text string")
    pool = spark.createDataFrame([(q, d) for q in range(2) for d in range(4)], "query_id int, id int")
    got = {(r["query_id"], r["id"]): r["score"] for r in V.bm25_scorer(queries, corpus)(pool).collect()}
    docs = [t.lower().split() for t in texts]
    mean = sum(map(len, docs)) / 4

    def score(terms, d):
        total = 0.0
        for t in terms:
            df, tf = sum(t in x for x in docs), docs[d].count(t)
            if tf:
                total += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        return total

    assert got == {(q, d): pytest.approx(score({"login", "scan"} if q == 0 else {"absent"}, d)) for q in range(2) for d in range(4)}


def test_context_gate(spark):
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    hits = spark.createDataFrame([(1, 0.6), (1, 0.55), (2, 0.7)], "query_id int, dense_distance double")
    got = {r["query_id"]: (r["best_distance"], r["use_context"]) for r in V.context_gate(hits, queries).collect()}
    assert got == {1: (0.55, True), 2: (0.7, False), 3: (1.0, False)}


def pack(docs, budget):
    labels = {"mitre_attack": "MITRE ATT&CK"}
    total, parts = 0, []
    for i, (source, title, text) in enumerate(docs, 1):
        label = labels.get(source, source)
        room = budget - total - len(f"[{label}] {title}") - 20
        if room <= 0:
            break
        block = f"--- Reference {i} ({label}) ---\n" + (text[:room] + "..." if len(text) > room else text)
        parts.append(block)
        total += len(block)
    return "\n\n".join(parts)


@pytest.mark.parametrize("tokens", [10, 40, 60, 75, 200])
def test_context_packing(spark, tokens):
    docs = [("mitre_attack", "T1", "ã" * 90), ("notes", "long title " * 3, "b" * 120), ("notes", "c", "c" * 30), ("x", "d", "d" * 400)]
    hits = spark.createDataFrame([(7, i, *d) for i, d in enumerate(docs, 1)], "query_id int, rank int, source string, title string, text string")
    assert V.pack_context(hits.repartition(3), tokens).first()["context"] == pack(docs, tokens * 4)


def test_embedder_slots(spark):
    df = spark.createDataFrame([(1, "port scan"), (2, "scan port"), (3, "login"), (4, "")], "id int, text string")
    model = V.embed_texts(df, 64)
    rows = {r["id"]: r["embedding"] for r in V.apply_embedder(model, df).collect()}
    assert len(rows[1]) == 64 and rows[1] == rows[2] != rows[3]
    assert sum(x * x for x in rows[1]) == pytest.approx(1, abs=1e-5) and not any(rows[4])
    custom = V.embed_with(df, lambda texts: [[float(len(t)), 1.0] for t in texts], batch_size=2)
    assert {r["id"]: r["embedding"] for r in custom.collect()} == {1: [9.0, 1.0], 2: [9.0, 1.0], 3: [5.0, 1.0], 4: [0.0, 1.0]}


def test_unpaired_vector_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    vecs = spark.createDataFrame([(1, [1.0])], "id int, embedding array<float>")
    with pytest.raises(Exception, match="do not pair"):
        V.zip_embeddings(docs, vecs).collect()


def test_a_task_holds_few_distances(monkeypatch):
    """A batch of many corpus rows is folded in pieces, and the hits are those of the whole batch."""
    import numpy as np
    import pandas as pd

    random = np.random.default_rng(3)
    frame = lambda n: pd.DataFrame({"_id": range(n), "_v": list(random.random((n, 4)))})
    held, corpus, cells = frame(50), frame(20_000), []
    whole = V._block_nearest

    def counted(q, c, *rest):
        cells.append(len(q) * len(c))
        return whole(q, c, *rest)

    expected = whole(held, corpus, 3, "q", "id").sort_values(["q", "distance", "id"]).to_numpy().tolist()
    monkeypatch.setattr(V, "_block_nearest", counted)
    found = pd.concat(V._fold_corpus(held, 3, "q", "id")([corpus])).sort_values(["q", "distance", "id"])
    assert found.to_numpy().tolist() == expected
    assert max(cells) <= V.FOLD_CELLS
