"""The set join over rows that share a doc_id, very long pairs, and components of chains and hubs, against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from flowspark.llm import ngram_join
from flowspark.llm.common import SLICE_BYTES
from flowspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def reached(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain(rows, n, num):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    able = [i for i, (doc, _) in enumerate(rows) if doc is not None and sets[i]]
    roots = reached(len(rows), [(i, j) for i in able for j in able if i < j and 100 * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])])
    least = {}
    for i in able:
        least[roots[i]] = min(least.get(roots[i], rows[i][0]), rows[i][0])
    return sorted(((doc, len(sets[i]), least[roots[i]] if i in able else doc) for i, (doc, _) in enumerate(rows)), key=str)


def test_rows_that_repeat_an_id(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(4)]

    def near(k):
        own = list(base[k])
        own[rng.randrange(60)] = rng.choice(words)
        return " ".join(own)

    rows = [(9, near(0)), (9, near(1)), (9, near(1)), (4, near(0)), (3, near(1)), (None, near(0)), (None, None), (4, ""), (7, near(2)), (7, near(3)), (2, near(3)), (2, near(3)), (8, None), (5, "one two"), (6, "ONE two")]
    rows.append(rows[0])
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, "clash") for i, t in order], "doc_id long, text string, key string").repartition(3)
        got = ngram_join.joined(df, ngram_join.Rule(3, 80, 100)).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == plain(rows, 3, 80)


def test_pieces_hold_all_pairs_and_bounded_text():
    rng = random.Random(4)
    size = [rng.choice([0, 10, 3000, SLICE_BYTES // 2, 2 * SLICE_BYTES]) for _ in range(700)]
    batch = pa.record_batch([pa.array(range(700)), pa.array(["a" * s for s in size]), pa.array([None if s == 10 else "b" for s in size])], ["a", "text_a", "text_b"])
    parts = list(ngram_join._pieces(batch.slice(5)))
    assert [x for p in parts for x in p["a"].to_pylist()] == list(range(5, 700))
    assert all(p.num_rows <= 256 and (p.num_rows == 1 or sum(map(len, p["text_a"].to_pylist())) <= SLICE_BYTES) for p in parts)


@pytest.mark.parametrize("kind", ["chain", "hub", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(6)
    name = [int(x) for x in rng.permutation(200) - 50]
    linked = {
        "chain": [(i, i + 1) for i in range(60)],
        "hub": [(150, i) for i in range(100)] + [(i, i + 1) for i in range(100, 120)] + [(5, 5)],
        "random": [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))],
        "none": [],
    }[kind]
    got = {r.node: r.component for r in components(spark.createDataFrame([(name[a], name[b]) for a, b in linked], "a long, b long")).collect()}
    roots = reached(200, linked)
    touched = {i for a, b in linked if a != b for i in (a, b)}
    least = {r: min(name[i] for i in range(200) if roots[i] == r) for r in set(roots)}
    assert got == {name[i]: least[roots[i]] for i in touched}


def test_pairs_of_near_copies_are_verified_in_turns(spark, monkeypatch):
    """Many near copies, all open pairs of which are left to turns: the groups are exact, and few pairs of a node are verified."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(130)] = f"x{i}_{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows.append((400, " ".join(base)))
    verified = []
    whole = ngram_join._verified

    def counted(pairs, *rest):
        verified.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_verified", counted)
    monkeypatch.setattr(ngram_join, "MANY_PAIRS", 0)
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Rule(5, 80, 100))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, 5, 80)
    assert len(verified) > 2 and sum(verified) <= 30 * len(rows), verified


def test_pairs_of_a_large_group_are_not_all_made(spark, monkeypatch):
    """Far pairs come in slices: those in a group of near copies grow with its nodes, not with their square."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(600):
        words = list(base)
        for _ in range(2):
            words[rng.randrange(130)] = f"x{i}_{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    made = []
    whole = ngram_join._close

    def counted(pairs, *rest):
        made.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(ngram_join, "_close", counted)
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Rule(5, 80, 100))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, 5, 80)
    assert sum(made) <= 15 * len(rows), made


def test_sets_that_share_a_passage_only_leave_before_pairs(spark):
    rng = random.Random(9)

    def fresh(n):
        return [f"w{rng.randrange(10**9)}" for _ in range(n)]

    passages = [fresh(30) for _ in range(3)]
    texts = []
    for i in range(60):
        own = fresh(300)
        texts.append(" ".join(own[:100] + passages[i % 3] + own[100:]))
    for i in range(0, 20, 2):  # near copies: four words changed, 12 of 328 shingles
        words = texts[i].split(" ")
        for k in (5, 90, 180, 270):
            words[k] = fresh(1)[0]
        texts.append(" ".join(words))
    rows = list(enumerate(texts))
    docs, rule = spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Rule(3, 90, 100)
    nodes = ngram_join.sets(docs, rule)
    signatures = nodes.select("node", "n_shingles", "prefix").mapInArrow(ngram_join._signature_task(rule, 2), "sig long, node long, need int")
    kept = {r.doc_id for r in ngram_join._members(signatures).select("node").distinct().join(nodes, "node").collect()}
    copied = {*range(0, 20, 2), *range(60, 70)}
    assert copied <= kept and len(kept - copied) <= 5
    assert sorted((tuple(r) for r in ngram_join.joined(docs, rule).collect()), key=str) == plain(rows, 3, 90)


@pytest.mark.parametrize(("num", "cut", "marks"), [(30, 2, 1 << 24), (50, 2, 1 << 6), (80, 30, 1 << 24), (90, 2, 1 << 6)])
def test_lists_left_out_lose_no_link(spark, monkeypatch, num, cut, marks):
    monkeypatch.setattr(ngram_join, "_boundary", lambda *_: cut)
    monkeypatch.setattr(ngram_join, "MARKS", marks)
    rng = random.Random(num)
    rows = []
    for _ in range(14):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([8, 12, 40, 120]))]
        for _ in range(8):
            share = rng.choice([0.01, 0.03, 0.1, 0.3])
            rows.append((len(rows), " ".join(w if rng.random() > share else f"w{rng.randrange(300)}" for w in base[rng.randrange(3) :])))
    got = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Rule(2, num, 100)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 2, num)


def test_few_far_pairs_are_made_without_turns(spark, monkeypatch):
    """Pairs of one group that are more than its own sets, but fewer than all sets, are made at once."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(130)]
    rows = []
    for i in range(30):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(130)] = f"x{i}_{rng.randrange(9)}"
        rows.append((i, " ".join(words)))
    rows += [(30 + i, " ".join(f"y{i}_{k}" for k in range(8))) for i in range(800)]
    torn = []
    whole = ngram_join._torn

    def counted(*args):
        torn.append(1)
        return whole(*args)

    monkeypatch.setattr(ngram_join, "_torn", counted)
    monkeypatch.setattr(ngram_join, "COMPARED", 0.5)
    monkeypatch.setattr(ngram_join, "_may_link", lambda rule: ngram_join.F.lit(True))
    found = ngram_join.joined(spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Rule(5, 80, 100))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain(rows, 5, 80)
    assert len(torn) == 1


@pytest.mark.parametrize("marks", [1 << 24, 1 << 6])
def test_prefixes_are_written_once(spark, monkeypatch, marks):
    """One table holds prefixes; sets that have copies are still one node each."""
    monkeypatch.setattr(ngram_join, "MARKS", marks)
    rng = random.Random(marks)
    rows = []
    for _ in range(60):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([2, 6, 40]))]
        for _ in range(rng.choice([1, 1, 3])):
            rows.append((rng.choice([None, len(rows)]), " ".join(words)))
    rows += rows[:20]
    written = []
    whole = ngram_join.stored

    def counted(df):
        written.append("prefix" in df.columns)
        return whole(df)

    monkeypatch.setattr(ngram_join, "stored", counted)
    docs, rule = spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.Rule(2, 80, 100)
    assert sorted((tuple(r) for r in ngram_join.joined(docs, rule).collect()), key=str) == plain(rows, 2, 80)
    assert sum(written) == 1
    found = ngram_join.sets(docs, rule)
    nodes = [r.node for r in ngram_join._prefixes(found, ngram_join._nodes(found)).collect()]
    assert sorted(nodes) == sorted({r.node for r in found.where("n_shingles > 1 AND doc_id IS NOT NULL").collect()})
