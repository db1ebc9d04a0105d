"""Repeated passages in rows with repeated or absent doc_id, and frequent passages in many contexts, against all 200-byte windows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np

from flowspark.llm import repeats


def plain(rows):
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[k : k + 200] for k in range(len(b) - 199))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                covered[k : k + 200] = b"\1" * 200
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        runs = sum(1 for k in range(len(b)) if covered[k] and (not k or not covered[k - 1]))
        out.append((i, len(b), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_rows_without_their_own_id(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    p, q = text(300), text(260)
    rows = [(1, text(80) + p + text(40)), (1, text(500)), (None, "x" + p), (5, p + "tail"), (None, q), (None, None), (2, text(30) + q), (2, q), (7, ""), (7, None), (3, p), (3, p)]
    want = plain(rows)
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(i, t, "clash") for i, t in order], "doc_id long, text string, N_Bytes string").repartition(3)
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.cleaned(df).collect()) == want


def test_frequent_passage_in_many_contexts(spark):
    rng = random.Random(9)
    core = "".join(rng.choice("abcdefgh") for _ in range(120))
    lefts = ["".join(rng.choice("ab") for _ in range(110)) for _ in range(6)]
    rows = []
    for i in range(300):
        left, right = rng.choice(lefts), rng.choice(lefts)
        cut, end = rng.randint(0, 110), rng.randint(0, 110)
        rows.append((i, "".join(rng.choice("xyz") for _ in range(60)) + left[cut:] + core + right[:end] + "".join(rng.choice("xyz") for _ in range(60))))
    got = repeats.cleaned(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(rows)


def test_least_between_places():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = rng.integers(0, 50, n)
        least = repeats._least_of(values)
        pairs = [(a, b) for a in range(n) for b in range(a + 1, n)]
        if pairs:
            a, b = np.array(pairs).T
            assert least(a, b).tolist() == [values[x + 1 : y + 1].min() for x, y in pairs]
