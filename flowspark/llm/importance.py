"""Resampling a corpus towards a target distribution by hashed n-gram importance weights.

* Both sides are bags of hashed n-grams: every run of 1 to 3 consecutive words falls into the bucket
  ``crc32 % BUCKETS``.  A task folds its texts into one array of counts; what is shuffled and collected is
  one long per bucket, whatever the corpus holds.
* The gain of a bucket is the smoothed log-ratio of both sides, in thousandths and rounded down.  A
  document's weight is the sum of its features' gains, taken from the array of gains.
* score = weight + Gumbel noise from a hash of doc_id: the k highest scores are a sample without
  replacement in proportion to the weights' exponentials.
* The k-th score is found by a distributed quickselect over the composite key (score falling, doc_id, row):
  a few random keys of the remaining interval are pivots, exact counts of the keys below, at and above each
  name the interval that holds the k-th, until few enough keys are left to list.  Only counts and pivots
  reach the driver.  Winners alone are sorted, by ranges, and ranked by range offsets.

Nulls and edge cases: a null or empty text has no words, weight 0 and is never drawn; rows without doc_id
are hashed as the empty id and come first among equal scores; equal (score, doc_id) keep the order of the
table; repeated rows count each; very long texts are read in pieces that carry two words over; columns with
the names of results, in any case, are replaced; empty tables give an empty result, an empty target leaves
the smoothed ratio.  Reruns over the same files agree.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.llm.common import stored
from flowspark.llm.tables import others, running

BUCKETS = 10_000
PIECE = 1 << 20
PIVOTS, FEW = 15, 512
RANKED_ROWS = 100_000
RESULTS = ("n_features", "weight", "score", "rank", "n_words", "text")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def pieces(text: bytes, limit: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists that end between words."""
    text, at = text.lower(), 0
    while at < len(text):
        gap = _GAP.search(text, at + limit) if at + limit < len(text) else None
        end = gap.start() if gap else len(text)
        yield _WORD.findall(text, at, end)
        at = end


def features(text: bytes, limit: int = PIECE) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the n-grams that end in them) for each piece; each CRC goes on from that of the shorter n-gram."""
    before: list[bytes] = []
    for new in pieces(text, limit):
        words, n = before + new, len(before)
        spaced = [b" " + w for w in words[1:]]
        one = list(map(zlib.crc32, words))
        two = list(map(zlib.crc32, spaced, one))
        three = list(map(zlib.crc32, spaced[1:], two))
        yield len(new), np.array(one[n:] + two[max(n - 1, 0) :] + three, dtype=np.int64) % BUCKETS
        before = words[-2:]


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for value in batch.column("text").cast(pa.large_binary()):
        yield value.as_py() or b""


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for text in _texts(batch):
            for _, found in features(text):
                total += np.bincount(found, minlength=BUCKETS)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], ["bucket", "n"])


def counts(texts: DataFrame) -> list[int]:
    """How many features of all ``texts(text)`` each bucket holds."""
    found = texts.select("text").mapInArrow(_count_task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * BUCKETS
    for row in found:
        out[row.bucket] = row.n
    return out


def gains(corpus: list[int], target: list[int]) -> np.ndarray:
    """Each bucket's log-ratio of target to corpus, in whole thousandths."""
    all_corpus, all_target = sum(corpus) + BUCKETS, sum(target) + BUCKETS
    ratios = (float(t + 1) * float(all_corpus) / (float(s + 1) * float(all_target)) for s, t in zip(corpus, target, strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], dtype=np.int64)


def noise(doc_id: object, seed: int) -> int:
    """Gumbel noise in thousandths from 32 bits of a hash."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score_task(gain: np.ndarray, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, doc_id in zip(_texts(batch), batch.column("doc_id").to_pylist(), strict=True):
                words = n = weight = 0
                for new, found in features(text):
                    words, n, weight = words + new, n + len(found), weight + int(gain[found].sum())
                rows.append((n, weight, weight + noise(doc_id, seed), words))
            kept = [i for i, name in enumerate(batch.schema.names) if name != "text"]
            yield pa.record_batch(
                [batch.column(i) for i in kept] + [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else ((),) * 4)],
                [batch.schema.names[i] for i in kept] + ["n_features", "weight", "score", "n_words"],
            )

    return task


def scored(docs: DataFrame, target: DataFrame, seed: int = 42) -> DataFrame:
    """The columns of ``docs(doc_id, text, ...)`` without text, with n_features, weight, score and n_words."""
    gain = gains(counts(docs), counts(target))
    own = docs.select(*others(docs, (*RESULTS, "doc_id"))).schema.fields
    # numbered names on the way through the tasks, since dots are not allowed there
    plain = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(own)]
    rows = docs.select("doc_id", *others(docs, (*RESULTS, "doc_id")), "text").toDF("doc_id", *(f.name for f in plain), "text")
    results = ("n_features", "weight", "score", "n_words")
    schema = T.StructType([docs.schema["doc_id"], *plain, *(T.StructField(c, T.LongType()) for c in results)])
    return rows.mapInArrow(_score_task(gain, seed), schema).toDF("doc_id", *(f.name for f in own), *results)


def kth(keys: DataFrame, n: int, k: int) -> tuple:
    """The k-th smallest (from 1) of ``keys``, ``n`` rows whose columns together are unique."""
    key = F.struct(*keys.columns)

    def literal(values: tuple) -> Column:
        return F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(values, keys.schema.fields, strict=True)))

    inside, below, rounds = keys, 0, 0
    while n > FEW:
        rounds += 1
        drawn = inside.orderBy(F.xxhash64(*keys.columns, F.lit(rounds))).limit(PIVOTS).select(key.alias("k")).orderBy("k").collect()
        pivots = [tuple(r.k) for r in drawn]
        points = F.array(*map(literal, pivots))
        # three ways against every pivot: 2 i is the interval before pivot i, 2 i + 1 the pivot itself
        part = 2 * F.size(F.filter(points, lambda p: p < key)) + F.exists(points, lambda p: p == key).cast("int")
        found = {r.part: r.n for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
        for place in range(2 * len(pivots) + 1):
            n = found.get(place, 0)
            if below + n >= k:
                break
            below += n
        if place % 2:
            return pivots[place // 2]
        low, high = place // 2 - 1, place // 2
        if low >= 0:
            inside = inside.where(key > literal(pivots[low]))
        if high < len(pivots):
            inside = inside.where(key < literal(pivots[high]))
    return tuple(inside.select(key.alias("k")).orderBy("k").collect()[k - below - 1].k)


def resampled(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42) -> DataFrame:
    """The columns of :func:`scored` with ``rank``: 1, 2, ... for the drawn documents, null for the others."""
    table = stored(scored(docs, target, seed).withColumn("row ", F.monotonically_increasing_id()).withColumn("down ", -F.col("score")))
    order = ["down ", "doc_id", "row "]
    fit = table.where(F.col("n_words") >= least_words)
    n = fit.count()
    k = share[0] * n // share[1]
    if not k:
        return table.drop("row ", "down ").withColumn("rank", F.lit(None).cast("long"))
    last = kth(fit.select(*order), n, k)
    bound = F.struct(*(F.lit(v).cast(fit.schema[c].dataType).alias(c) for c, v in zip(order, last, strict=True)))
    drawn = (F.col("n_words") >= least_words) & (F.struct(*order) <= bound)
    ranges = max(1, -(-k // RANKED_ROWS))
    winners = stored(table.where(drawn).repartitionByRange(ranges, *order).select("*", F.spark_partition_id().alias("range "), F.lit(1).cast("long").alias("one ")))
    ranked = running(winners.withColumn("all ", F.lit(0)), ["all "], "range ", order, "one ", "before ").withColumn("rank", F.col("before ") + 1)
    columns = [c for c in table.columns if c not in ("row ", "down ")]
    rest = table.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return rest.select(*others(rest, ["row ", "down "])).union(ranked.select(*others(table, ["row ", "down "]), "rank")).toDF(*columns, "rank")
