"""Quality rules: surface counts of each whole text, and a hashed n-gram log-likelihood ratio.

The ratio compares two multinomials over ``BUCKETS`` hashed unigrams and bigrams: one of trusted
documents, one of the whole raw corpus.  A document's score is its mean log ratio per n-gram; it
is kept if no base rule fails and the score reaches the threshold.

* Trusted documents come from at most ``sample`` labelled rows (the smallest hashes of doc_id), so
  the side that is broadcast has a fixed size.  Half of them fit the multinomial; all other labelled
  rows, however many, place the threshold, by counts per range of scores.
* Counts of the raw corpus cover all documents.  Each task adds its counts up before the shuffle,
  so a task sends ``BUCKETS`` rows at most, and the model is one fixed-size array.

Nulls: a null text has no words and fails; a null doc_id is passed on.  A document whose labels
disagree is not trusted.  Without trusted rows the ratio is zero everywhere and only the base rules
decide.  Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import IS_WORD, Rolling, Slice, frugal, longs, mixed, repeated, slices, stored

BUCKETS = 1 << 14
SAMPLE = 20_000
KEEP = 0.999
MIN_WORDS, MAX_REPEAT = 20, 30

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CODE_POINT = IS_WORD & ((np.arange(256) & 0xC0) != 0x80)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _surface(part: Slice, words, hashes: Rolling, word_hashes: np.ndarray) -> dict[str, np.ndarray]:
    breaks = np.flatnonzero(part.data == 10)
    inner = breaks[breaks < len(part.data)]
    line_starts = np.union1d(part.starts[part.starts < part.ends], inner + 1)
    line_starts = line_starts[line_starts < len(part.data)]
    row = np.searchsorted(part.starts, line_starts, "right") - 1
    line_starts, row = line_starts[part.ends[row] > line_starts], row[part.ends[row] > line_starts]
    nearest = np.searchsorted(inner, line_starts)
    stops = np.append(inner, len(part.data))[nearest]
    line_ends = np.minimum(stops, part.ends[row])
    filled = np.searchsorted(words.starts, line_ends) > np.searchsorted(words.starts, line_starts)
    row, line_starts, line_ends = row[filled], line_starts[filled], line_ends[filled]
    _, later = repeated(row, hashes.ranges(line_starts, line_ends))

    rows, first = words.windows(8)
    often, _ = repeated(rows, Rolling.of(word_hashes).ranges(first, first + 8))
    edge = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.add.at(edge, first[often], 1)
    np.add.at(edge, first[often] + 8, -1)
    covered = np.zeros(len(words.starts) + 1, dtype=np.int64)
    np.cumsum(np.cumsum(edge[:-1]) > 0, out=covered[1:])
    return {
        "n_words": words.counts,
        "word_chars": part.per_row(_CODE_POINT[part.data]),
        "n_symbols": part.per_row(_SYMBOL[part.data]),
        "n_dup_lines": np.bincount(row[later], minlength=part.rows),
        "n_repeat_words": covered[words.last] - covered[words.first],
    }


def _grams(words, word_hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each unigram and bigram."""
    rows, first = words.windows(1)
    pair_rows, pair_first = words.windows(2)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    pairs = mixed(word_hashes[pair_first] * np.uint64(3) + word_hashes[pair_first + 1] * np.uint64(5), 2)
    return np.concatenate([rows, pair_rows]), np.concatenate([word_hashes[first], pairs]).astype(np.uint64) >> shift


def _hashed(part: Slice):
    words = part.words()
    hashes = Rolling.of_bytes(part.data)
    return words, hashes, mixed(hashes.ranges(words.starts, words.ends), 1)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        chosen = np.asarray(batch["fit"].fill_null(False))
        for part in slices(batch["text"]):
            words, _, word_hashes = _hashed(part)
            rows, buckets = _grams(words, word_hashes)
            raw += np.bincount(buckets.astype(np.int64), minlength=BUCKETS)
            trusted += np.bincount(buckets[chosen[part.first : part.last][rows]].astype(np.int64), minlength=BUCKETS)
    seen = np.flatnonzero(raw)
    yield pa.record_batch([longs(seen), longs(raw[seen]), longs(trusted[seen])], ["bucket", "raw", "trusted"])


def _score_task(ratio: np.ndarray, text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [c for c in batch.schema.names if text or c != "text"]
            for part in slices(batch["text"]):
                words, hashes, word_hashes = _hashed(part)
                rows, buckets = _grams(words, word_hashes)
                total = np.bincount(rows, ratio[buckets.astype(np.int64)], minlength=part.rows)
                n = np.bincount(rows, minlength=part.rows)
                columns = {c: batch[c].slice(part.first, part.rows) for c in kept}
                columns |= {c: longs(v) for c, v in _surface(part, words, hashes, word_hashes).items()}
                columns["score"] = pa.array(np.round(total / np.maximum(n, 1), 9))
                yield pa.record_batch(list(columns.values()), list(columns))

    return task


def _labelled(labels: DataFrame, sample: int | None = None) -> DataFrame:
    """Rows (doc_id, good, fit): all, or those of at most ``sample`` rows, the smallest hashes of doc_id first."""
    rows = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    order = F.xxhash64("doc_id")
    return (
        (rows if sample is None else rows.orderBy(order, "doc_id", "quality").limit(sample)).groupBy("doc_id")
        .agg(F.min("quality").alias("low"), F.max("quality").alias("high")).where("low = high")
        .select("doc_id", (F.col("low") == 1).alias("good"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).alias("fit"))
    )


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The log ratio of each bucket, trusted against raw, from counts over all documents."""
    labelled = F.broadcast(_labelled(labels, sample).where("good AND fit").select("doc_id", "fit"))
    counts = (
        docs.select("doc_id", "text").join(labelled, "doc_id", "left").select("text", "fit")
        .mapInArrow(frugal(_count_task), "bucket long, raw long, trusted long").groupBy("bucket").agg(F.sum("raw"), F.sum("trusted")).collect()
    )
    raw, trusted = np.ones(BUCKETS), np.ones(BUCKETS)
    for bucket, r, t in counts:
        raw[bucket] += r
        trusted[bucket] += t
    if trusted.sum() == BUCKETS:
        return np.zeros(BUCKETS)
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())


def threshold(docs: DataFrame, labels: DataFrame, ratio: np.ndarray, sample: int = SAMPLE, keep: float = KEEP) -> float:
    """The score that the share ``keep`` of the good labelled rows outside the fit reaches, or the middle of the gap to the bad ones.

    All labelled rows outside the fit are scored; only counts per range of scores are collected.
    """
    fit = F.broadcast(_labelled(labels, sample).where("good AND fit").select("doc_id"))
    held = _labelled(labels).select("doc_id", "good").join(fit, "doc_id", "left_anti")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double"
    scores = docs.select("doc_id", "text").mapInArrow(frugal(_score_task(ratio, False)), schema).where(~base_failed()).select("doc_id", "score")
    rows = stored(scores.join(held, "doc_id").select("good", "score"))
    good = rows.where("good").withColumn("key", F.round(F.col("score") * 1e9).cast("long"))
    n = good.count()
    if not n:
        return float("-inf")
    rank = min(int((1 - keep) * n), n - 1)
    # scores have nine decimals: three at a time
    for unit in (10**6, 10**3, 1):
        part = F.expr(f"key div {unit}")
        for found, count in sorted(good.groupBy(part).count().collect()):
            if rank < count:
                break
            rank -= count
        good = good.where(part == found)
    floor = good.agg(F.min("score")).first()[0]
    below = rows.where(~F.col("good") & (F.col("score") < floor)).agg(F.max("score")).first()[0]
    return floor if below is None else (floor + below) / 2


def base_failed() -> F.Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, text: bool = True, sample: int = SAMPLE, keep: float = KEEP) -> DataFrame:
    """Per document: the columns of ``docs`` (``text`` only if asked for), its counts, score, base_failed and kept.

    Columns of ``docs`` that bear the name of a result are replaced.
    """
    ratio = fitted(docs, labels, sample)
    cut = threshold(docs, labels, ratio, sample, keep)
    source = docs.select(*(c for c in docs.columns if c not in (*COUNTS, "score", "base_failed", "kept")))
    fields = [f for f in source.schema.fields if text or f.name != "text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{c} long" for c in COUNTS), "score double"])
    scored = source.mapInArrow(frugal(_score_task(ratio, text)), schema)
    failed = base_failed()
    return scored.withColumns({"base_failed": failed, "kept": ~failed & (F.col("score") >= F.lit(cut))})
