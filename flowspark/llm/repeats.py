"""Removal of repeated passages: every byte covered by a string of ``size`` bytes that also starts elsewhere.

A repeated string has equal anchors at equal places: anchors are the leftmost minima of hashed k-grams
over all windows of ``size`` bytes, so each such window holds at least one, chosen by its content alone.

* Anchors with a unique k-gram drop out by a combining count.  The others carry a hash of their whole
  context (``size`` bytes to either side of the k-gram).  Equal contexts cover each other entirely,
  whatever their number, and are one class.
* Only classes with different contexts around the same k-gram are compared byte by byte: the suffixes
  at their anchors are sorted by deep-shallow sorting, equal prefixes of neighbours form the
  intervals of the suffix order.  The reversed left contexts are sorted once, and in each interval the
  neighbours in that order give the longest match on both sides.  Matches of ``size`` bytes or more are the coverage.
* Coverage comes back to documents by the keys of classes; no document's text meets another's.

A class's task holds the distinct contexts of one k-gram (at most 2 * ``size`` bytes each).

Nulls and edge cases: a null text is empty; a text shorter than ``size`` keeps everything; rows are told apart by a hash of
doc_id and text, so rows with one doc_id and other texts, and rows without doc_id, are sources of matches and get their own
results; repeated rows (same doc_id and text) are copies of each other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.llm.common import Rolling, longs, mixed, slices, stored
from flowspark.llm.suffix_sort import common_prefixes, suffix_order

SIZE, GRAM = 200, 64
_LOW = np.uint64(0xFFFFFFFF)


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of ``width``: prefix and suffix minima of blocks."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _anchors(part, size: int, gram: int):
    """Row, position in the row, k-gram hash, context hash, left and right length of each anchor."""
    n = len(part.data)
    if n < size:
        return None
    hashes = Rolling.of_bytes(part.data)
    at = np.arange(n - gram + 1)
    grams = mixed(hashes.ranges(at, at + gram), 31)
    least = _window_minima((grams & ~_LOW) | at.astype(np.uint64), size - gram + 1)[: n - size + 1]
    row = np.searchsorted(part.starts, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + size <= part.ends[row]
    found = np.unique((least[inside] & _LOW).astype(np.int64))
    row = np.searchsorted(part.starts, found, "right") - 1
    left = np.minimum(found - part.starts[row], size - gram)
    right = np.minimum(part.ends[row] - found, size)
    context = mixed(hashes.ranges(found - left, found + right) + mixed((left * 1024 + right).astype(np.uint64), 33), 32)
    return row, found - part.starts[row], grams[found], context, left, right


def _anchor_task(size: int, gram: int) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch["text"]):
                if (found := _anchors(part, size, gram)) is not None:
                    row, at, grams, context, left, right = found
                    yield pa.record_batch(
                        [batch["key"].take(pa.array(row + part.first)), pa.array(at.astype(np.int32)), longs(grams), longs(context),
                         pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))],
                        ["key", "at", "gram", "context", "l", "r"],
                    )

    return task


def _context_task(size: int, gram: int) -> Callable:
    """The bytes around each wanted position, left part reversed, padded to whole rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"].to_pylist(), strict=True):
                data = text.as_buffer()
                view = memoryview(data)
                for w in wanted:
                    at, l, r = w["at"], w["l"], w["r"]
                    out.append((w["gram"], w["context"], bytes(view[at - l : at])[::-1], bytes(view[at : at + r])))
            grams, contexts, lefts, rights = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.record_batch(
                [pa.array(grams, pa.int64()), pa.array(contexts, pa.int64()), pa.array(lefts, pa.binary()), pa.array(rights, pa.binary())],
                ["gram", "context", "before", "after"],
            )

    return task


def _block(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    width = -(-width // 8) * 8
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    lengths = np.diff(offsets)
    block = np.zeros((len(texts), width), np.uint8)
    mask = np.arange(width) < lengths[:, None]
    block[mask] = data[offsets[0] : offsets[-1]]
    return block, lengths


def _intervals(prefix: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, last, depth) of every maximal run in suffix order whose common prefix is ``depth`` >= ``least``."""
    out, stack = [], []
    for i, p in enumerate([*prefix.tolist(), -1]):
        start = i - 1
        while stack and stack[-1][1] > p:
            first, depth = stack.pop()
            out.append((first, i, depth))
            start = first
        if p >= least and (not stack or stack[-1][1] < p):
            stack.append((start, p))
    return out


def _least_of(values: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """least(a, b): the least of values[a + 1 .. b] for places a < b, from minima over powers of two."""
    levels = [values.astype(np.int16)]
    while 2 << (len(levels) - 1) <= len(values):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    starts = np.cumsum([0, *map(len, levels[:-1])])
    table = np.concatenate(levels)

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.minimum(a, b) + 1, np.maximum(a, b)  # of rows of two groups the answer is not used
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        return np.minimum(table[starts[level] + a], table[starts[level] + b - (1 << level) + 1]).astype(np.int64)

    return least


def matches(grams: np.ndarray, before: tuple, after: tuple, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest match to the left and right of each row with any other row of its k-gram, where both together reach ``size``."""
    (left, left_length), (right, right_length) = before, after
    order = suffix_order(grams, right, right_length)
    prefix = common_prefixes(grams, right, right_length, order)
    best_left, best_right = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    found = _intervals(prefix, gram)
    # left contexts are sorted once; the common length of any two is the least one between them in that order
    left_order = suffix_order(grams, left, left_length)
    least = _least_of(common_prefixes(grams, left, left_length, left_order))
    rank = np.empty(len(grams), np.int64)
    rank[left_order] = np.arange(len(grams))
    by_depth: dict[int, list[tuple[int, int]]] = {}
    for first, last, depth in found:
        by_depth.setdefault(depth, []).append((first, last))
    for depth, runs in by_depth.items():
        rows = np.concatenate([order[a:b] for a, b in runs])
        group = np.repeat(np.arange(len(runs)), [b - a for a, b in runs])
        # only rows whose left context is long enough can reach the size
        need = size - depth
        chosen = left_length[rows] >= need
        rows, group = rows[chosen], group[chosen]
        if len(rows) < 2:
            continue
        inner = np.argsort(group * len(grams) + rank[rows])
        rows, group = rows[inner], group[inner]
        longest = np.zeros(len(rows), np.int64)
        longest[1:] = np.where(group[1:] == group[:-1], least(rank[rows[:-1]], rank[rows[1:]]), 0)
        longest[:-1] = np.maximum(longest[:-1], longest[1:])
        hit = longest >= need
        best_left[rows[hit]] = np.maximum(best_left[rows[hit]], longest[hit])
        best_right[rows[hit]] = np.maximum(best_right[rows[hit]], depth)
    return best_left, best_right


def _match_task(size: int, gram: int) -> Callable:
    """Rows come sorted by k-gram; whole groups are matched in chunks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            grams = rows["gram"].to_numpy().view(np.uint64)
            sides = [_block(rows[c].combine_chunks() if rows[c].num_chunks != 1 else rows[c].chunk(0), size) for c in ("before", "after")]
            left, right = matches(grams, *sides, size, gram)
            hit = right > 0
            return pa.record_batch(
                [pa.array(grams[hit].view(np.int64)), pa.array(rows["context"].to_numpy()[hit]), pa.array(left[hit].astype(np.int16)), pa.array(right[hit].astype(np.int16))],
                ["gram", "context", "l", "r"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < 20_000:
                continue
            rows = pa.Table.from_batches(held)
            grams = rows["gram"].to_numpy()
            cut = int(np.searchsorted(grams, grams[-1]))
            if cut:
                yield flush(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    return task


def _keep_task(spans: bool) -> Callable:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch["doc_id"].to_pylist(), batch["text"], batch["spans"].to_pylist(), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                runs: list[list[int]] = []
                for s in sorted((s["start"], s["end"]) for s in found or ()):
                    if runs and s[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s[1])
                    else:
                        runs.append(list(s))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), [x for r in runs for x in r] if spans else None))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return task


def row_key() -> Column:
    """Tells rows apart; rows that share it are equal, and so are their results."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key")


def coverage(docs: DataFrame, size: int = SIZE, gram: int = GRAM) -> DataFrame:
    """(key, start, end): byte ranges whose union is what is removed; ``key`` is that of :func:`row_key`."""
    texts = docs.where("text IS NOT NULL").select(row_key(), "text")
    anchors = texts.where(F.octet_length("text") >= size).mapInArrow(_anchor_task(size, gram), "key long, at int, gram long, context long, l short, r short")
    kinds = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("context").alias("x"), F.max("context").alias("y")).where("n > 1").select("gram", (F.col("x") == F.col("y")).alias("single"))
    again = stored(anchors.join(kinds, "gram"))
    several = again.where("NOT single")
    classes = several.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("key", "at", "l", "r")).alias("one"))
    wanted = classes.groupBy(F.col("one.key").alias("key")).agg(F.collect_list(F.struct("one.at", "one.l", "one.r", "gram", "context")).alias("wanted"))
    contexts = (
        texts.join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted")).select("text", "wanted")
        .mapInArrow(_context_task(size, gram), "gram long, context long, before binary, after binary")
    )
    matched = contexts.repartition("gram").sortWithinPartitions("gram").mapInArrow(_match_task(size, gram), "gram long, context long, l short, r short")
    equal = classes.where("n > 1").select("gram", "context", F.col("one.l").alias("l"), F.col("one.r").alias("r")).where(F.expr(f"l + r >= {size}"))
    reach = matched.union(equal).groupBy("gram", "context").agg(F.max("l").alias("ml"), F.max("r").alias("mr"))
    spans = again.where(f"single AND l + r >= {size}").select("key", F.expr("at - l").alias("start"), F.expr("at + r").alias("end"))
    return spans.union(several.join(reach, ["gram", "context"]).select("key", F.expr("at - ml").alias("start"), F.expr("at + mr").alias("end")))


def cleaned(docs: DataFrame, size: int = SIZE, gram: int = GRAM, spans: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed ranges if asked for."""
    found = coverage(docs, size, gram).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key()).join(found, "key", "left").drop("key").mapInArrow(
        _keep_task(spans), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>"
    )
