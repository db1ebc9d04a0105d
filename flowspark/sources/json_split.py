"""Objects of the top-level arrays of large JSON documents, read by many tasks.

A document is cut into byte ranges.  Whether a range begins inside a string, and at which depth, only the bytes before it
tell.  So a first pass sums up each range for both cases: the parity of its unescaped quotes and how it changes the
depth if it begins outside or inside a string.  A prefix scan over these few numbers gives every range its true state;
in a second pass each range emits the objects that begin in it, reading on to the end of its last one.

Ranges begin after a byte that is no backslash, so no range begins with an escaped byte.  Documents are UTF-8; keys of the arrays
are spelled without escapes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.session import written
from flowspark.sources.raw_csv import listed, open_file

RANGE_BYTES = 4 << 20
AHEAD_BYTES = 1 << 16
LOOK_BACK = 1 << 12
QUOTE, BACKSLASH = ord('"'), ord("\\")
STEP = np.zeros(256, dtype=np.int64)
STEP[[ord("{"), ord("[")]] = 1
STEP[[ord("}"), ord("]")]] = -1
ROWS = "file int, start long, at long, kind string, segment int, place int, body string"


def settled(file: pa.NativeFile, at: int, size: int) -> int:
    """The first place from ``at`` on whose byte before is no backslash."""
    while 0 < at < size:
        before = file.read_at(min(AHEAD_BYTES, size - at + 1), at - 1)
        for i, byte in enumerate(before):
            if byte != BACKSLASH:
                return at + i
        at += len(before)
    return min(at, size)


def quotes(data: np.ndarray) -> np.ndarray:
    """Which bytes are quotes after an even number of backslashes."""
    found = data == QUOTE
    slashes = data == BACKSLASH
    if slashes.any():
        places = np.arange(len(data))
        last = np.maximum.accumulate(np.where(slashes, -1, places))  # the last byte up to here that is no backslash
        run = places[1:] - 1 - last[:-1]  # how many backslashes stand right before each byte
        found[1:] &= run % 2 == 0
    return found


def levels(data: np.ndarray, inside: bool, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(step, depth after) of every byte; bytes within strings step nowhere."""
    odd = np.cumsum(quotes(data)) % 2 == 1
    step = np.where(odd ^ inside, 0, STEP[data])
    return step, depth + np.cumsum(step)


def summary(data: np.ndarray) -> tuple[bool, int, int]:
    """(odd number of quotes, change of depth from outside a string, from inside one)."""
    odd = np.cumsum(quotes(data)) % 2 == 1
    step = STEP[data]
    return bool(odd[-1]) if len(odd) else False, int(step[~odd].sum()), int(step[odd].sum())


def _range_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            with open_file(r["uri"]) as file:
                start, end = settled(file, r["start"], r["size"]), settled(file, r["end"], r["size"])
                odd, outside, inside = summary(np.frombuffer(file.read_at(max(end - start, 0), start), np.uint8))
            yield pa.record_batch([pa.array([r["file"]], pa.int32()), *(pa.array([x]) for x in (r["start"], odd, outside, inside))], ["file", "start", "odd", "outside", "inside"])


def _is_key(before: bytes, key: bytes) -> bool:
    before = before.rstrip()
    return before.endswith(b":") and before[:-1].rstrip().endswith(b'"' + key + b'"')


def _object_task(key: bytes, depth_of_array: int = 1):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield from objects(r)

    def objects(r: dict) -> Iterator[pa.RecordBatch]:
        with open_file(r["uri"]) as file:
            start, end = settled(file, r["start"], r["size"]), settled(file, r["end"], r["size"])
            if start >= end:
                return
            data = np.frombuffer(file.read_at(end - start, start), np.uint8)
            step, after = levels(data, r["inside"], r["depth"])
            within = end - start
            inner = depth_of_array + 1
            opens = np.flatnonzero((step == 1) & (data == ord("{")) & (after == inner + 1))
            closes = np.flatnonzero((step == -1) & (data == ord("}")) & (after == inner))
            lists = np.flatnonzero((step != 0) & (((data == ord("[")) & (after == inner)) | ((data == ord("]")) & (after == inner - 1))))
            ahead = AHEAD_BYTES
            while len(opens) and not (closes > opens[-1]).any() and start + len(data) < r["size"]:  # the last object ends in a later range
                more = end - start + ahead
                data = np.frombuffer(file.read_at(min(more, r["size"] - start), start), np.uint8)
                step, after = levels(data, r["inside"], r["depth"])
                closes = np.flatnonzero((step == -1) & (data == ord("}")) & (after == inner))
                ahead *= 2
            out = []
            for at in lists.tolist():
                opening = data[at] == ord("[")
                back = min(LOOK_BACK, start + at)
                wanted = opening and _is_key(file.read_at(back, start + at - back), key)
                out.append((start + at, "wanted" if wanted else "other" if opening else "end", None, None, None))
            stops = closes[np.searchsorted(closes, opens, side="right").clip(max=max(len(closes) - 1, 0))] if len(closes) else opens
            # an object's place in its part of an array: parts begin with the range and with each array
            segments = np.searchsorted(lists[data[lists] == ord("[")], opens)
            places = np.arange(len(opens)) - np.searchsorted(segments, segments)
            for at, stop, segment, place in zip(opens.tolist(), stops.tolist(), segments.tolist(), places.tolist(), strict=True):
                if at < within and stop > at:  # an object that the document's end cuts off is none
                    out.append((start + at, "object", segment, place, data[at : stop + 1].tobytes().decode("utf-8", "replace")))
        for k in range(0, len(out), 1000):
            part = out[k : k + 1000]
            yield pa.record_batch(
                [pa.array([r["file"]] * len(part), pa.int32()), pa.array([r["start"]] * len(part), pa.int64()), pa.array([p[0] for p in part], pa.int64()),
                 pa.array([p[1] for p in part]), pa.array([p[2] for p in part], pa.int32()), pa.array([p[3] for p in part], pa.int32()),
                 pa.array([p[4] for p in part], pa.string())], ["file", "start", "at", "kind", "segment", "place", "body"])

    return task


def array_objects(spark: SparkSession, pattern: str, key: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, position, body): the objects of the array under ``key`` of each document, as texts, in their order.

    Elements that are no objects are left out and not counted.
    """
    files = listed(spark, pattern)
    if not files:
        raise FileNotFoundError(f"no file matches {pattern}")
    cuts = [(i, uri, size, a, min(a + range_bytes, size)) for i, (uri, size) in enumerate(files) for a in range(0, size, range_bytes)]
    schema = "file int, uri string, size long, start long, `end` long"
    first = spark.createDataFrame(cuts, schema).repartition(max(len(cuts), 1))
    sums = first.mapInArrow(_range_task, "file int, start long, odd boolean, outside long, inside long").collect()  # five numbers per range
    sums.sort(key=lambda r: (r.file, r.start))  # here, as a distributed sort would run the pass twice
    states, now = [], (-1, False, 0)
    for cut, s in zip(cuts, sums, strict=True):
        if s.file != now[0]:
            now = (s.file, False, 0)
        states.append((*cut, now[1], now[2]))
        now = (s.file, now[1] ^ s.odd, now[2] + (s.inside if now[1] else s.outside))
    second = spark.createDataFrame(states, f"{schema}, inside boolean, depth int").repartition(max(len(cuts), 1))
    found = written(second.mapInArrow(_object_task(key.encode()), ROWS))
    bounds: list[tuple[int, int, int]] = []  # the wanted arrays: a row per array at the top level of a document
    for row in found.where("kind <> 'object'").orderBy("file", "at").select("file", "at", "kind").collect():
        if row["kind"] == "wanted":
            bounds.append((row["file"], row["at"], 1 << 62))
        elif row["kind"] == "end" and bounds and bounds[-1][0] == row["file"] and bounds[-1][2] == 1 << 62:
            bounds[-1] = (*bounds[-1][:2], row["at"])
    arrays = F.array(*[F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(b, ("file", "low", "high"), strict=True)]) for b in bounds]) if bounds else None
    inside = F.exists(arrays, lambda b: (b["file"] == F.col("file")) & (F.col("at") > b["low"]) & (F.col("at") < b["high"])) if bounds else F.lit(False)
    kept = found.where((F.col("kind") == "object") & inside)
    counts = kept.groupBy("file", "start", "segment").agg(F.count("*").alias("n"))
    order = Window.partitionBy("file").orderBy("start", "segment")
    before = counts.select("file", "start", "segment", (F.sum("n").over(order) - F.col("n")).alias("before"))
    # a row per range and array, of which the driver has listed more above; so no object is shuffled
    placed = kept.join(F.broadcast(before), ["file", "start", "segment"])
    return placed.select("file", (F.col("before") + F.col("place")).cast("int").alias("position"), "body")
