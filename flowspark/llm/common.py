"""Shared helpers of the text operators: table reading, byte-level words and vectorised rolling hashes.

Everything works on slices of an Arrow string column: the UTF-8 bytes of some whole documents and
their bounds.  A null text is an empty one.  No document is ever cut.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
ROWS_A_TASK, FEW_TASKS = 1 << 15, 8
WORD = r"[^\x20\x09-\x0D]+"

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_path(spark: SparkSession) -> str:
    """A new path in the cluster's shared folder; a session without one (as in tests) gets a folder in its warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need: its operators run in few tasks instead of many empty ones.

    Partitions are merged and nothing is shuffled; where there are fewer already, nothing changes.
    """
    return df.coalesce(max(FEW_TASKS, -(-rows // ROWS_A_TASK)))


def frugal(task: Callable) -> Callable:
    """``task`` that gives its memory back to the system when it ends, since workers stay for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def mixed(values: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-mixed copy of 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    x += np.uint64((salt * 0xD1342543DE82EF95 + 0x632BE59BD9B4E019) % (1 << 64))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LETTER = mixed(np.arange(256, dtype=np.uint64), 7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        size = max(n, SLICE_BYTES + 1)
        steps = np.full(size, _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


@dataclass
class Rolling:
    """Hashes of any range of a sequence, from sums of weighted values."""

    sums: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> Rolling:
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _power("up", len(values)), out=sums[1:], dtype=np.uint64)
        return cls(sums)

    @classmethod
    def of_bytes(cls, data: np.ndarray) -> Rolling:
        return cls.of(_LETTER[data])

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Unmixed hash of every [start, end)."""
        return (self.sums[ends] - self.sums[starts]) * _power("down", len(self.sums))[starts]


@dataclass
class Slice:
    """The bytes of rows [first, last) of a batch and each row's bounds."""

    first: int
    last: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """How many flagged bytes each row has."""
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.ends] - sums[self.starts]

    def words(self) -> Words:
        inside = IS_WORD[self.data]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        before[self.starts[self.starts < len(inside)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[self.ends[self.ends > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return Words(starts, ends, np.searchsorted(starts, self.starts), np.searchsorted(starts, self.ends))


@dataclass
class Words:
    """Word bounds of a slice; row i has words [first[i], last[i])."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return self.last - self.first

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Row and first word of each run of ``size`` words within a row."""
        n = np.maximum(self.counts - size + 1, 0)
        rows = np.repeat(np.arange(len(n)), n)
        return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first, n)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Whole rows in slices of about ``limit`` bytes; a longer row is a slice of its own."""
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        base = offsets[first]
        yield Slice(first, last, data[base : offsets[last]], offsets[first:last] - base, offsets[first + 1 : last + 1] - base)
        first = last


def repeated(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For (row, key) items: is the pair found more than once; is it not the first of its kind."""
    own = mixed(keys ^ mixed(rows.astype(np.uint64), 3), 5)
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = np.zeros(len(own), dtype=bool)
    same[1:] = ranked[1:] == ranked[:-1]
    both = same.copy()
    both[:-1] |= same[1:]
    often, later = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
    often[order], later[order] = both, same
    return often, later


def longs(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).astype(np.uint64, copy=False).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
