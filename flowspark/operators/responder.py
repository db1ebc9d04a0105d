"""A slot for whatever answers prompts: batched, bounded in its retries, and resumable.

Requests without an answer are found by an anti join on the stored answers and dealt into slices by a hash of their key.  Each
slice is one write: what is done stays done, and a run that was stopped goes on with the keys that are still open.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.kept_metrics import _exists
from flowspark.session import written

Responder = Callable[[list[str]], list[str]]


def answered(requests: DataFrame, path: str, key: str = "record_key") -> DataFrame:
    """All stored answers: (key, response, response_error, attempts, slice)."""
    schema = _schema(requests, key)
    if not _exists(requests.sparkSession, path):
        return requests.sparkSession.createDataFrame([], schema)
    return requests.sparkSession.read.schema(schema).parquet(path)


def _schema(requests: DataFrame, key: str) -> T.StructType:
    return T.StructType([requests.schema[key], *T.StructType.fromDDL("response string, response_error string, attempts int").fields])


def _ask(respond: Responder, key: str, batch_size: int, attempts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def call(prompts: list[str]) -> tuple[list[str | None], str | None, int]:
        problem = None
        for attempt in range(1, attempts + 1):
            try:
                answers = respond(prompts)
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
                return answers, None, attempt
            except Exception as failure:  # noqa: BLE001  whatever it is, it becomes the answer's error
                problem = f"{type(failure).__name__}: {failure}"
        return [None] * len(prompts), problem, attempts

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                answers, problem, used = call([p or "" for p in part.column("prompt").to_pylist()])
                n = part.num_rows
                yield pa.record_batch(
                    [part.column(key), pa.array(answers, pa.string()), pa.array([problem] * n, pa.string()), pa.array([used] * n, pa.int32())],
                    [key, "response", "response_error", "attempts"])

    return task


def answer(requests: DataFrame, path: str, respond: Responder, key: str = "record_key", batch_size: int = 32, attempts: int = 3,
           slices: int = 16, again: bool = False, only_slices: int | None = None) -> DataFrame:
    """Answer ``requests`` (key, prompt), whose keys are unique, and return all answers below ``path``.

    A call takes ``batch_size`` prompts and is tried ``attempts`` times; then its rows carry the error.  With ``again``, keys whose answer
    is an error are asked once more and their new answer counts.  ``only_slices`` stops after that many writes, for callers that work in portions.
    """
    have = answered(requests, path, key)
    done = have if not again else have.where("response_error IS NULL")
    open_ = written(requests.select(key, "prompt").join(done.select(key), key, "left_anti").withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices).cast("long")).cast("int")))
    numbers = sorted(r[0] for r in open_.select("_slice").distinct().collect())  # at most ``slices``
    schema = _schema(requests, key)
    for number in numbers[:only_slices]:
        rows = open_.where(F.col("_slice") == number).select(key, "prompt")
        rows.mapInArrow(_ask(respond, key, batch_size, attempts), schema).write.mode("append").parquet(path)
    return latest_answers(answered(requests, path, key), key)


def latest_answers(rows: DataFrame, key: str = "record_key") -> DataFrame:
    """One answer per key: a good one before an error."""
    good = rows.where("response_error IS NULL")
    bad = rows.where("response_error IS NOT NULL").dropDuplicates([key]).join(good.select(key), key, "left_anti")
    return good.unionByName(bad)
