"""Exact top-k by inner product with MaxScore.

A query's components are its terms; a term's posting list in a shard is the shard's column for it.
Per query and shard, each term has a highest and a lowest contribution.  While the spreads of the
terms with the smallest spreads, together with all lowest contributions, cannot reach the k-th best
score so far, those terms are non-essential.  Essential lists are traversed block by block; only
vectors whose partial score plus the non-essential upper bounds is still competitive are probed for
the rest.  Blocks whose own bounds are too low are skipped.

Vectors are hashed into shards and queries into blocks, both of fixed size; each pair is one task, so
memory is bounded and no side is broadcast.  Each shard hands k rows per query to the merge.

Nulls and edge cases: vectors that are null or hold nulls, NaN or infinite components, and rows without
vec_id, take no part; missing trailing components count as zero; ties go to the smaller vec_id; a row
repeated under another query's eyes counts as often as it occurs; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.llm.common import stored

SHARD_ROWS, QUERY_ROWS, BLOCK = 32_768, 4_096, 512


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def search(ids: np.ndarray, vectors: np.ndarray, query_id: int, query: np.ndarray, k: int, bounds: tuple[np.ndarray, np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of one shard for one query.  ``bounds``: highest and lowest component of each block."""
    high, low = bounds
    top_of_block = np.where(query > 0, high * query, low * query)
    blocks = np.argsort(-top_of_block.sum(axis=1), kind="stable")
    best, worst = top_of_block.max(axis=0), np.where(query > 0, low * query, high * query).min(axis=0)
    spread = best - worst
    terms = np.argsort(spread, kind="stable")  # non-essential ones are a prefix of these
    reach = np.cumsum(spread[terms]) + worst.sum()
    rest = np.concatenate([[0], np.cumsum(best[terms])])
    found_ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
    least: int | None = None
    for b in blocks.tolist():
        if least is not None and top_of_block[b].sum() < least:
            break
        rows = slice(b * BLOCK, (b + 1) * BLOCK)
        block, own = vectors[rows], ids[rows]
        if least is None:
            scores = (block.astype(kind) @ query.astype(kind)).astype(np.int64)
            at = np.flatnonzero(own != query_id)
            scores = scores[at]
        else:
            idle = int(np.searchsorted(reach, least, "left"))  # terms that cannot make a vector competitive by themselves
            essential = terms[idle:]
            partial = (block[:, essential].astype(kind) @ query[essential].astype(kind)).astype(np.int64)
            at = np.flatnonzero((partial + rest[idle] >= least) & (own != query_id))
            if not len(at):
                continue
            other = terms[:idle]
            scores = partial[at] + (block[np.ix_(at, other)].astype(kind) @ query[other].astype(kind)).astype(np.int64)
        found_ids, found = np.concatenate([found_ids, own[at]]), np.concatenate([found, scores])
        order = np.lexsort((found_ids, -found))[:k]
        found_ids, found = found_ids[order], found[order]
        if len(found) == k:
            least = int(found[-1])
    return found_ids, found


def _shard_task(k: int) -> Callable:
    def task(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        names, kinds = ["query_id", "vec_id", "score"], [pa.int64()] * 3
        if not vectors.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names)
        width = max(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max()) for t in (vectors, queries))
        matrix, asked = _matrix(vectors["v"], width), _matrix(queries["v"], width)
        ids = vectors["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, matrix = ids[order], matrix[order]
        largest = int(np.abs(matrix).max(initial=0)) * int(np.abs(asked).max(initial=0)) * max(width, 1)
        kind = np.float64 if largest < 1 << 53 else np.int64  # products of integers, exact in either
        starts = np.arange(0, len(ids), BLOCK)
        bounds = np.maximum.reduceat(matrix, starts), np.minimum.reduceat(matrix, starts)
        out = [(q, *search(ids, matrix, int(q), v, k, bounds, kind)) for q, v in zip(queries["vec_id"].to_numpy(), asked, strict=True)]
        columns = [np.repeat([q for q, _, _ in out], [len(i) for _, i, _ in out]), np.concatenate([i for _, i, _ in out]), np.concatenate([s for _, _, s in out])]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], names)

    return task


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component of every valid vector."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale)).alias("v")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of ``vectors(vec_id, v)`` for each of ``queries(vec_id, v)``, itself left out."""
    vectors, queries = stored(vectors), stored(queries)
    shards = max(1, -(-vectors.count() // SHARD_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_ROWS))

    def spread(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        place = F.pmod(F.xxhash64("vec_id", F.lit(parts)), F.lit(parts).cast("long")).alias(own)
        return df.select("vec_id", "v", place, F.explode(F.expr(f"sequence(0L, {copies - 1}L)")).alias(other))

    left = spread(vectors, "shard", shards, "block", blocks).groupBy("shard", "block")
    right = spread(queries, "block", blocks, "shard", shards).select("vec_id", "v", "shard", "block").groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(_shard_task(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
