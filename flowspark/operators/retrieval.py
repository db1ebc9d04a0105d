"""Vector retrieval: exact top-k, rescoring, context gate and context packing."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark import domains as D
from flowspark.operators.bounded import small_side
from flowspark.session import written

BLOCK_ROWS = 16_384
HELD_BYTES = 32 << 20
FOLD_CELLS = 1 << 18  # distances that a task holds at once


def pairing(documents: DataFrame, embeddings: DataFrame, key: str = "id") -> DataFrame:
    """Documents next to their vectors; ``pairing`` tells pairs from rows that only one side has, and none is lost."""
    state = F.when(F.col("embedding").isNull(), "no vector").when(F.col("text").isNull(), "no document").otherwise("paired")
    return documents.join(embeddings, key, "full_outer").withColumn("pairing", state)


def zip_embeddings(documents: DataFrame, embeddings: DataFrame, key: str = "id") -> DataFrame:
    """Documents with their vectors.  A document without a vector, or the reverse, is an error."""
    problem = F.raise_error(F.concat(F.lit("document and vector do not pair: "), F.col(key).cast("string")))
    complete = F.when(F.col("pairing") == "paired", True).otherwise(problem)
    return pairing(documents, embeddings, key).filter(complete).drop("pairing")


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", corpus_id: str = "id",
            query_vector: str = "query_embedding", vector: str = "embedding", block_rows: int = BLOCK_ROWS,
            held_bytes: int = HELD_BYTES) -> DataFrame:
    """Exact k nearest corpus rows of every query by cosine distance, ties by id.

    A side whose vectors take at most ``held_bytes``, by a count, is sent to every task and the
    other side is folded where it lies: no vector is shuffled, only the k best per query and task.

    Of two larger sides both are hashed into blocks of about ``block_rows`` rows.  Each pair of blocks is one
    group: one matrix product that emits only the k best of each query.  No row pair is ever
    materialised, no side has to fit anywhere whole, and the hashing leaves no hot group.  A side
    is copied once per block of the other side; larger blocks trade task memory for less shuffling.
    Both ways give the same hits.
    """
    schema = T.StructType([
        T.StructField(query_id, queries.schema[query_id].dataType),
        T.StructField(corpus_id, corpus.schema[corpus_id].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
    asked = queries.select(F.col(query_id).alias("_id"), F.col(query_vector).alias("_v"))
    known = corpus.select(F.col(corpus_id).alias("_id"), F.col(vector).alias("_v"))
    if (held := _held(asked, held_bytes)) is not None:
        found = known.mapInPandas(_fold_corpus(held, k, query_id, corpus_id), schema)
        return rank_hits(found, query_id, corpus_id, "distance", k)
    if (held := _held(known, held_bytes)) is not None:
        found = asked.mapInPandas(_fold_queries(held, k, query_id, corpus_id), schema)
        return rank_hits(found, query_id, corpus_id, "distance", k)

    query_blocks = max(1, math.ceil(queries.count() / block_rows))
    corpus_blocks = max(1, math.ceil(corpus.count() / block_rows))

    def spread(df: DataFrame, key: str, value: str, own: str, own_blocks: int, other: str, other_blocks: int) -> DataFrame:
        return df.select(
            F.col(key).alias("_id"), F.col(value).alias("_v"),
            F.pmod(F.xxhash64(key), F.lit(own_blocks)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(other_blocks - 1))).alias(other),
        )

    left = spread(queries, query_id, query_vector, "_qb", query_blocks, "_cb", corpus_blocks)
    right = spread(corpus, corpus_id, vector, "_cb", corpus_blocks, "_qb", query_blocks)

    def best(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        return _block_nearest(q, c, k, query_id, corpus_id)

    found = left.groupBy("_qb", "_cb").cogroup(right.groupBy("_qb", "_cb")).applyInPandas(best, schema)
    return rank_hits(found, query_id, corpus_id, "distance", k)


def _held(side: DataFrame, held_bytes: int) -> pd.DataFrame | None:
    """The rows (_id, _v) of a side whose vectors fit into ``held_bytes``; the size is counted before any row is fetched."""
    size = side.agg(F.count("*").alias("rows"), F.max(F.size("_v")).alias("width")).first()
    if size["rows"] * (8 * (size["width"] or 0) + 64) > held_bytes:
        return None
    return side.toPandas()


def _fold_corpus(held: pd.DataFrame, k: int, query_id: str, corpus_id: str):
    """Per task: the k best of its corpus rows for every held query."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        rows = max(k, FOLD_CELLS // max(1, len(held)))
        for batch in (whole[start:start + rows] for whole in batches for start in range(0, len(whole), rows)):
            found = _block_nearest(held, batch, k, query_id, corpus_id)
            if best is not None:
                both = pd.concat([best, found], ignore_index=True).sort_values(["distance", corpus_id], kind="stable")
                found = both.groupby(query_id, sort=False).head(k)
            best = found
        if best is not None:
            yield best

    return fold


def _fold_queries(held: pd.DataFrame, k: int, query_id: str, corpus_id: str):
    """Per task: the k best of the held corpus for its queries."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield _block_nearest(batch, held, k, query_id, corpus_id)

    return fold


def _block_nearest(q: pd.DataFrame, c: pd.DataFrame, k: int, query_id: str, corpus_id: str) -> pd.DataFrame:
    import numpy as np

    if q.empty or c.empty:
        return pd.DataFrame({query_id: q["_id"][:0], corpus_id: c["_id"][:0], "distance": []})
    c = c.sort_values("_id", kind="stable")
    ids = c["_id"].to_numpy()
    b = np.stack(c["_v"].to_numpy()).astype(float)
    b = b / _lengths(b)
    parts = []
    step = max(1, 4_000_000 // max(1, len(ids)))
    for start in range(0, len(q), step):
        chunk = q.iloc[start:start + step]
        a = np.stack(chunk["_v"].to_numpy()).astype(float)
        a = a / _lengths(a)
        # rounding makes equal vectors equal, so that ties fall back to the id order
        distance = np.round(np.maximum(0.0, 1.0 - a @ b.T), 12)
        if k < len(ids):
            limit = np.partition(distance, k - 1, axis=1)[:, k - 1]
            rows, cols = np.nonzero(distance <= limit[:, None])
        else:
            rows, cols = np.nonzero(np.ones_like(distance, dtype=bool))
        d = distance[rows, cols]
        order = np.lexsort((cols, d, rows))
        rows, cols, d = rows[order], cols[order], d[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = place < k
        parts.append(pd.DataFrame({
            query_id: chunk["_id"].to_numpy()[rows[keep]], corpus_id: ids[cols[keep]], "distance": d[keep]}))
    return pd.concat(parts, ignore_index=True)


def _lengths(rows):
    import numpy as np

    lengths = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(lengths > 0, lengths, 1.0)


def rank_hits(hits: DataFrame, query_id: str, corpus_id: str, order: str, k: int, rank: str = "rank") -> DataFrame:
    """The k best hits of every query, numbered from 1, ties by id."""
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(order, corpus_id))
    return hits.withColumn(rank, place).filter(F.col(rank) <= k)


def with_source(corpus: DataFrame, source: str | None) -> DataFrame:
    """Metadata equality filter, applied before the search so that it reaches the scan."""
    return corpus if source is None else corpus.filter(F.col("source") == source)


def score_distance(score: Column) -> Column:
    """Rescoring score as a distance: 1 - sigmoid."""
    return 1.0 - 1.0 / (1.0 + F.exp(-score))


PairScorer = Callable[[DataFrame], DataFrame]


def retrieve(queries: DataFrame, corpus: DataFrame, top_k: int = 5, scorer: PairScorer | None = None, pool: int = 20,
             source: str | None = None, query_id: str = "query_id", corpus_id: str = "id") -> DataFrame:
    """Dense top-k; with a scorer, a dense pool is rescored and cut to ``top_k``.

    ``scorer`` takes the pool (query_id, id, distance, rank) and adds ``score``.  A query with a
    single hit keeps its dense distance, and a pair without a score keeps it too.
    """
    dense = nearest(queries, with_source(corpus, source), pool if scorer else top_k, query_id, corpus_id)
    if scorer is None:
        return dense.withColumns({"dense_distance": F.col("distance"), "score": F.lit(None).cast("double")})
    dense = written(dense)  # the scorer reads the pool several times
    scored = scorer(dense)
    hits = F.count("*").over(Window.partitionBy(query_id))
    rescored = scored.withColumn("_hits", hits).select(
        query_id, corpus_id, F.col("distance").alias("dense_distance"),
        F.when(F.col("_hits") > 1, F.col("score")).alias("score"),
        F.when((F.col("_hits") > 1) & F.col("score").isNotNull(), score_distance(F.col("score")))
        .otherwise(F.col("distance")).alias("_d"),
    ).withColumn("distance", F.round("_d", 12)).drop("_d")
    return rank_hits(rescored, query_id, corpus_id, "distance", top_k)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def bm25_scorer(queries: DataFrame, corpus: DataFrame, query_id: str = "query_id", corpus_id: str = "id",
                query_text: str = "query_text", text: str = "text", k1: float = 1.2, b: float = 0.75) -> PairScorer:
    """Lexical pair scorer over whole texts.

    Words that no query asks for are dropped before anything is shuffled.  Term counts are joined
    on (document, term), a key without hot spots; document frequencies cover the whole corpus and
    have one row per word asked for, so they are broadcast if the size check passes.
    """

    def score(pool: DataFrame) -> DataFrame:
        query_terms = queries.select(query_id, F.explode(F.array_distinct(words(F.col(query_text)))).alias("term"))
        used = small_side(query_terms.select("term").distinct())
        occurrences = corpus.select(corpus_id, F.explode(words(F.col(text))).alias("term")).join(used, "term", "left_semi")
        counted = occurrences.groupBy(corpus_id, "term").agg(F.count("*").alias("tf"))
        frequency = small_side(counted.groupBy("term").agg(F.count("*").alias("df")))
        every_length = corpus.select(corpus_id, F.size(words(F.col(text))).alias("length"))
        size = every_length.agg(F.count("*").alias("docs"), F.avg("length").alias("mean_length")).first()
        lengths = every_length.join(small_side(pool.select(corpus_id).distinct()), corpus_id, "left_semi")
        pairs = pool.select(query_id, corpus_id).join(query_terms, query_id)
        idf = F.log(1.0 + (F.lit(size["docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        norm = k1 * (1 - b + b * F.col("length") / F.lit(size["mean_length"]))
        part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
        scores = (
            pairs.join(counted, [corpus_id, "term"]).join(frequency, "term").join(lengths, corpus_id)
            .groupBy(query_id, corpus_id).agg(F.sum(part).alias("score"))
        )
        return pool.join(scores, [query_id, corpus_id], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

    return score


def context_gate(hits: DataFrame, queries: DataFrame, threshold: float = 0.55, query_id: str = "query_id") -> DataFrame:
    """Whether a query's context is used: its best dense distance among the returned hits is close enough.

    A query without hits counts as distance 1.
    """
    best = hits.groupBy(query_id).agg(F.min("dense_distance").alias("_best"))
    return queries.select(query_id).join(best, query_id, "left").select(
        query_id,
        F.coalesce("_best", F.lit(1.0)).alias("best_distance"),
        (F.coalesce("_best", F.lit(1.0)) <= threshold).alias("use_context"),
    )


def source_title(source: Column) -> Column:
    named = F
    for key, title in D.SOURCE_TITLES.items():
        named = named.when(source == key, title)
    return named.otherwise(source)


def pack_context(hits: DataFrame, max_tokens: int = 3000, query_id: str = "query_id") -> DataFrame:
    """Fold the ranked hits of each query into one text within a character budget.

    The budget of a later block depends on the cut text of the earlier ones, so this is a fold
    over the (at most top-k) hits of a query, not a running sum.
    """
    budget = max_tokens * 4
    ordered = F.sort_array(F.collect_list(F.struct(
        F.col("rank"), source_title(F.col("source")).alias("label"), F.col("title"), F.col("text"))))
    start = F.struct(
        F.lit(0).alias("total"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("blocks"))

    def add(state: Column, doc: Column) -> Column:
        room = F.lit(budget) - state["total"] - F.length(F.concat(F.lit("["), doc["label"], F.lit("] "), doc["title"])) - 20
        shown = F.when(F.length(doc["text"]) > room, F.concat(F.substring(doc["text"], F.lit(1), room), F.lit("..."))).otherwise(doc["text"])
        block = F.concat(F.lit("--- Reference "), doc["rank"].cast("string"), F.lit(" ("), doc["label"], F.lit(") ---\n"), shown)
        full = state["full"] | (room <= 0)
        return F.struct(
            F.when(full, state["total"]).otherwise(state["total"] + F.length(block)).alias("total"),
            full.alias("full"),
            F.when(full, state["blocks"]).otherwise(F.concat(state["blocks"], F.array(block))).alias("blocks"),
        )

    packed = hits.groupBy(query_id).agg(ordered.alias("docs"))
    folded = packed.withColumn("state", F.aggregate("docs", start, add))
    return folded.select(
        query_id,
        F.array_join("state.blocks", "\n\n").alias("context"),
        F.size("state.blocks").alias("n_blocks"),
        F.col("state.total").alias("n_chars"),
        F.transform("docs", lambda d: d["title"]).alias("titles"),
    )


def embed_texts(corpus: DataFrame, dimension: int = 384, key: str = "id", text: str = "text"):
    """Fit the default embedder: hashed term counts, inverse document frequency, unit length.

    Returns the fitted pipeline model; ``apply_embedder`` turns any texts into vectors with it.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer

    stages = [
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimension),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit"),
    ]
    return Pipeline(stages=stages).fit(corpus.select(key, words(F.col(text)).alias("_words")))


def apply_embedder(model, df: DataFrame, text: str = "text", output: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    embedded = model.transform(df.withColumn("_words", words(F.col(text))))
    return embedded.withColumn(output, vector_to_array("_unit", "float32")).drop("_words", "_counts", "_weighted", "_unit")


def embed_with(df: DataFrame, encode: Callable[[list[str]], list[list[float]]], text: str = "text",
               output: str = "embedding", batch_size: int = 64) -> DataFrame:
    """Slot for any other embedder: ``encode`` maps a list of texts to vectors, batch by batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            vectors: list[list[float]] = []
            for start in range(0, len(texts), batch_size):
                vectors.extend(encode(texts.iloc[start:start + batch_size].tolist()))
            yield pd.Series(vectors)

    return df.withColumn(output, run(F.col(text)))
