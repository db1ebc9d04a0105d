"""A stored inverted index: written with a collection, probed per query without reading a text.

Folder layout, all partitioned by a hash bucket of the term, so a query reads the buckets of its own terms only::

    postings/  bucket, term, block, id, impact    impact: the term's BM25 part in that document, without idf
    blocks/    bucket, term, block, most          the highest impact of the term in a block of documents
    terms/     bucket, term, df, idf

Texts are tokenised once, at build time.  Blocks are hashed groups of documents; their highest impacts bound what any document of a
block can score, and ``search`` leaves out whole blocks that cannot reach a query's k-th best score.  The result is exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowspark.operators.bounded import small_side
from flowspark.operators.retrieval import PairScorer, words
from flowspark.session import written

BLOCK_DOCS = 1024
FIRST_BLOCKS = 2


_WORD = re.compile("[a-z0-9]+")


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, term, tf, length) of each document, and a row without a term for the document itself."""
    for batch in batches:
        places, terms, counts, lengths = [], [], [], []

        def full() -> pa.RecordBatch:
            ids = batch.column("id").take(pa.array(places, pa.int64()))
            return pa.record_batch([ids, pa.array(terms, pa.string()), pa.array(counts, pa.int64()), pa.array(lengths, pa.int64())], ["id", "term", "tf", "length"])

        for i, text in enumerate(batch.column("text")):
            found = Counter(_WORD.findall((text.as_py() or "").lower()))
            n = len(found) + 1
            places += [i] * n
            terms += [None, *found]
            counts += [0, *found.values()]
            lengths += [found.total()] * n
            if len(terms) >= 100_000:
                yield full()
                places, terms, counts, lengths = [], [], [], []
        if terms:
            yield full()


def _block_task(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(query, id, score) from a block's postings and queries: a query's k best, and what equals the last but for rounding."""

    def task(postings: pa.Table, wanted: pa.Table) -> pa.Table:
        wanted = wanted.drop_columns("block").sort_by("term")
        wanted = wanted.append_column("place", pa.array(np.arange(len(wanted))))
        met = wanted.join(postings.drop_columns("block"), "term", join_type="inner", use_threads=False)
        met = met.take(pa.array(np.argsort(met["place"].to_numpy(), kind="stable")))  # parts are added by term, so that copies tie in any block
        parts = met.append_column("part", pc.multiply(met["idf"], met["impact"])).group_by(["query", "id"], use_threads=False).aggregate([("part", "sum")])
        ranked = parts.sort_by([("query", "ascending"), ("part_sum", "descending")]).combine_chunks()
        scores, query = ranked["part_sum"].to_numpy(), pc.dictionary_encode(ranked["query"]).combine_chunks().indices.to_numpy()
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        length = np.diff(np.append(starts, len(query)))
        kth = np.repeat(scores[starts + np.minimum(length, k) - 1], length)
        kept = ranked.filter(pa.array(scores >= kth - 1e-9))
        return pa.table([kept["query"], kept["id"], kept["part_sum"]], ["query", "id", "score"])

    return task


class Postings:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        stats = spark.read.parquet(f"{self.path}/stats").first()
        self.docs, self.blocks, self.buckets = stats["docs"], stats["blocks"], stats["buckets"]
        self.id_type = T.StructType.fromDDL(f"id {stats['id_type']}")["id"].dataType

    @classmethod
    def build(cls, corpus: DataFrame, path: str, key: str = "id", text: str = "text", buckets: int = 16, k1: float = 1.2, b: float = 0.75,
              block_docs: int = BLOCK_DOCS) -> Postings:
        """Index ``corpus``, whose keys are unique and whose rows are documents, those without a word included."""
        spark, path = corpus.sparkSession, path.rstrip("/")
        texts = corpus.select(F.col(key).alias("id"), F.col(text).alias("text"))
        schema = T.StructType([texts.schema["id"], *T.StructType.fromDDL("term string, tf long, length long").fields])
        counted = written(texts.mapInArrow(_count_task, schema))  # a document is one row, so its words are counted without a shuffle
        size = counted.where("term IS NULL").agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).first()
        docs, mean = size["docs"], size["mean"] or 1.0
        blocks = max(1, -(-docs // block_docs))
        norm = k1 * (1 - b + b * F.col("length") / F.lit(mean))
        place = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks).cast("long")).cast("int")
        postings = counted.where("term IS NOT NULL").select(
            cls._bucket(F.col("term"), buckets), "term", place.alias("block"), "id", (F.col("tf") * (k1 + 1) / (F.col("tf") + norm)).alias("impact"))
        # term and block spread a frequent term over tasks; files are sorted, so a probe skips row groups
        postings.repartition("bucket", "term", "block").sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
        stored = spark.read.schema(postings.schema).parquet(f"{path}/postings")
        most = stored.groupBy("bucket", "term", "block").agg(F.max("impact").alias("most"), F.count("*").alias("n"))
        most.repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/blocks")
        df = spark.read.schema(most.schema).parquet(f"{path}/blocks").groupBy("bucket", "term").agg(F.sum("n").alias("df"))
        idf = F.log(1.0 + (F.lit(docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        df.withColumn("idf", idf).repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").parquet(f"{path}/terms")
        spark.range(1).select(F.lit(docs).alias("docs"), F.lit(blocks).alias("blocks"), F.lit(buckets).alias("buckets"), F.lit(texts.schema["id"].dataType.simpleString()).alias("id_type")).write.parquet(f"{path}/stats")
        return cls(spark, path)

    @staticmethod
    def _bucket(term: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets).cast("long")).cast("int").alias("bucket")

    def _table(self, name: str, asked: DataFrame) -> DataFrame:
        """A table of the index, cut to the buckets of the terms asked for."""
        touched = [r[0] for r in asked.select("bucket").distinct().collect()]  # bucket numbers
        return self.spark.read.schema(self._schema(name)).parquet(f"{self.path}/{name}").where(F.col("bucket").isin(touched))

    def _schema(self, name: str) -> T.StructType:
        columns = {"postings": "block int, impact double", "blocks": "block int, most double, n long", "terms": "df long, idf double"}[name]
        ids = [T.StructField("id", self.id_type)] if name == "postings" else []
        return T.StructType([*T.StructType.fromDDL(f"bucket int, term string, {columns}").fields, *ids])

    def _asked(self, queries: DataFrame, query_id: str, query_text: str) -> DataFrame:
        """(query, term, bucket, idf) of the queries' terms that the index knows."""
        terms = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(words(F.col(query_text)))).alias("term"))
        terms = terms.withColumn("bucket", self._bucket(F.col("term"), self.buckets))
        return written(terms.join(self._table("terms", terms).select("bucket", "term", "idf"), ["bucket", "term"]))

    def scorer(self, queries: DataFrame, query_id: str = "query_id", corpus_id: str = "id", query_text: str = "query_text") -> PairScorer:
        """The BM25 score of every pair of a pool; pairs that share no term score 0."""

        def score(pool: DataFrame) -> DataFrame:
            asked = self._asked(queries, query_id, query_text)
            pairs = pool.select(F.col(query_id).alias("query"), F.col(corpus_id).alias("id")).join(asked, "query")
            terms = small_side(asked.select("bucket", "term").distinct())
            found = self._table("postings", asked).join(terms, ["bucket", "term"], "left_semi").select("term", "id", "impact")
            scores = pairs.join(found, ["term", "id"]).groupBy("query", "id").agg(F.sum(F.col("idf") * F.col("impact")).alias("score"))
            scores = scores.select(F.col("query").alias(query_id), F.col("id").alias(corpus_id), "score")
            return pool.join(scores, [query_id, corpus_id], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))

        return score

    def _bounds(self, asked: DataFrame) -> DataFrame:
        """(query, block, bound): more than any document of the block can score."""
        most = self._table("blocks", asked).select("bucket", "term", "block", "most")
        return asked.join(most, ["bucket", "term"]).groupBy("query", "block").agg((F.sum(F.col("idf") * F.col("most")) * (1 + 1e-9)).alias("bound"))

    def _scores(self, asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
        """Full scores of the documents of some (query, block) pairs, for each query those that may be among its k best.

        Postings of the terms asked for meet their queries block by block, and a block has a bounded number of documents: what is
        shuffled are these postings once, whatever the number of queries, and the few scores left of each block.
        """
        wanted = asked.join(blocks.select("query", "block"), "query").select("block", "query", "term", "idf")
        terms = small_side(asked.select("bucket", "term").distinct())
        found = self._table("postings", asked).join(terms, ["bucket", "term"], "left_semi").join(blocks.select("block").distinct(), "block", "left_semi")
        schema = T.StructType([asked.schema["query"], T.StructField("id", self.id_type), T.StructField("score", T.DoubleType())])
        by_block = found.select("block", "term", "id", "impact").groupBy("block").cogroup(wanted.groupBy("block"))
        return by_block.applyInArrow(_block_task(k), schema)

    def probes(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", query_text: str = "query_text") -> tuple[DataFrame, DataFrame, DataFrame]:
        """(terms asked, scores of the first blocks, blocks still to be probed) of a search."""
        asked = self._asked(queries, query_id, query_text)
        bounds = written(self._bounds(asked).withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))))
        first = written(self._scores(asked, bounds.where(F.col("place") <= FIRST_BLOCKS), k))
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        kth = first.withColumn("rank", rank).where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
        open_ = bounds.where(F.col("place") > FIRST_BLOCKS).join(kth, "query", "left").where(F.col("bound") >= F.coalesce("kth", F.lit(0.0)))
        return asked, first, open_

    def search(self, queries: DataFrame, k: int = 10, query_id: str = "query_id", corpus_id: str = "id", query_text: str = "query_text") -> DataFrame:
        """The k best documents of every query by BM25, ties by id; documents without a term of the query are no hits."""
        asked, first, open_ = self.probes(queries, k, query_id, query_text)
        both = first.unionByName(self._scores(asked, open_, k)).withColumn("score", F.round("score", 12))  # so that equal scores tie
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return both.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("query").alias(query_id), "rank", F.col("id").alias(corpus_id), "score")
