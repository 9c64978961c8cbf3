"""Nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots.  Every vector is represented by the order of its
``PREFIX`` nearest pivots and posted, with the rank, in the inverted file of each of them.  A
query walks through the inverted files of its own pivots and adds up, for each vector met, how
well the ranks agree; this gives the footrule distance of the two truncated permutations,
absent pivots ranking behind all others.  A share of each shard, nearest by footrule (at least
``LEAST`` vectors), is reranked by the exact cosine, and the best of all shards win.

How large a share finds the neighbours depends on the vectors: clusters and many dimensions take
more.  So it is measured: ``TRIALS`` queries, first in a seeded order, rerank whole shards, and the
share is that within which ``RECALL`` of their true neighbours lie by footrule, ``SHARE`` at least.

The index is cut into shards of rows; queries go to the shards in blocks and only their best
answers come back, so no task holds more than a shard and a block of queries.  All rows are
indexed; only the pivots and the queries of the trial are samples.

A vector that is null, zero, or holds a null or a non-finite component takes no part; vectors of
different lengths are not compared.  Rows that repeat a vec_id count once (the least vector).  A
null vec_id takes no part.  Copies of a vector tie and rank by vec_id.  An empty table gives no
rows; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluicegate.llm.base import table, written

#: Pivots, chosen from a bounded sample of four times as many different vectors (for each length of
#: vectors), and how many of them represent a vector.
PIVOTS, PREFIX = 256, 96
#: Cosine above which two sampled vectors are too close to be both pivots.
CLOSE = 0.8
#: Least part of a shard that is reranked, and least number of vectors.
SHARE, LEAST = 0.06, 200
#: Queries that measure the share, and the part of their neighbours that it must hold.
TRIALS, RECALL = 128, 0.98
#: Rows of a shard, about, and queries of a block.
SHARD_ROWS, BLOCK_QUERIES = 16_384, 8_192


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first."""
    near = vectors @ pivots.T / np.linalg.norm(pivots, axis=1)
    length = min(length, len(pivots))
    if length < len(pivots):
        some = np.argpartition(-near, length - 1, axis=1)[:, :length]
        some.sort(axis=1)
    else:
        some = np.tile(np.arange(length), (len(vectors), 1))
    order = np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable")
    return np.take_along_axis(some, order, 1)


def spread_out(sample: np.ndarray, many: int) -> np.ndarray:
    """The first ``many`` vectors that are not close to one before; close ones only if others lack."""
    unit = sample / np.linalg.norm(sample, axis=1)[:, None]
    far, near = [], []
    for i in range(len(sample)):
        (near if len(far) and (unit[far] @ unit[i]).max() > CLOSE else far).append(i)
    return sample[(far + near)[:many]]


class InvertedFiles:
    """For each pivot, the vectors that have it in their prefix, with its rank."""

    def __init__(self, permutations: np.ndarray, pivots: int):
        self.n, self.length = permutations.shape
        flat = permutations.ravel()
        order = np.argsort(flat, kind="stable")
        self.vector = (order // self.length).astype(np.int32)
        self.rank = (order % self.length).astype(np.int32)
        self.begin = np.searchsorted(flat[order], np.arange(pivots + 1))

    def agreement(self, query: np.ndarray) -> np.ndarray:
        """Per vector, a number that falls as the footrule distance grows.

        With ranks from 0 and absent pivots at rank ``length``, the distance of two prefixes is
        ``length * (length + 1) - 2 * agreement``.
        """
        out = np.zeros(self.n, np.int32)
        for rank, pivot in enumerate(query.tolist()):
            a, b = self.begin[pivot], self.begin[pivot + 1]
            out[self.vector[a:b]] += self.length - np.maximum(self.rank[a:b], rank)
        return out


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray,
                 top: int, prefix: int = PREFIX, share: float = SHARE, least: int = LEAST):
    """Best vectors of a shard for each query: lists of query id, vector id, cosine and the part of
    the shard that is as near by footrule or nearer."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    files = InvertedFiles(prefixes(vectors, pivots, prefix), len(pivots))
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    most = min(len(ids), max(least, int(np.ceil(share * len(ids)))))
    out = []
    for query_id, query, order in zip(query_ids, queries, prefixes(queries, pivots, prefix)):
        # Ties, as of copies, go to the smaller vec_id.
        rank = np.arange(len(ids)) - files.agreement(order).astype(np.int64) * len(ids)
        near = np.argpartition(rank, most - 1)[:most] if most < len(ids) else np.arange(len(ids))
        near = near[ids[near] != query_id]
        score = (vectors[near] * query).sum(axis=1) / (norms[near] * np.sqrt((query * query).sum()))
        best = np.lexsort((ids[near], -score))[:top]
        place = np.searchsorted(np.sort(rank[near]), rank[near[best]], side="right") / len(ids)
        out.append((np.full(len(best), query_id), ids[near[best]], score[best], place))
    return [np.concatenate(x) for x in zip(*out)]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding in double precision and its length, of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
        .where(finite & F.exists("embedding", lambda x: x != 0))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        .withColumn("size", F.size("embedding")))


def _answers(vectors: DataFrame, queries: DataFrame, pivots, top: int, prefix: int, share: float, least: int,
             shard_rows: int, block_queries: int) -> DataFrame:
    """query_id, vec_id, score, place and rank of the ``top`` best of all shards for each query."""
    shards = max(1, -(-vectors.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_queries))
    # Every block of queries meets every shard; a task holds one of each.
    every_shard, every_block = (F.explode(F.sequence(F.lit(0), F.lit(x - 1))) for x in (shards, blocks))
    posted = vectors.withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(shards)).cast("int")).withColumn("block", every_block)
    # Columns of their own: the queries may be rows of the same table, which a cogroup mixes up.
    own = queries.select(*[F.col(c).alias(c) for c in ("vec_id", "embedding", "size")])
    asked = own.withColumn("block", F.pmod(F.xxhash64(F.lit(5), "vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", every_shard)

    def search(key, rows: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        if len(rows) and len(block):
            found = search_shard(
                rows["vec_id"].to_numpy(np.int64), np.stack(rows["embedding"].to_list()),
                block["vec_id"].to_numpy(np.int64), np.stack(block["embedding"].to_list()),
                pivots.value[int(key[2])], top, prefix, share, least)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score", "place"), found)))

    keys = ["shard", "block", "size"]
    found = (
        posted.groupBy(*keys).cogroup(asked.groupBy(*keys))
        .applyInPandas(search, "query_id long, vec_id long, score double, place double"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)


def nearest(vectors: DataFrame, queries: DataFrame, top: int = 5, n_pivots: int = PIVOTS, prefix: int = PREFIX,
            share: float | None = None, least: int = LEAST, shard_rows: int = SHARD_ROWS,
            block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest of ``vectors`` by cosine for each query.

    Both are tables as ``usable`` returns them.  ``share`` is measured where it is not given.
    """
    seeded = Window.partitionBy("size").orderBy(F.xxhash64(F.lit(11), "vec_id"), "vec_id")
    different = vectors.groupBy("size", "embedding").agg(F.min("vec_id").alias("vec_id"))
    sample = different.withColumn("place", F.row_number().over(seeded)).where(F.col("place") <= 4 * n_pivots)
    sampled: dict[int, list] = {}
    for row in sample.orderBy("size", "place").collect():  # bounded for each length of vectors
        sampled.setdefault(row["size"], []).append(row["embedding"])
    pivots = {size: spread_out(np.array(found), n_pivots) for size, found in sampled.items()}
    if not pivots:
        return vectors.select(
            F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)
    if share is None:
        trials = written(queries.orderBy(F.xxhash64(F.lit(13), "vec_id"), "vec_id").limit(TRIALS), "ann-trials")
        true = _answers(vectors, trials, shared, top, prefix, 1.0, least, shard_rows, block_queries)
        held = true.agg(F.percentile("place", RECALL)).first()[0]  # of TRIALS * top places
        share = min(1.0, max(SHARE, held or 0.0))
    answers = _answers(vectors, queries, shared, top, prefix, share, least, shard_rows, block_queries)
    return answers.select("query_id", "rank", "vec_id", "score")


def op4_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = written(usable(table(spark, sf_dir, "embeddings")), "ann-vectors")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op4_permutation_index": op4_permutation_index}
SQL: dict[str, str] = {}
