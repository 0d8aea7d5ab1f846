"""Exact top-k search by inner product with MaxScore.

A vector is a document whose terms are its components; a query's terms are its own. In a shard each
term has a bound: the most that any posting of the shard can add for this query (postings whose
product is negative add nothing to a bound). Terms are split by those bounds: the smallest ones
that together stay below the query's current k-th score are non-essential, for a vector that has
postings in none but these can't enter the result. The essential postings are traversed, column
blocks at a time for all queries of a block; a vector is then probed for further terms, those with
the largest bounds first, only while its partial sum and the bounds that remain reach the k-th
score. Each shard gives its k best for each query, and shards are merged by query.

Shards and blocks of queries have fixed sizes, so a task holds one of each however large the table;
each block of queries meets each shard once. Scores are sums of integers, exact in any order.

Defined results: vectors that are null or hold null or non-finite components take no part, neither
as queries nor as candidates; missing components of shorter vectors count as zero. Null ids take no
part. All different vectors of one vec_id take part, as queries and as candidates; the score of two
ids is the best of their vectors', and an id has one rank at most. Ties go to the smaller vec_id.
Scores are 64-bit and exact while the largest possible score is below 2^63.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import settle

K = 5
SHARD = 4096    # vectors of a shard
BLOCK = 2048    # queries of a block
FIRST = 256     # vectors scored wholly to set the first k-th scores
STEP = 1024     # vectors traversed at a time
PROBE = 8       # non-essential terms probed at a time


def integer_vectors(table: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and parts (array<double> of integers): floor(scale * x) of the vectors that take part."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    whole = F.col("embedding").isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & F.coalesce(whole, F.lit(False)))
    parts = F.transform(x, lambda v: F.floor(v * F.lit(float(scale))).cast("double"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), parts.alias("parts")).distinct()


def _matrix(arrays, width: int) -> np.ndarray:
    out = np.zeros((len(arrays), width))
    for i, values in enumerate(arrays):
        out[i, :len(values)] = values
    return out


class _Best:
    """The k best ids of every query so far; they are kept by falling score, then rising id.

    `repeated`: an id may be added more than once.
    """

    def __init__(self, queries: int, k: int, repeated: bool = False):
        self.k, self.repeated = k, repeated
        self.scores = np.full((queries, k), -np.inf)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Takes scored vectors, in any number for a query."""
        if self.repeated:
            order = np.lexsort((-scores, ids, query))
            query, ids, scores = query[order], ids[order], scores[order]
            first = np.append(True, (query[1:] != query[:-1]) | (ids[1:] != ids[:-1]))[:len(query)]
            query, ids, scores = query[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        heads = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.empty(0, int)
        place = np.arange(len(query)) - np.repeat(heads, np.diff(np.append(heads, len(query))))
        kept = place < self.k
        query, ids, scores, place = query[kept], ids[kept], scores[kept], place[kept]
        touched, row = np.unique(query, return_inverse=True)
        all_ids = np.hstack([self.ids[touched], np.full((len(touched), self.k), np.iinfo(np.int64).max)])
        all_scores = np.hstack([self.scores[touched], np.full((len(touched), self.k), -np.inf)])
        all_ids[row, self.k + place], all_scores[row, self.k + place] = ids, scores
        if self.repeated:
            order = np.lexsort((-all_scores, all_ids), axis=1)
            all_ids, all_scores = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_scores, order, 1)
            again = np.hstack([np.zeros((len(touched), 1), bool), all_ids[:, 1:] == all_ids[:, :-1]])
            all_ids, all_scores = np.where(again, np.iinfo(np.int64).max, all_ids), np.where(again, -np.inf, all_scores)
        best = np.lexsort((all_ids, -all_scores), axis=1)[:, :self.k]
        self.ids[touched] = np.take_along_axis(all_ids, best, 1)
        self.scores[touched] = np.take_along_axis(all_scores, best, 1)


def shard_top(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> _Best:
    """MaxScore of a block of queries over one shard."""
    n_terms = queries.shape[1]
    rows = np.arange(len(queries))[:, None]
    high, low = vectors.max(axis=0, initial=0), vectors.min(axis=0, initial=0)
    bounds = np.where(queries > 0, queries * high, queries * low)  # never negative
    rising = np.argsort(bounds, axis=1, kind="stable")
    reach = np.cumsum(np.take_along_axis(bounds, rising, 1), axis=1)  # of the terms up to a place
    best = _Best(len(queries), k, len(np.unique(ids)) < len(ids))
    start = 0
    while start < len(vectors):
        own = vectors[start:start + (STEP if start else FIRST)]
        own_ids = ids[start:start + len(own)]
        least = best.scores[:, -1]
        # Terms whose bounds together stay below the k-th score are non-essential.
        split = (reach < least[:, None]).sum(axis=1)
        essential = np.zeros_like(queries)
        chosen = np.arange(n_terms) >= split[:, None]
        np.put_along_axis(essential, rising, np.where(chosen, np.take_along_axis(queries, rising, 1), 0), 1)
        partial = essential @ own.T
        rest = np.where(split > 0, reach[np.arange(len(queries)), split - 1], 0)
        live = partial + rest[:, None] >= least[:, None]
        live &= own_ids != query_ids[:, None]
        query, vector = np.nonzero(live)
        score = partial[query, vector]
        done = split[query]  # places below this are still to be probed
        while len(query) and done.any():
            head = np.maximum(done - PROBE, 0)
            for step in range(PROBE):
                place = done - 1 - step
                term = rising[query, np.maximum(place, 0)]
                score += np.where(place >= 0, queries[query, term] * own[vector, term], 0)
            done = head
            remains = np.where(done > 0, reach[query, done - 1], 0)
            live = score + remains >= least[query]
            query, vector, score, done = query[live], vector[live], score[live], done[live]
        best.add(query, own_ids[vector], score)
        start += len(own)
    return best


def _exact(queries: np.ndarray, vectors: np.ndarray) -> bool:
    """Whether every sum of products is an integer that a double holds exactly."""
    most = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(1, queries.shape[1])
    return most < 2.0 ** 53


def top_k(vectors: DataFrame, is_query: Column, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best among all vectors but its own.

    `vectors` has vec_id and parts (array<double>), no row twice; `is_query` is a condition on vec_id.
    """
    vectors = settle(vectors, "vectors")
    counted = vectors.agg(F.count("vec_id"), F.count(F.when(is_query, 1))).first()
    shards, blocks = -(-counted[0] // shard) or 1, -(-counted[1] // block) or 1
    spread = F.xxhash64("vec_id", "parts")  # of rows, as one id may have many
    every_block, every_shard = F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(shards - 1))
    candidates = vectors.select(F.pmod(spread, F.lit(shards)).cast("int").alias("shard"), F.explode(every_block).alias("block"),
                                "vec_id", "parts")
    queries = vectors.where(is_query).select(F.explode(every_shard).alias("shard"), F.pmod(spread, F.lit(blocks)).cast("int").alias("block"),
                                             "vec_id", "parts")

    def searched(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(own) or not len(asked):
            return empty
        own = own.sort_values("vec_id")
        width = max(1, own["parts"].map(len).max(), asked["parts"].map(len).max())
        left, right = _matrix(asked["parts"].tolist(), width), _matrix(own["parts"].tolist(), width)
        if not _exact(left, right):
            left, right = left.astype(np.int64), right.astype(np.int64)
        best = shard_top(left, asked["vec_id"].to_numpy(), right, own["vec_id"].to_numpy(), k)
        held = np.isfinite(best.scores)
        return pd.DataFrame({"query_id": np.repeat(asked["vec_id"].to_numpy(), held.sum(axis=1)),
                             "vec_id": best.ids[held], "score": best.scores[held].astype(np.int64)})

    found = candidates.groupBy("shard", "block").cogroup(queries.groupBy("shard", "block")).applyInPandas(
        searched, "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def search_embeddings(table: DataFrame, every: int = 50, k: int = K) -> DataFrame:
    """The k best of every vector whose id is divisible by `every`, against all vectors."""
    return top_k(integer_vectors(table), F.col("vec_id") % every == 0, k)
