"""Exact top-k inner-product search with norm-bucketed retrieval.

Vectors become integers (``floor(scale * x)``). Candidates are dealt into shards
of bounded size, queries into blocks; every (shard, block) pair is one group of
one task. Within a shard the vectors are sorted by length and cut into buckets.
A query whose running k-th score is ``theta`` needs a cosine of at least
``theta / (|q| * longest)`` in a bucket, and that local threshold picks the work:

* over 1: no vector of this bucket or of any later one can matter;
* at least ``COORDINATE_COSINE``: coordinate pruning, the query's largest
  coordinates bound those of any vector within that angle;
* else length pruning: the vectors too short for ``theta`` are left out.

What remains is verified by exact products. The starting ``theta`` comes from the
``SEEDS`` longest vectors, so shards prune from their first bucket on. Each pair
returns at most k rows per query; the final order is a window over those.

Defined cases: rows with a null id or vector, or with null or non-finite
components, take no part; vectors of another dimension than the query's are no
candidates; of rows that share a query's id the smallest vector is the query,
and none of them is its candidate; other repeated rows are candidates each;
fewer candidates than k give as many rows; scores beyond a long are clipped.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS, LEAST_SHARDS, LEAST_ROWS = 16_384, 64, 256
BLOCK_QUERIES = 2_048
BUCKET_ROWS = 512
SEEDS = 1_024
COORDINATE_COSINE = 0.7
FOCUS = 4
EXACT = 2.0**52


def quantized(vector: Column, scale: int) -> Column:
    """Integer components; null unless the vector and all its components are finite."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite & (F.size(parts) > 0), F.transform(parts, lambda x: F.floor(F.lit(float(scale)) * x)))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer inner products, clipped to longs."""
    bound = np.abs(queries).max(initial=0).astype(float) * np.abs(vectors).max(initial=0).astype(float) * queries.shape[1]
    if bound < EXACT:
        return (queries.astype(float) @ vectors.T.astype(float)).astype(np.int64)
    exact = queries.astype(object) @ vectors.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of one query so far."""

    def __init__(self, k: int, theta: float):
        self.k, self.theta = k, theta
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero(scores >= self.theta)
        if not len(near):
            return
        scores, ids = np.concatenate([self.scores, scores[near]]), np.concatenate([self.ids, ids[near]])
        order = np.lexsort((ids, ~scores))[:self.k]  # ~x falls as x grows, without overflow
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.theta = max(self.theta, float(self.scores[-1]))


def feasible(query: np.ndarray, unit: np.ndarray, cosine: float) -> np.ndarray:
    """Rows of ``unit`` vectors whose largest query coordinates lie within the
    bounds that an angle of ``cosine`` or less sets them."""
    keep = np.ones(len(unit), bool)
    spread = math.acos(min(max(cosine, -1.0), 1.0))
    for f in np.argsort(-np.abs(query))[:FOCUS]:
        angle = math.acos(min(max(query[f], -1.0), 1.0))
        low = -1.0 if angle + spread >= math.pi else math.cos(angle + spread)
        high = 1.0 if angle <= spread else math.cos(angle - spread)
        keep &= (unit[:, f] >= low - 1e-9) & (unit[:, f] <= high + 1e-9)
    return np.flatnonzero(keep)


def search(q_ids, queries, theta, ids, vectors, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score): the k best of this shard for each query, as far
    as they reach the query's ``theta``."""
    length = np.sqrt((vectors.astype(float) ** 2).sum(1))
    order = np.argsort(-length, kind="stable")
    ids, vectors, length = ids[order], vectors[order], length[order]
    q_length = np.sqrt((queries.astype(float) ** 2).sum(1))
    unit_queries = queries / np.maximum(q_length, 1e-300)[:, None]
    best = [Best(k, t) for t in theta]
    for s in range(0, len(ids), BUCKET_ROWS):
        part, part_ids, size = vectors[s:s + BUCKET_ROWS], ids[s:s + BUCKET_ROWS], length[s:s + BUCKET_ROWS]
        unit = None
        level = np.array([b.theta for b in best])
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = level / (q_length * size[0])
        cosine[~np.isfinite(cosine)] = -np.inf
        cosine = np.where((q_length * size[0] == 0) & (level > 0), np.inf, cosine)
        alive = cosine <= 1 + 1e-9
        if not alive.any():
            break  # every later bucket is shorter
        narrow = alive & (cosine >= COORDINATE_COSINE)
        for i in np.flatnonzero(narrow):
            if unit is None:
                unit = part / np.maximum(size, 1e-300)[:, None]
            rows = feasible(unit_queries[i], unit, cosine[i])
            rows = rows[part_ids[rows] != q_ids[i]]
            if len(rows):
                best[i].add(products(queries[i:i + 1], part[rows])[0], part_ids[rows])
        wide = np.flatnonzero(alive & ~narrow)
        if len(wide):
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(level[wide] > 0, level[wide] / q_length[wide], 0).min()
            n = int(np.searchsorted(-size, -(least * (1 - 1e-9)), "right"))
            scores = products(queries[wide], part[:n])
            for row, i in enumerate(wide):
                rows = np.flatnonzero(part_ids[:n] != q_ids[i])
                best[i].add(scores[row, rows], part_ids[rows])
    return [(int(q), int(v), int(x)) for q, b in zip(q_ids, best) for x, v in zip(b.scores, b.ids)]


def top_k(df: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, key, score) of each query's k best other rows."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), is_query.alias("is_query"), quantized(F.col(vector), scale).alias("q")).where("id is not null and q is not null")
    rows = rows.withColumn("dim", F.size("q"))
    asked = rows.where("is_query").groupBy("id").agg(F.min(F.struct("dim", "q")).alias("v")).select("id", "v.dim", "v.q")
    n, n_asked = rows.count(), asked.count()
    shards = max(1, math.ceil(n / max(LEAST_ROWS, min(SHARD_ROWS, n // LEAST_SHARDS))))
    blocks = max(1, math.ceil(n_asked / BLOCK_QUERIES))

    squares = F.aggregate("q", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    seeds = rows.select("id", "dim", "q", squares.alias("size")).orderBy(F.desc("size"), "id").limit(SEEDS).select("id", "dim", "q").collect()  # SEEDS rows
    kept = {}
    for r in seeds:
        kept.setdefault(r.dim, []).append((r.id, r.q))
    kept = {d: (np.array([i for i, _ in v], np.int64), np.array([q for _, q in v], np.int64)) for d, v in kept.items()}
    known = spark.sparkContext.broadcast(kept)

    def block(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, own in left.groupby("dim"):
            vectors = right[right["dim"] == dim]
            if not len(vectors):
                continue
            q_ids, queries = own["id"].to_numpy(np.int64), np.stack(own["q"].to_numpy()).astype(np.int64)
            theta = np.full(len(q_ids), -np.inf)
            if dim in known.value:
                ids, seeds = known.value[dim]
                scores = products(queries, seeds)
                for i, q in enumerate(q_ids):
                    other = scores[i][ids != q]
                    if len(other) >= k:
                        theta[i] = float(np.partition(other, len(other) - k)[len(other) - k])
            out += search(q_ids, queries, theta, vectors["id"].to_numpy(np.int64), np.stack(vectors["q"].to_numpy()).astype(np.int64), k)
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    shard, part = (F.pmod(F.xxhash64("id"), F.lit(n)).cast("int") for n in (shards, blocks))
    right = rows.select("id", "dim", "q", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    left = asked.select("id", "dim", "q", part.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(block, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(key), "score")
