"""Approximate nearest neighbours by low-dimensional stable projections.

Vectors are projected to ``m`` dimensions by Gaussian (2-stable) vectors, so a
squared projected distance over the squared true distance follows a chi-square
distribution with ``m`` degrees of freedom. The projected distances of a few
queries to a shard are one matrix product. A query takes projected neighbours
in order of distance and verifies them on the original vectors; it stops when,
by the chi-square test, a vector not seen yet would be nearer than the k-th
found only with probability ``1 - confidence``.

Equal vectors are one class, indexed once under its least ids; of a class no
more than k + 1 ids can be among the k nearest of a vector, itself left out.

Queries are a stated set that meets all shards in blocks of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tandem.llm.common import shards, stored

PROJECTED_DIMS = 12
CONFIDENCE = 0.999
ROWS_PER_SHARD = 16_384
QUERIES_PER_BLOCK = 256
QUERIES_AT_ONCE = 32
FIRST_ROWS = 256
SPREAD = 1024
SEED = 11


def chi_square_quantile(m: int, p: float) -> float:
    """x with P(chi-square of m degrees <= x) = p, for even m, by bisection."""
    def cdf(x: float) -> float:
        term = total = 1.0
        for i in range(1, m // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    low, high = 0.0, 20.0 * m
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if cdf(mid) < p else (low, mid)
    return high


class Shard:
    """Vectors with their projections; every vector has a list of ids."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], stable: np.ndarray):
        self.vectors, self.points = vectors, vectors @ stable
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.sizes = np.array([len(i) for i in ids])
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.ids = np.concatenate(ids)

    def projected(self, queries: np.ndarray) -> np.ndarray:
        """Squared projected distances, a row per projected query."""
        apart = queries @ self.points.T
        apart *= -2
        apart += self.norms
        apart += np.einsum("ij,ij->i", queries, queries)[:, None]
        return apart

    def named(self, rows: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of all ids of the rows."""
        sizes = self.sizes[rows]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(d, sizes), self.ids[np.repeat(self.begins[rows], sizes) + within]


def search(shard: Shard, apart: np.ndarray, query: np.ndarray, query_id: int, k: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Distances and ids of the k nearest found, nearest first. Rows are
    verified in order of squared projected distance, in growing portions."""
    best_d, best_i = np.empty(0), np.empty(0, np.int64)
    left, portion = np.arange(len(apart)), FIRST_ROWS
    while len(left):
        if len(left) > portion:
            by = np.argpartition(apart[left], portion - 1)
            rows, left = left[by[:portion]], left[by[portion:]]
        else:
            rows, left = left, left[:0]
        d = shard.vectors[rows] - query
        d = np.sqrt(np.einsum("ij,ij->i", d, d))
        if len(best_d) == k:
            near = d <= best_d[-1]
            rows, d = rows[near], d[near]
        d, own = shard.named(rows, d)
        keep = own != query_id
        best_d, best_i = np.concatenate([best_d, d[keep]]), np.concatenate([best_i, own[keep]])
        order = np.lexsort((best_i, best_d))[:k]
        best_d, best_i = best_d[order], best_i[order]
        if len(best_d) == k:
            left = left[apart[left] <= limit * best_d[-1] ** 2]
        portion *= 4
    return best_d, best_i


def valid_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): one row per id with a finite vector of the most frequent
    length that is not all zero."""
    v = F.col(vector_col).cast("array<double>")
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def least_ids(rows: DataFrame, most: int) -> DataFrame:
    """(v, ids): every distinct vector with its ``most`` smallest ids. They are
    chosen in two steps, so that a frequent vector's rows are spread first."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(SPREAD))
    once = F.row_number().over(Window.partitionBy("v", "part").orderBy("vec_id"))
    few = rows.withColumn("part", part).withColumn("r", once).where(F.col("r") <= most)
    return few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, most).alias("ids"))


def nearest(df: DataFrame, k: int = 10, query_modulus: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
            m: int = PROJECTED_DIMS, confidence: float = CONFIDENCE, rows_per_shard: int = ROWS_PER_SHARD,
            queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is a multiple of
    ``query_modulus``, against all others; score is the Euclidean distance.

    Null, zero and non-finite vectors take no part, nor do null ids and vectors
    that are not of the most frequent length. Of rows that repeat an id the
    least vector counts. Ties go to the smaller id. An empty table gives no rows.
    """
    rows = stored(valid_vectors(df, id_col, vector_col), "vectors")
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim, total = (sizes.n, sizes["count"]) if sizes else (1, 0)
    rows = rows.where(F.size("v") == dim)
    classes = least_ids(rows, k + 1)
    n_shards = shards(total, rows_per_shard)
    asked = rows.where(F.pmod("vec_id", F.lit(query_modulus)) == 0)
    n_blocks = shards(asked.count(), queries_per_block)
    # Both counts are sizes over a bound: a task holds one shard and one block.
    shard = F.pmod(F.xxhash64("v"), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(n_blocks)).cast("int")
    held = classes.select(shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(False).alias("q"), "ids", "v")
    posed = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), block.alias("block"), F.lit(True).alias("q"), F.array("vec_id").alias("ids"), "v")
    limit = chi_square_quantile(m, confidence)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        own, queries = part[~part.q], part[part.q]
        out = []
        if len(own) and len(queries):
            stable = np.random.default_rng(SEED).standard_normal((dim, m))
            held = Shard(np.stack(own.v.to_numpy()), own.ids.tolist(), stable)
            for at in range(0, len(queries), QUERIES_AT_ONCE):
                names, asked = queries.ids[at:at + QUERIES_AT_ONCE], np.stack(queries.v[at:at + QUERIES_AT_ONCE].to_numpy())
                for (q,), v, apart in zip(names, asked, held.projected(asked @ stable)):
                    d, i = search(held, apart, v, q, k, limit)
                    out.append(pd.DataFrame({"query_id": q, "vec_id": i, "score": d}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(
            {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = held.union(posed).groupBy("shard", "block").applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
