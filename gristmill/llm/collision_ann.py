"""Approximate nearest neighbours by collision counting over query-centred windows.

Every vector, scaled to unit length, is projected on PROJECTIONS random directions (orthogonal as far as the dimension
allows); a block of rows keeps, for each direction, its projections in sorted order.  A query lays a window around its own
projection in every array.  Virtual rehashing widens all windows by the same factor, again and again, and only the newly
reached entries are counted, until as many vectors as the block owes reach the collision threshold.  Then the threshold
rises to the least number of collisions that so many still have, and the vectors that reach it, ties included, are verified
with the exact cosine in double precision.

A query has a fixed budget of BUDGET verified vectors over the whole table, which blocks owe in proportion to their rows, and
MARGIN more for each block, for the nearest may be spread unevenly.  Rows are cut into blocks of bounded size and queries
into groups of bounded size; each block meets each group in one task, so no task grows with the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions, ship, table

PROJECTIONS, BUDGET, MARGIN = 128, 128, 8
#: The part of all directions in which a vector must meet the query, and the factor by which windows widen.
THRESHOLD, FACTOR = 0.8, 1.15
#: Rows of a block, at most and (with partitions to spare) at least about so many, and queries of a group, at most.
BLOCK, SMALL, GROUP = 16_384, 2_048, 4_096


def directions(dimension: int, count: int, seed: int = 11) -> np.ndarray:
    """Random unit directions as columns, any `dimension` in a row of them orthogonal."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(-(-count // dimension))], axis=1)[:, :count]


class Index:
    """Sorted projections of a block of vectors."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS):
        self.unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
        n, d = vectors.shape
        self.directions = directions(d, projections)
        p = (self.unit @ self.directions).T
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32).ravel()
        # all arrays end to end, 4 apart, so that one binary search serves every direction
        self.shift = 4.0 * np.arange(projections)
        self.sorted = (np.sort(p, axis=1) + self.shift[:, None]).ravel()
        self.n, self.m = n, projections

    def candidates(self, query: np.ndarray, want: int) -> np.ndarray:
        """Places of the `want` vectors, and those that tie, that collide most often with the query where so many reach the threshold."""
        centre = query @ self.directions + self.shift
        counts = np.zeros(self.n, np.int64)
        low = high = np.searchsorted(self.sorted, centre)
        need, want = int(np.ceil(THRESHOLD * self.m)), min(want, self.n)
        edge = np.arange(self.m) * self.n
        width = 0.5 / np.sqrt(len(query))
        while True:
            left = np.maximum(np.searchsorted(self.sorted, centre - width, "left"), edge)
            right = np.minimum(np.searchsorted(self.sorted, centre + width, "right"), edge + self.n)
            left, right = np.minimum(left, low), np.maximum(right, high)
            starts, sizes = np.concatenate([left, high]), np.concatenate([low - left, right - high])
            total = int(sizes.sum())
            if total:
                at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(total)
                counts += np.bincount(self.order[at], minlength=self.n)
            low, high = left, right
            if np.count_nonzero(counts >= need) >= want:
                return np.flatnonzero(counts >= np.partition(counts, self.n - want)[self.n - want])
            width *= FACTOR


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector takes part: not null or empty, all components there and finite, and not zero."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, queries: Column, k: int = 5, budget: int = BUDGET, projections: int = PROJECTIONS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by cosine, of each row of vectors for which `queries` holds.

    vectors: vec_id (integer), embedding (array of numbers); further columns are ignored.  A query is no candidate of its
    own; of repeated rows of one vec_id, the others are.  Vectors that are null, empty, zero or hold a null or non-finite
    component take no part, nor do rows of a null vec_id; only vectors of as many components are compared.  Ties go to the
    smaller vec_id.  No rows give no rows.  `budget` is the number of vectors verified for a query at least (all, if fewer).
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.where(usable() & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(queries, F.lit(False)).alias("asks"))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK), min(partitions(spark), -(-n // SMALL)))
    groups = max(1, -(-rows.where("asks").count() // GROUP))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    group = F.pmod(F.xxhash64(F.lit("group"), "vec_id"), F.lit(groups)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    data = rows.select("vec_id", "embedding", block.alias("block"), every(groups).alias("group"))
    asked = rows.where("asks").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), every(blocks).alias("block"), group.alias("group"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            sizes = left["embedding"].map(len)
            for size, asking in right.groupby(right["query"].map(len)):
                part = left[sizes == size]
                if not len(part):
                    continue
                # scaled by the largest component, which the cosine doesn't see, so that no square overflows or vanishes
                scaled = lambda e: (a := np.stack(e.to_numpy()).astype(np.float64)) / np.abs(a).max(1, keepdims=True)
                x, ids = scaled(part["embedding"]), part["vec_id"].to_numpy()
                norms = np.sqrt((x * x).sum(1))
                index = Index(x, projections)
                want = k + MARGIN + int(np.ceil(budget * len(x) / n))
                for q, qid in zip(scaled(asking["query"]), asking["query_id"].to_numpy(), strict=True):
                    length = np.sqrt((q * q).sum())
                    found = index.candidates(q / length, want)
                    score = (x[found] * q).sum(1) / (norms[found] * length)
                    own = np.flatnonzero(ids[found] == qid)[:1]  # one row of that id is the query itself
                    if len(own):
                        found, score = np.delete(found, own), np.delete(score, own)
                    best = np.lexsort((ids[found], -score))[:k]
                    out["query_id"] += [qid] * len(best)
                    out["vec_id"] += ids[found[best]].tolist()
                    out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    shape = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    key = ["block", "group"]
    near = data.repartition(blocks * groups, *key).groupBy(*key).cogroup(asked.repartition(blocks * groups, *key).groupBy(*key)).applyInPandas(meet, shape)
    first = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, k)
    some = near.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("part")).agg(first(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("best"))
    best = some.select("query_id", F.explode("best").alias("b")).groupBy("query_id").agg(first(F.col("b")).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
