"""Centroid clustering in whole numbers by delta Lloyd rounds.

Every vector's owner and distance are kept in a written table beside it, and the sums and counts of all clusters by the driver
(one row a centroid).  A round compares a vector with the centroids that have changed; only if its own centroid has changed
does it meet all of them.  Vectors that go over are told as signed sums, minus for the old owner and plus for the new one, added
up within each task; so a round reads and writes the table once, and nothing else is shuffled but a row for each task and
centroid.  What is computed is the same as if every vector met every centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_arrow, table, written

#: Components' parts of one, and the size at which a component ends, so that distances fit into 64 bits.
SCALE, LARGEST = 1024, 1 << 27
#: Rows that meet a centroid at once.
ROWS = 4096
_KEPT = "vec_id bigint, v array<int>"
_STATE = f"{_KEPT}, owner int, distance bigint, count bigint, sums array<bigint>"


def whole_numbers(vectors: DataFrame, dimensions: int = 64) -> DataFrame:
    """vec_id, v: the vectors of so many components, none null or non-finite, as floor(SCALE * x)."""
    there = F.coalesce((F.size("embedding") == dimensions) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    bounded = lambda x: F.least(F.greatest(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    near = lambda x: F.least(F.greatest(x.cast("double"), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))  # noqa: E731  before floor, whose result is a long
    return vectors.where(there).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: bounded(near(x)).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The vectors of the k least hashes of seed and vec_id, in their order."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.where("vec_id IS NOT NULL").select(name.alias("name"), "v").orderBy("name", "v").limit(k)
    return [r["v"] for r in found.collect()]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(batch.num_rows, -1)


def reassigned(x: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and distance of each vector after a round; owner -1 is none so far."""
    open_ = (owner < 0) | changed[owner]
    best, nearest = np.where(open_, np.iinfo(np.int64).max, distance), np.where(open_, len(centroids), owner)
    every, some = np.arange(len(x)), np.flatnonzero(open_)
    for c, centre in enumerate(centroids):
        rows = every if changed[c] else some
        apart = x[rows] - centre
        d = (apart * apart).sum(1)
        nearer = (d < best[rows]) | ((d == best[rows]) & (c < nearest[rows]))
        best[rows[nearer]], nearest[rows[nearer]] = d[nearer], c
    return nearest, best


def _round(state: DataFrame, centroids: np.ndarray, changed: np.ndarray) -> DataFrame:
    """The state after a round, and rows (owner, count, sums; vec_id and v null) of the signed transfers of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        names = ["vec_id", "v", "owner", "distance", "count", "sums"]
        long, longs = pa.int64(), pa.list_(pa.int64())
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x, old = _matrix(batch), batch.column("owner").to_numpy().astype(np.int64)
                new, distance = reassigned(x, old, batch.column("distance").to_numpy(), centroids, changed)
                moved = np.flatnonzero(new != old)
                for sign, of in ((-1, old[moved]), (1, new[moved])):
                    for c in np.unique(of[of >= 0]).tolist():
                        rows = moved[of == c]
                        counts[c] += sign * len(rows)
                        sums[c] += sign * x[rows].sum(0)
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(new, pa.int32()), pa.array(distance), pa.nulls(n, long), pa.nulls(n, longs)], names)
        some = np.flatnonzero((counts != 0) | (sums != 0).any(1))
        n = len(some)
        yield pa.RecordBatch.from_arrays([pa.nulls(n, long), pa.nulls(n, pa.list_(pa.int32())), pa.array(some, pa.int32()), pa.nulls(n, long), pa.array(counts[some]), pa.array(sums[some].tolist(), longs)], names)

    return map_arrow(state.select("vec_id", "v", "owner", "distance"), run, _STATE)


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, dimensions: int = 64, seed: int = 3) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, v, cluster, distance of each vector; the centroids), after so many rounds and one more assignment.

    vectors: vec_id (integer), embedding (array of numbers); further columns are ignored.  Vectors that are null, of another
    number of components or hold a null or non-finite one take no part.  A component beyond +-LARGEST after scaling counts as
    that.  Centroids start as the vectors of the k least hashes of seed and vec_id (all, if fewer; of repeated rows of one vec_id
    each is one; rows of a null vec_id never), ties going to the smaller vector.  Ties of distance go to the smaller number; a
    centroid without vectors stays.  If there is nothing to start from, there are no rows.
    """
    rows = written(whole_numbers(vectors, dimensions))
    centroids = np.array(first_centroids(rows, k, seed), np.int64).reshape(-1, dimensions)
    if not len(centroids):
        return rows.limit(0).select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")), []
    counts, sums = np.zeros(len(centroids), object), np.zeros(centroids.shape, object)
    changed = np.ones(len(centroids), bool)
    state = rows.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("distance"))
    before = rows
    for turn in range(rounds + 1):
        after = written(_round(state, centroids, changed))
        discard(before)
        before, state = after, after.where("sums IS NULL")
        if turn == rounds:
            break
        # a row for each centroid and component at most
        moves = after.where("sums IS NOT NULL").select("owner", "count", F.posexplode("sums").alias("at", "part"))
        for r in moves.groupBy("owner", "at").agg(F.sum("part").alias("part"), F.sum("count").alias("count")).collect():
            sums[r["owner"], r["at"]] += r["part"]
            if not r["at"]:
                counts[r["owner"]] += r["count"]
        new = np.array([[s // n for s in row] if n else list(old) for row, n, old in zip(sums.tolist(), counts.tolist(), centroids.tolist(), strict=True)], np.int64)
        changed = (new != centroids).any(1)
        centroids = new
        if not changed.any():
            break  # every further round would leave all as it is
    return state.select("vec_id", "v", F.col("owner").alias("cluster"), "distance"), centroids.tolist()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = clusters(table(spark, sf_dir, "embeddings"))
    found = found.select("vec_id", "cluster", "distance")
    total = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # a row a centroid
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = spark.createDataFrame([(c, d, sum(total.values()), digest[c]) for c, d in total.items()], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(rounds: int = 10) -> str:
    near = "SELECT vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, v, c, list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, m{r}) GROUP BY ALL"
    mean = "SELECT o.c, coalesce(n.m, o.m) AS m FROM m{r} o LEFT JOIN (SELECT c, list(q ORDER BY i) AS m FROM (SELECT c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS q FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) n USING (c)"
    parts = [
        "k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64)",
        "m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (SELECT sha256('3:' || vec_id) AS h, v FROM k ORDER BY h LIMIT 8))",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r=r)})")
        if r < rounds:
            parts.append(f"m{r + 1} AS MATERIALIZED ({mean.format(r=r)})")
    last = f"SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN m{rounds} USING (c)"
    return "WITH " + ",\n".join(parts) + "\n" + last


ORACLE = _oracle()
