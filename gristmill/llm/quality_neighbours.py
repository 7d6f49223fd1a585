"""Quality scores by voting of nearest labelled neighbours in a latent-semantic space.

A text's terms (words and their shapes) are hashed, weighted by log frequency and inverse document frequency (counted over
all documents), and projected on the leading right singular vectors of a bounded labelled sample.  The sample's vectors are broadcast; every document's
cosine to all of them is computed exactly, block by block, and its nearest neighbours vote with a power of theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, table

#: Bounds of the labelled sample: rows, and code points of a text.
SAMPLE, LONGEST = 3000, 20_000
TERMS, LATENT, NEIGHBOURS, POWER = 1 << 13, 48, 25, 4
CACHE, BLOCK = 600_000, 512
_SHAPE = ((re.compile(r"[^\W\d_]*[A-ZÀ-ÖØ-Þ]{2,}[^\W\d_]*"), "A"), (re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))


def terms(token: str) -> tuple[int, int]:
    """Hashed terms of a token: its lower-case form, and its shape, in which letters, capitals and digits are runs."""
    if token.isalpha() and token.islower():
        shape = "a"
    else:
        shape = token
        for pattern, sign in _SHAPE:
            shape = pattern.sub(sign, shape)
    return crc32(b"w" + token.lower().encode()) % TERMS, crc32(b"s" + shape.encode()) % TERMS


class Counter:
    """Term counts of texts, with a bounded cache of tokens."""

    def __init__(self):
        self.cache: dict[str, tuple[int, int]] = {}

    def hashed(self, tokens) -> list[tuple[int, int]]:
        cache = self.cache
        new = set(tokens).difference(cache)
        if len(cache) + len(new) > CACHE:
            cache.clear()
            new = set(tokens)
        for t in new:
            cache[t] = terms(t)
        return list(map(cache.__getitem__, tokens))

    def terms(self, text: str) -> np.ndarray:
        """The terms that occur, some more than once."""
        tokens = set(text.split())
        return np.fromiter(chain.from_iterable(self.hashed(tokens)), np.int64, 2 * len(tokens))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms and log-scaled counts, the words' and the shapes' each of unit length."""
        found = self.hashed(text.split())
        ids, counts = [], []
        for k in (0, 1):
            x, n = np.unique(np.fromiter((f[k] for f in found), np.int64, len(found)), return_counts=True)
            n = np.log1p(n).astype(np.float32)
            ids.append(x)
            counts.append(n / np.sqrt((n * n).sum()) if len(n) else n)
        return np.concatenate(ids), np.concatenate(counts)


@dataclass
class Model:
    projection: np.ndarray  # (TERMS, LATENT), weighted by inverse document frequency
    vectors: np.ndarray  # (sample, LATENT), of unit length
    labels: np.ndarray
    prior: float

    def latent(self, texts: list[str], count: Counter) -> np.ndarray:
        """Latent vectors of unit length; zero for a text without terms."""
        out = np.zeros((len(texts), self.projection.shape[1]), np.float32)
        for i, text in enumerate(texts):
            ids, n = count(text)
            if len(ids):
                out[i] = n @ self.projection[ids]
        size = np.sqrt((out * out).sum(1, keepdims=True))
        return np.divide(out, size, out=np.zeros_like(out), where=size > 0)

    def vote(self, latent: np.ndarray) -> np.ndarray:
        """Score of each vector: the labels' mean, weighted by a power of the cosine, over its NEIGHBOURS nearest and all that tie with the last."""
        out = np.full(len(latent), self.prior)
        if not len(self.vectors):
            return out
        k = min(NEIGHBOURS, len(self.vectors))
        for at in range(0, len(latent), BLOCK):
            sim = latent[at : at + BLOCK] @ self.vectors.T
            last = np.partition(sim, -k, axis=1)[:, -k, None]
            w = np.where(sim >= last, np.clip(sim, 0, None), 0).astype(np.float64) ** POWER
            total = w.sum(1)
            out[at : at + BLOCK] = np.where(total > 0, (w @ self.labels) / np.where(total > 0, total, 1), self.prior)
        return np.clip(out, 0, 1)


def frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all documents (text) each of the TERMS terms occurs, and how many documents there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, found, n = Counter(), np.zeros(TERMS, np.int64), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen = np.zeros(TERMS, bool)
                seen[count.terms(text or "")] = True
                found += seen
                n += 1
        there = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*there.tolist(), TERMS], pa.int32()), pa.array([*found[there].tolist(), n], pa.int64())], ["term", "n"])

    out = np.zeros(TERMS + 1, np.int64)
    for r in map_arrow(docs.select("text"), run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():  # TERMS + 1 rows at most
        out[r["term"]] = r["n"]
    return out[:TERMS], int(out[TERMS])


def fit(rows: list[tuple[str, int]], known: tuple[np.ndarray, int], seed: int = 5) -> Model:
    """A model of (text, label 0 or 1) rows: the sample's leading singular vectors by randomised subspace iteration.

    known: what frequencies() gives for the documents at large.
    """
    count, labels = Counter(), np.array([y for _, y in rows], np.float64)
    prior = float(labels.mean()) if len(rows) else 0.5
    if not rows:
        return Model(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, prior)
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, (text, _) in enumerate(rows):
        ids, n = count(text)
        np.add.at(x[i], ids, n)
    idf = (np.log((1 + known[1]) / (1 + np.minimum(known[0], known[1]))) + 0.1).astype(np.float32)
    x *= idf
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((TERMS, min(LATENT + 10, len(rows)))).astype(np.float32)
    for _ in range(4):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    basis = (q @ v.T)[:, :LATENT]
    model = Model(idf[:, None] * basis, np.zeros((0, basis.shape[1]), np.float32), labels, prior)
    model.vectors = model.latent([t for t, _ in rows], count)
    return model


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, longest: int = LONGEST) -> list[tuple[str, int]]:
    """At most `most` rows (text, quality) by a hash of doc_id and text, in the labels' own proportions.

    Rows alike in doc_id and text, and in doc_id and quality, count once; no more than `most` rows reach the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").alias("_y")).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= longest).withColumn("_digest", F.md5("text"))
    n = texts.select("doc_id", "_digest").distinct().join(known, "doc_id").count()
    point = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id").cast("string"), "_digest"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = texts.withColumn("_point", point).where(F.col("_point") < min(1.0, (1.2 * most + 20) / max(1, n))).dropDuplicates(["doc_id", "_digest"])
    rows = some.join(known, "doc_id").orderBy("_point", F.col("doc_id").cast("string"), "_digest", "_y").limit(most)
    return [(r["text"], int(r["_y"])) for r in rows.select("text", "_y").collect()]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text and other columns) with score and predicted, replacing columns of those names; no rows give no rows.

    A null or empty text, and any text when nothing is labelled, scores the sample's share of label 1 (0.5 without a
    sample).  Each row stands alone, repeated or not; equal texts score alike, and texts of any length are read whole.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*(c for c in docs.columns if c not in ("score", "predicted")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, count = sent.value, Counter()
        for batch in batches:
            s = np.round(m.vote(m.latent([t or "" for t in batch.column("text").to_pylist()], count)), 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(s >= 0.5).cast(pa.int32())], [*batch.schema.names, "score", "predicted"])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def _remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit(sample(docs, labels.where(_remainder() != 1)), frequencies(docs))
    return score(docs, model).select("doc_id", F.coalesce(_remainder() == 1, F.lit(False)).alias("held_out"), "score", "predicted")
