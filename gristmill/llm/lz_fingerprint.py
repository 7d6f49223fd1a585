"""Lempel-Ziv phrase fingerprints.

A document's UTF-8 bytes are parsed into dictionary phrases: each is the longest known phrase and one byte more.  The set
of phrases is hashed, and its SIZE least hashes are the fingerprint.  The likeness of two fingerprints estimates the share
of phrases in common, from the least hashes of the union; with fewer than SIZE phrases in all it is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, partitions, table

SIZE = 128


def parse(data: bytes, start: int, stop: int, known: set[bytes], phrases: list[bytes]) -> int:
    """Parses data[start:stop], adding new phrases to both collections; returns where the unfinished rest begins.

    `known` holds every prefix of its phrases, so the longest match is found from any guess: the last phrase's length.
    """
    add, put = known.add, phrases.append
    guess = 1
    while start < stop:
        end = min(start + guess, stop)
        phrase = data[start:end]
        if phrase in known:
            while end < stop:
                end += 1
                phrase = data[start:end]
                if phrase not in known:
                    break
            else:
                return start
        else:
            while end - 1 > start:
                shorter = data[start : end - 1]
                if shorter in known:
                    break
                end -= 1
                phrase = shorter
        add(phrase)
        put(phrase)
        guess = max(1, end - start - 1)
        start = end
    return start


def hashes(phrases: list[bytes]) -> np.ndarray:
    """32-bit hashes: the CRC, mixed so that its order is no longer linear in the bytes."""
    h = np.fromiter(map(crc32, phrases), np.uint32, len(phrases))
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def least(h: np.ndarray) -> np.ndarray:
    return np.unique(h)[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases of two fingerprints, 0 to 1; 1 if both are empty."""
    both = np.concatenate([a, b])
    if not len(both):
        return 1.0
    both.sort()
    twice = both[1:] == both[:-1]
    first = np.concatenate([[True], ~twice])
    last = np.flatnonzero(first)[:SIZE][-1]
    return float(np.count_nonzero(twice[: last + 1]) / min(SIZE, np.count_nonzero(first)))


def text_of(fingerprint: np.ndarray) -> str:
    return base64.b64encode(fingerprint.astype(">u4").tobytes()).decode()


class Parsed:
    """A text's fingerprint, and what was known at the end of the part that editing keeps."""

    def __init__(self, text: str):
        self.text, self.half = text, len(text) // 2
        data = text.encode()
        self.kept = text[: len(text) - self.half]
        cut = len(self.kept.encode())
        self.known, phrases, more = set(), [], []
        self.at = parse(data, 0, cut, self.known, phrases)
        self.head = hashes(phrases)
        parse(data, self.at, len(data), self.known.copy(), more)
        self.least = least(np.concatenate([self.head, hashes(more)]))

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by as much of the other's beginning, and its fingerprint."""
        text = self.kept + other[: self.half]
        data, more = text.encode(), []
        parse(data, self.at, len(data), self.known, more)
        return text, least(np.concatenate([self.head, hashes(more)]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row of docs (doc_id, text; further columns are ignored); a null text is empty.

    Each row stands alone: repeated rows, null ids and empty tables need nothing special.  Equal texts have equal
    fingerprints; the empty text's is the empty string.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                phrases: list[bytes] = []
                data = (text or "").encode()
                parse(data, 0, len(data), set(), phrases)
                out.append(text_of(least(hashes(phrases))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])

    kind = docs.schema["doc_id"].dataType
    return map_arrow(docs.select("doc_id", "text"), run, T.StructType([T.StructField("doc_id", kind), T.StructField("fingerprint", T.StringType())]))


def in_descending_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in partitions of descending doc_id, null last, then by text; with bucket and tail.

    One shuffle: bounds are approximate quantiles of the ids, a row for each bucket.  A bucket's last row also needs the
    next bucket's first, which comes along as a row with tail = true, as does the very first row after the very last.
    """
    n = partitions(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    bounds = sorted(set(bounds or ()))
    limits = F.array(*map(F.lit, bounds)) if n > 1 and bounds else F.array().cast("array<bigint>")
    bucket = F.when(F.col("doc_id").isNull(), n - 1).otherwise(F.size(F.filter(limits, lambda b: b > F.col("doc_id")))).cast("int")
    placed = docs.withColumn("bucket", bucket)
    firsts = [(r[0], r[1]) for r in sorted(placed.groupBy("bucket").agg(F.max("doc_id")).collect())]
    ids = {first: firsts[k - 1][0] for k, (_, first) in enumerate(firsts)}
    to = F.lit(None).cast("int")
    if known := {k: v for k, v in ids.items() if k is not None}:
        before = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
        to = F.when(F.col("doc_id").isin(*known), F.element_at(before, F.col("doc_id")).cast("int"))
    if None in ids:
        to = F.when(F.col("doc_id").isNull(), F.lit(ids[None])).otherwise(to)
    places = F.filter(F.array(F.struct(F.col("bucket").alias("b"), F.lit(False).alias("tail")), F.struct(to.alias("b"), F.lit(True).alias("tail"))), lambda p: p["b"].isNotNull())
    rows = placed.withColumn("place", F.explode(places)).select("doc_id", "text", F.col("place.b").alias("bucket"), F.col("place.tail").alias("tail"))
    return rows.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket", "tail", F.col("doc_id").desc_nulls_last(), "text")


def edit_study(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row of docs.

    docs: doc_id (integer), text; further columns are ignored and a null text is empty.  The next row is the one after in
    descending doc_id (null ids last, equal ids by text), after the last the first; a lone row is its own next.
    """
    kind = docs.schema["doc_id"].dataType
    shape = T.StructType(
        [T.StructField("doc_id", kind), T.StructField("n_chars", T.LongType())]
        + [T.StructField(x, T.StringType()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(x, T.DoubleType()) for x in ("near_edited", "near_next")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its next: bucket, id, Parsed
        for batch in batches:
            out: list[list] = [[] for _ in shape]
            ids = batch.column("doc_id").to_pylist()
            for doc, text, bucket, tail in zip(ids, batch.column("text").to_pylist(), batch.column("bucket").to_pylist(), batch.column("tail").to_pylist(), strict=True):
                if tail and (held is None or held[0] != bucket):
                    continue  # another row of the same id as the next bucket's first
                now = Parsed(text)
                if held is not None and held[0] == bucket:
                    _, own_id, own = held
                    edited, print_ = own.edited(text)
                    values = (own_id, len(own.text), hashlib.sha256(edited.encode()).hexdigest(), text_of(own.least), text_of(print_), likeness(own.least, print_), likeness(own.least, now.least))
                    for column, v in zip(out, values, strict=True):
                        column.append(v)
                held = None if tail else (bucket, doc, now)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target, strict=True)], schema=target)

    target = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), *((x, pa.string()) for x in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    if not isinstance(kind, T.LongType):
        docs, shape = docs.withColumn("doc_id", F.col("doc_id").cast("long")), T.StructType([T.StructField("doc_id", T.LongType()), *shape.fields[1:]])
    return map_arrow(in_descending_order(docs), run, shape)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_study(table(spark, sf_dir, "documents"))
