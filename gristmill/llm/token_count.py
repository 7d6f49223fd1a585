"""Token counts from distinct pre-tokens.

The corpus' distinct pre-tokens are gathered with their frequencies and their pieces counted once each, giving a table that
is written to the shared folder.  A document's count is the sum over its own pre-token frequencies.  The most frequent
pre-tokens, at most FREQUENT of at most LONGEST characters, reach the documents as a broadcast of bounded size, which
settles nearly all of a document where it stands; every other pre-token is joined to the table by a shuffle.

Pre-tokens are the tokenizer's own, for every text by its one pattern; no merge reaches across two of them, so the counts
of their pieces add up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec
from .bpe_codec import tokenizer_spec
from .common import map_arrow, table, written

FREQUENT = 1 << 18
LONGEST = 64
_FLUSH = 500_000


def pretokens(docs: DataFrame, spec: str) -> DataFrame:
    """piece, freq, n_pieces of each distinct pre-token of docs (text), written to the shared folder."""
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, found = codec(sent.value).units, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["piece", "freq"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text:
                    found.update(units(text))
                    if len(found) > _FLUSH:
                        yield out()
                        found.clear()
        if found:
            yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = codec(sent.value).ids
        for batch in batches:
            n = pa.array([len(ids(p)) for p in batch.column("piece").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], ["piece", "freq", "n_pieces"])

    found = map_arrow(docs.select("text"), gather, "piece string, freq bigint").groupBy("piece").agg(F.sum("freq").alias("freq"))
    return written(map_arrow(found, count, "piece string, freq bigint, n_pieces bigint"))


def frequent(pieces: DataFrame, most: int = FREQUENT, longest: int = LONGEST) -> dict[str, int]:
    """n_pieces of the most frequent pre-tokens, at most `most`: those at or above the least frequency that so many reach."""
    short = pieces.where(F.length("piece") <= longest).withColumn("step", F.floor(8 * F.log2("freq")))
    total, least = 0, None
    for step, n in sorted(short.groupBy("step").count().collect(), reverse=True):  # at most 8 * 63 rows
        total += n
        if total > most:
            break
        least = step
    if least is None:
        return {}
    rows = short.where(F.col("step") >= least).select("piece", "n_pieces").toArrow()
    return dict(zip(rows["piece"].to_pylist(), rows["n_pieces"].to_pylist(), strict=True))


def token_counts(docs: DataFrame, spec: str, limit: int = 512, most: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text; further columns are ignored).

    A null text is empty and counts 0.  Documents are told apart by doc_id and a 128-bit digest of the text; repeated rows
    are counted together and returned as often as they came.
    """
    spark = docs.sparkSession
    pieces = pretokens(docs, spec)
    sent, common = spark.sparkContext.broadcast(spec), spark.sparkContext.broadcast(frequent(pieces, most))
    key = docs.select("doc_id").schema["doc_id"].dataType

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, known = codec(sent.value).units, common.value
        get = known.get
        for batch in batches:
            places, digests, sizes, counts, rare, freqs = [], [], [], [], [], []
            for k, text in enumerate(batch.column("text").to_pylist()):
                raw = (text or "").encode()
                digest, n, left = xxhash.xxh3_128_digest(raw), 0, []
                for u, f in Counter(units(text)).items() if text else ():
                    pieces_of = get(u)
                    if pieces_of is None:
                        left.append((u, f))
                    else:
                        n += pieces_of * f
                m = len(left)
                places += [k] * (m + 1)
                digests += [digest] * (m + 1)
                sizes += [len(raw)] + [None] * m
                counts += [n] + [None] * m
                rare += [digest.hex(), *[u for u, _ in left]]
                freqs += [None, *[f for _, f in left]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(places, pa.int64())),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(rare, pa.string()),
                    pa.array(freqs, pa.int64()),
                ],
                ["doc_id", "digest", "n_bytes", "n", "piece", "freq"],
            )

    # The first row of a document has what is settled; its piece only spreads it, so that one pass serves both kinds of row.
    shape = f"doc_id {key.simpleString()}, digest binary, n_bytes bigint, n bigint, piece string, freq bigint"
    parts = map_arrow(docs.select("doc_id", "text"), split, shape)
    n = F.coalesce("n", F.col("freq") * F.col("n_pieces"))
    summed = (
        parts.join(pieces.select("piece", "n_pieces"), "piece", "left")
        .groupBy("doc_id", "digest")
        .agg(F.max("n_bytes").alias("n_bytes"), F.sum(n).alias("n"), F.count("n").cast("int").alias("rows"))
    )
    n = (F.col("n") / F.col("rows")).cast("long")
    return summed.withColumn("row", F.explode(F.sequence(F.lit(1), "rows"))).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_spec())
