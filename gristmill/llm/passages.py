"""Removal of passages that an earlier document has too, by super-k-mer partitioning.

1. A window is WINDOW consecutive words; its minimiser is the least hash of the MER-word runs inside it.  Consecutive windows
   of one minimiser are packed into one string, a piece of at most WINDOW - MER + 1 windows.
2. Minimisers are counted: only those of two documents or more can hold a shared window.  They and the busy ones among them
   are marked in filters of fixed size, which let too much through at worst.
3. Pieces of shared minimisers travel as packed strings to their minimiser's bucket.  There windows are sorted by hash, and
   equal ones compared by their bytes; a window is removed if an earlier document has it.
4. A busy minimiser's pieces (a passage that very many documents hold) would make one bucket too large.  The least document
   of each different piece is a sum with partial aggregation, joined back to the pieces: those of later documents go whole.
   The others are told apart by longer runs of words: a piece is cut into at most three or four shorter ones, of windows that
   share a core around their minimiser.  Those whose core no other document has can hold no shared window, those of a core that
   is no longer busy travel to buckets, and the rest goes through the same again.  The last core is the window itself.
5. Ranges of removed words meet their documents in one join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, discard, map_arrow, mixed, partitions, slices, table, tally, written

WINDOW, MER = 50, 8
#: Pieces of one minimiser from which on its windows travel alone, and pieces of a bucket, on average.
BUSY, BUCKET = 512, 4096
#: Bits of the filters of shared and of busy minimisers.
SHARED_BITS, BUSY_BITS = 1 << 27, 1 << 24
#: UTF-8 bytes of the texts that are cut at once (a longer text alone).
SLICE = 1 << 21
_U = np.uint64
_SPACE = [0x20, *range(0x09, 0x0E)]
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_PIECE = "doc_id bigint, digest binary, start bigint, windows bigint, packed binary, minimiser bigint"


class Rolling:
    """Hashes of all runs of so many values: differences of one running sum of values times powers of an odd number."""

    def __init__(self, size: int, factor: int):
        self.size, self.factor, self.inverse = size, factor, pow(factor, -1, 1 << 64)
        self.up = self.down = np.ones(1, _U)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if n < self.size:
            return values[:0]
        if n > len(self.up):
            grown = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([[_U(1)], np.full(grown - 1, _U(f))])) for f in (self.factor, self.inverse))
        total = np.concatenate([[_U(0)], np.cumsum(values * self.up[:n])])
        return mixed((total[self.size :] - total[: n - self.size + 1]) * self.down[: n - self.size + 1])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return values if have == width else np.minimum(values[: len(values) - (width - have)], values[width - have :])


def runs(keys: np.ndarray, of: np.ndarray, place: np.ndarray, most: int, window: int, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of at most `most` consecutive windows of one key and text: the first window, their number, and their bytes' begin and end.

    of, place: each window's text and first word; starts, sizes: of the words.
    """
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])])
    first = np.flatnonzero(new)
    run = np.arange(len(place)) - np.repeat(first, np.diff(np.append(first, len(place))))
    first = np.flatnonzero(run % most == 0)
    many = np.diff(np.append(first, len(place)))
    last = place[first] + many + window - 2
    return first, many, starts[place[first]], starts[last] + sizes[last]


class Cutter:
    """Pieces of texts: runs of consecutive windows of one minimiser."""

    def __init__(self, window: int = WINDOW, mer: int = MER):
        mer = min(mer, window)
        self.window, self.width = window, window - mer + 1
        self.hasher, self.mers = WordHasher(_SPACE), Rolling(mer, _FACTORS[0])

    def pieces(self, texts: list[str | None]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The texts' words with one space between; of each piece its text, first word in it, windows, minimiser, and its bytes' begin and end."""
        words = [(t or "").encode().split() for t in texts]
        data = b"\n" + b"\n".join(b" ".join(w) for w in words) + b"\n"
        hashes, starts, sizes = self.hasher.words(data)
        counts = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(counts)
        # every place at which a window begins
        n = np.maximum(counts - self.window + 1, 0)
        text = np.repeat(np.arange(len(texts)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = at + np.repeat(ends - counts, n)
        if not len(place):
            none = np.zeros(0, np.int64)
            return data, none, none, none, none.view(_U), none, none
        minimiser = least(self.mers(hashes), self.width)[place]
        first, many, begin, end = runs(minimiser, text, place, self.width, self.window, starts, sizes)
        return data, text[first], at[first], many, minimiser[first], begin, end


def _marks(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    k = (keys & _U(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[k >> 3] >> (k & 7).astype(np.uint8)) & 1 > 0


def _filter(minimisers: DataFrame, size: int) -> np.ndarray:
    def mark(cells: np.ndarray, batch: pa.RecordBatch) -> None:
        k = (batch.column("minimiser").to_numpy(zero_copy_only=False).view(_U) & _U(size - 1)).astype(np.int64)
        np.bitwise_or.at(cells, k >> 3, (1 << (k & 7)).astype(np.uint8))

    return tally(minimisers.select("minimiser"), mark, size // 8, np.uint8, np.bitwise_or)


def minimisers(docs: DataFrame, window: int = WINDOW, busy: int = BUSY) -> DataFrame:
    """minimiser, busy of each minimiser that two documents or more (doc_id, text) have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(window)
        for batch in slices(batches, SLICE):
            _, text, _, _, keys, _, _ = cutter.pieces(batch.column("text").to_pylist())
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids, pa.int64())], ["minimiser", "doc_id"])

    return shared_by_documents(map_arrow(docs.select("text", "doc_id"), run, "minimiser bigint, doc_id bigint"), busy)


def shared_by_documents(pieces: DataFrame, busy: int) -> DataFrame:
    """minimiser, busy (whether more pieces than that have it) of each minimiser of pieces (minimiser, doc_id) that two documents or more have."""
    of = pieces.groupBy("minimiser").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n"))
    return of.where("low < high").select("minimiser", (F.col("n") > busy).alias("busy"))


def travelling(docs: DataFrame, shared: np.ndarray, busy: np.ndarray, window: int = WINDOW) -> DataFrame:
    """doc_id, digest, start, windows, packed, minimiser and busy of each piece of docs (doc_id, digest, text) that may hold a shared window."""
    known = docs.sparkSession.sparkContext.broadcast((shared, busy))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(window)
        for batch in slices(batches, SLICE):
            data, text, at, many, keys, begin, end = cutter.pieces(batch.column("text").to_pylist())
            keep = np.flatnonzero(_marks(known.value[0], keys))
            text, at, many, keys = text[keep], at[keep], many[keep], keys[keep]
            packed = [data[a:b] for a, b in zip(begin[keep].tolist(), end[keep].tolist(), strict=True)]
            columns = [batch.column("doc_id").take(pa.array(text)), batch.column("digest").take(pa.array(text)), pa.array(at, pa.int64()), pa.array(many, pa.int64())]
            columns += [pa.array(packed, pa.binary()), pa.array(keys.view(np.int64)), pa.array(_marks(known.value[1], keys))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "start", "windows", "packed", "minimiser", "busy"])

    return map_arrow(docs.select("text", "doc_id", "digest"), run, f"{_PIECE}, busy boolean")


class Unpacker:
    """Windows of packed pieces."""

    def __init__(self, window: int):
        self.window, self.hasher = window, WordHasher(_SPACE)

    def windows(self, pieces: pa.Table | pa.RecordBatch) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The pieces' bytes; hashes, starts and sizes of their words; of each window its piece, its place there and its first word."""
        data = b"\n" + b"\n".join(pieces["packed"].to_pylist()) + b"\n"
        hashes, starts, sizes = self.hasher.words(data)
        n = pieces["windows"].to_numpy()
        words = n + self.window - 1
        piece = np.repeat(np.arange(len(n)), n)
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return data, hashes, starts, sizes, piece, at, at + np.repeat(np.cumsum(words) - words, n)


def sorted_bucket(window: int):
    """What finds a bucket's removed ranges (doc_id, digest, begin, end): windows are sorted, and equal ones compared by their bytes."""

    def run(pieces: pa.Table) -> pa.Table:
        data, hashes, starts, sizes, piece, at, place = Unpacker(window).windows(pieces)
        docs = pieces["doc_id"].to_numpy()[piece]
        keys = Rolling(window, _FACTORS[1])(hashes)[place]
        order = np.lexsort((docs, keys))
        ordered = keys[order]
        head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        first = order[np.flatnonzero(head)][np.cumsum(head) - 1]  # the earliest document's window of each
        later = np.flatnonzero(docs[order] > docs[first])
        begin, end = starts[place].tolist(), (starts[place + window - 1] + sizes[place + window - 1]).tolist()
        gone, differ = np.zeros(len(place), bool), []
        for x, y in zip(order[later].tolist(), first[later].tolist(), strict=True):
            if data[begin[x] : end[x]] == data[begin[y] : end[y]]:
                gone[x] = True
            else:
                differ.append(x)
        if differ:  # equal hashes of different windows: told apart by their bytes alone
            mixed_up = np.flatnonzero(np.isin(keys, keys[differ]))
            earliest: dict[bytes, int] = {}
            for x in mixed_up.tolist():
                key = data[begin[x] : end[x]]
                earliest[key] = min(earliest.get(key, docs[x]), docs[x])
            for x in mixed_up.tolist():
                gone[x] = docs[x] > earliest[data[begin[x] : end[x]]]
        removed = np.flatnonzero(gone)  # by piece and place
        apart = np.concatenate([[True], (np.diff(removed) != 1) | (np.diff(piece[removed]) != 0)]) if len(removed) else np.zeros(0, bool)
        low, high = removed[apart], removed[np.append(apart[1:], True)] if len(removed) else removed
        of, start = pa.array(piece[low]), pieces["start"].to_numpy()[piece[low]]
        columns = [pieces["doc_id"].combine_chunks().take(of), pieces["digest"].combine_chunks().take(of), pa.array(start + at[low]), pa.array(start + at[high] + window)]
        return pa.table(columns, ["doc_id", "digest", "begin", "end"])

    return run


def finer(pieces: DataFrame, span: int, window: int = WINDOW) -> DataFrame:
    """The pieces cut into shorter ones of at most `span` windows, which share a core of window - span + 1 words: its hash is their minimiser.

    A window's core has a place in it that the place of its first least MER-word run tells, so equal windows have equal cores.
    """
    mer = min(MER, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, mers, cores = Unpacker(window), Rolling(mer, _FACTORS[0]), Rolling(window - span + 1, _FACTORS[1])
        for batch in slices(batches, SLICE, "packed"):
            data, hashes, starts, sizes, piece, at, place = unpacker.windows(batch)
            found = mers(hashes)
            n = batch.column("windows").to_numpy()
            least_of = least(found, window - mer + 1)[place[np.cumsum(n) - n]]  # one for all windows of a piece
            hits = np.flatnonzero(found == np.repeat(least_of, n + window - 1)[: len(found)])
            key = cores(hashes)[place + (hits[np.searchsorted(hits, place)] - place) % span]
            first, many, begin, end = runs(key, piece, place, span, window, starts, sizes)
            of = pa.array(piece[first])
            packed = pa.array([data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())
            columns = [batch.column("doc_id").take(of), batch.column("digest").take(of), pa.array(batch.column("start").to_numpy()[piece[first]] + at[first])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(many), packed, pa.array(key[first].view(np.int64))], ["doc_id", "digest", "start", "windows", "packed", "minimiser"])

    return map_arrow(pieces.select("doc_id", "digest", "start", "windows", "packed"), run, _PIECE)


def met_whole(pieces: DataFrame) -> DataFrame:
    """The pieces; packed is null where an earlier document has the whole piece.

    A later document's piece tells nothing new of its windows, since the first document has them all: what is left finds the
    least document of each window.
    """
    # what is joined is written, so that the join has plain shuffles on both sides, which AQE splits where very many documents hold one piece
    firsts = written(pieces.groupBy("packed").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("packed", "low"))
    left = F.when(F.col("low").isNull() | (F.col("doc_id") == F.col("low")), F.col("packed"))
    met = written(pieces.join(firsts, "packed", "left").select("doc_id", "digest", "start", "windows", left.alias("packed"), "minimiser"))
    discard(firsts)
    return met


def met_by_cores(pieces: DataFrame, window: int = WINDOW, busy: int = BUSY) -> tuple[list[DataFrame], list[DataFrame]]:
    """Written tables made of pieces of busy minimisers: in the first, an earlier document has the pieces whole whose packed is
    null (the others are to be passed over); in the second, the pieces that aren't busy are to be sorted in buckets."""
    if pieces.isEmpty():
        return [], []
    whole, rest = [], []
    width = window - min(MER, window) + 1
    span = 4 ** max(k for k in range(width + 1) if 4**k < max(width, 2))  # the first to cut to, if there is more than one window
    while True:
        met = met_whole(pieces)
        whole.append(met)
        if rest:
            discard(pieces)
        if width == 1:
            return whole, rest
        left = met.where("packed IS NOT NULL")
        keys = written(shared_by_documents(left, busy))
        rest.append(written(left.join(keys, "minimiser")))
        discard(keys)
        if rest[-1].where("busy").isEmpty():
            return whole, rest
        pieces, width, span = written(finer(rest[-1].where("busy"), span, window)), span, max(span // 4, 1)


def removed_ranges(docs: DataFrame, window: int = WINDOW, busy: int = BUSY) -> DataFrame:
    """doc_id, digest, begin, end of ranges of words, that may overlap, of docs (doc_id, digest, text) to be removed."""
    spark = docs.sparkSession
    docs = docs.where("doc_id IS NOT NULL")
    found = written(minimisers(docs, window, busy))
    shared, hot = _filter(found, SHARED_BITS), _filter(found.where("busy"), BUSY_BITS)
    discard(found)
    pieces = written(travelling(docs, shared, hot, window))
    columns = ["doc_id", "digest", "start", "windows", "packed", "minimiser"]
    whole, rest = met_by_cores(pieces.where("busy").select(columns), window, busy)
    usual = pieces.where("NOT busy").select(columns)
    for r in rest:
        usual = usual.unionByName(r.where("NOT busy").select(columns))
    n = max(2 * partitions(spark), -(-usual.count() // BUCKET))
    bucket = F.pmod(F.xxhash64("minimiser"), F.lit(n)).cast("int")
    shape = "doc_id bigint, digest binary, begin bigint, end bigint"
    found = usual.withColumn("bucket", bucket).drop("minimiser").groupBy("bucket").applyInArrow(sorted_bucket(window), shape)
    for w in whole:
        found = found.unionByName(w.where("packed IS NULL").select("doc_id", "digest", F.col("start").alias("begin"), (F.col("start") + F.col("windows") + (window - 1)).alias("end")))
    ranges = written(found)
    discard(pieces, *whole, *rest)
    return ranges


def without_repeats(docs: DataFrame, window: int = WINDOW, busy: int = BUSY) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text of the words that stay, one space between) and spans (begin, end: the ranges
    of removed words, in order, without overlap) of each row of docs (integer doc_id, text; further columns are ignored).

    A word goes if it is in a window of `window` consecutive words that a document of a smaller doc_id has as well, in what was
    given.  A null or empty text has no words; a text of fewer words than a window loses none.  Rows of one doc_id lose nothing
    to each other, repeated rows are returned as often as they came, and a row of a null doc_id has no place in the order: it
    loses nothing and takes nothing.  Texts of any length are taken whole.  No rows give no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5("text")).alias("digest"), "text")
    ranges = removed_ranges(rows, window, busy).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("begin", "end")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, SLICE):
            sizes, gone, kept, spans = [], [], [], []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = (text or "").encode().split()
                edges = []
                if found:
                    depth = np.zeros(len(words) + 1, np.int32)
                    np.add.at(depth, [r["begin"] for r in found], 1)
                    np.add.at(depth, [r["end"] for r in found], -1)
                    inside = np.cumsum(depth) > 0
                    edges = (np.flatnonzero(inside[1:] != inside[:-1]) + 1).tolist()
                    edges = ([0] if inside[0] else []) + edges
                sizes.append(len(words))
                spans.append([{"begin": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)])
                gone.append(sum(x["end"] - x["begin"] for x in spans[-1]))
                stay = zip([0, *edges[1::2]], [*edges[::2], len(words)], strict=True)
                kept.append(b" ".join(w for a, b in stay for w in words[a:b]).decode())
            kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            columns = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept", "spans"])

    met = rows.join(ranges, ["doc_id", "digest"], "left").select("text", "doc_id", "ranges")
    return map_arrow(met, run, "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<begin:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents)
), v AS (
  SELECT doc_id, i, g FROM (
    SELECT doc_id, i, string_agg(word, ' ') OVER fifty AS g, count(*) OVER fifty AS n
    FROM w WINDOW fifty AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)) WHERE n = 50
), f AS (SELECT g, min(doc_id) AS first FROM v GROUP BY g
), c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM v JOIN f USING (g) WHERE first < doc_id
), k AS (
  SELECT doc_id, count(*) AS n, count(c.i) AS gone, string_agg(word, ' ' ORDER BY w.i) FILTER (c.i IS NULL) AS kept
  FROM w LEFT JOIN c USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)
"""
