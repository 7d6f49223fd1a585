"""Ranked lexical search by windowed bucket scoring.

1. Texts are cut into terms and each document keeps those that the items ask for, with their numbers of occurrences; texts
   themselves don't move.  Documents, all their terms and the documents of each asked term are counted.
2. Documents are dealt by ranges of doc_id, in order; a task goes through them in windows of WINDOW slots.  A window's postings
   are inverted by term; for each item, its terms' contributions are scatter-added into an array of the window's size, while
   the terms' bitsets of occupied slots are joined.  Only occupied slots are harvested into the item's heap, which holds its k
   best of the whole task.
3. The tasks' best are put together in two steps.

Items are taken in blocks of bounded number: what a block's items ask for is all that the driver and every worker hold.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, map_arrow, slices, table, written

#: Characters of a term: ASCII letters and digits, and all that isn't ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_APART = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
#: Slots of a window (an array of 128 KB), and items of a block at most on average.
WINDOW, ITEMS = 1 << 14, 1024
#: UTF-8 bytes of the texts that are cut at once (a longer text alone).
SLICE = 1 << 21


def asked(items: DataFrame) -> DataFrame:
    """item_id, term, times of each item's terms."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0)))
    return items.select(F.col("item_id").cast("long").alias("item_id"), terms.alias("term")).groupBy("item_id", "term").agg(F.count("*").alias("times"))


def _hashed(terms: list[str]) -> np.ndarray:
    return WordHasher(_APART, lower=True).words(b" " + b" ".join(t.encode() for t in terms) + b" ")[0]


def forward(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (number of all terms), terms (places in the sorted hashes `vocabulary`) and times of each document with a term."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, words = WordHasher(_APART, lower=True), known.value
        for batch in slices(batches, SLICE):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            hashes, starts, _ = hasher.words(b" " + b" ".join(texts) + b" ")
            ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
            n = np.diff(np.append(0, ends))
            at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
            asks = words[at] == hashes
            pairs, times = np.unique(np.repeat(np.arange(len(texts)), n)[asks] * len(words) + at[asks], return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(texts) + 1) * len(words)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((pairs % len(words)).astype(np.int32), times.astype(np.int64))]
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])
            yield out.filter(pa.array(n > 0))

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id bigint, n bigint, terms array<int>, times array<bigint>")


class Scorer:
    """Heaps of each item's best documents, fed window by window.

    items: of each item its terms, their weights and repeats.  documents, words: how many there are of both.
    """

    def __init__(self, items: list[list[tuple[int, int, int]]], documents: int, words: int, k: int):
        self.items, self.documents, self.all_words, self.k = items, documents, words, k
        self.heaps: list[list[tuple[int, float]]] = [[] for _ in items]  # score, doc_id with its sign turned; -inf: null
        self.scores = np.zeros(WINDOW, np.int64)

    def window(self, docs: list[int | None], n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, times: np.ndarray) -> None:
        """Scores the documents of a window: ids, numbers of terms, numbers of postings, and these, end to end."""
        length = 75 + (25 * n * self.documents) // self.all_words
        slots = np.repeat(np.arange(len(docs)), sizes)
        gain = (1_000_000_000 * times) // (1000 * times + 12 * length[slots])
        order = np.argsort(terms, kind="stable")
        slots, gain = slots[order], gain[order]
        names, first = np.unique(terms[order], return_index=True)
        lists = {t: (slots[a:b], gain[a:b]) for t, a, b in zip(names.tolist(), first.tolist(), [*first[1:].tolist(), len(slots)], strict=True)}
        bits = {}
        for t, (places, _) in lists.items():
            there = np.zeros(WINDOW, bool)
            there[places] = True
            bits[t] = np.packbits(there)
        for item, heap in zip(self.items, self.heaps, strict=True):
            met = [x for x in item if x[0] in lists]
            if not met:
                continue
            for t, weight, repeats in met:
                places, of = lists[t]
                self.scores[places] += repeats * weight * of
            occupied = np.flatnonzero(np.unpackbits(reduce(np.bitwise_or, (bits[t] for t, _, _ in met))))
            scores = self.scores[occupied]
            self.scores[occupied] = 0
            good = scores > 0 if len(heap) < self.k else scores >= max(1, heap[0][0])
            for slot, score in zip(occupied[good].tolist(), scores[good].tolist(), strict=True):
                doc = docs[slot]
                entry = (score, -math.inf if doc is None else -doc)
                if len(heap) < self.k:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


def _best(forward_lists: DataFrame, items: list[tuple[int | None, list[tuple[int, int, int]]]], documents: int, words: int, k: int) -> DataFrame:
    """item_id, doc_id, score: at least the k best documents of each item."""
    known = forward_lists.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer([terms for _, terms in known.value], documents, words, k)
        held: list[pa.RecordBatch] = []

        def score(whole: pa.Table) -> None:
            lists = [whole[c].combine_chunks() for c in ("terms", "times")]
            sizes = np.diff(lists[0].offsets.to_numpy())
            scorer.window(whole["doc_id"].to_pylist(), whole["n"].to_numpy(), sizes, *(x.flatten().to_numpy() for x in lists))

        for batch in batches:
            held.append(batch)
            while (rows := sum(b.num_rows for b in held)) >= WINDOW:
                whole = pa.Table.from_batches(held)
                score(whole.slice(0, WINDOW))
                held = whole.slice(WINDOW).to_batches() if rows > WINDOW else []
        if held:
            score(pa.Table.from_batches(held))
        found = [(item, None if turned == -math.inf else -turned, score) for (item, _), heap in zip(known.value, scorer.heaps, strict=True) for score, turned in heap]
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["item_id", "doc_id", "score"])

    # rows of one doc_id are dealt by their postings too, so that a much repeated id isn't one task's
    dealt = forward_lists.where(F.size("terms") > 0).repartitionByRange("doc_id", F.xxhash64("terms", "times")).sortWithinPartitions("doc_id")
    return map_arrow(dealt, run, "item_id bigint, doc_id bigint, score bigint")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, block: int = ITEMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k documents of the highest score above 0 for each item.

    docs: doc_id (integer), text; items: item_id (integer), text; further columns are ignored.  A null text has no terms.  Every
    row of docs counts as a document and is ranked; of equal scores the smaller doc_id is first, a null one last.  Rows of one
    item_id, null among them, are one item whose terms add up; an item without terms has no rows, nor has any if no document has
    a term.  Texts of any length are taken whole.  Terms are told by 64-bit hashes.
    """
    spark = docs.sparkSession
    terms = written(asked(items))
    blocks = max(1, -(-items.count() // block))
    found = None
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()  # those of a bounded number of items
        if not rows:
            continue
        hashes = _hashed([r["term"] for r in rows])
        vocabulary = np.unique(hashes)
        lists = written(forward(docs, vocabulary))
        documents, words = lists.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            continue
        holders = dict(lists.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        wanted: dict[int | None, list[tuple[int, int, int]]] = {}
        for r, t in zip(rows, np.searchsorted(vocabulary, hashes).tolist(), strict=True):
            weight = math.floor(1000 * math.log((2 * documents + 2) / (2 * holders.get(t, 0) + 1)))
            wanted.setdefault(r["item_id"], []).append((t, weight, r["times"]))
        best = _best(lists, list(wanted.items()), documents, words, k)
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = F.struct((-F.col("score")).alias("s"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("d"))
    first = lambda c: F.slice(F.array_sort(F.collect_list(c)), 1, k)
    some = found.groupBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")).agg(first(order).alias("best"))
    best = some.select("item_id", F.explode("best").alias("b")).groupBy("item_id").agg(first(F.col("b")).alias("best"))
    return best.select("item_id", F.posexplode("best").alias("rank", "b")).select("item_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.d").alias("doc_id"), (-F.col("b.s")).alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t"
ORACLE = f"""
WITH p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, {_TERMS} FROM documents) GROUP BY ALL
), d AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY doc_id
), c AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d
), q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL
), w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM p GROUP BY t), c
), s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN p USING (t) JOIN d USING (doc_id), c GROUP BY ALL
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 20
"""
