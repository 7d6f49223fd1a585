"""Similarity join of documents on the Jaccard similarity of their word shingles, by a grouped prefix join.

1. A fixed-size sketch of shingle frequencies over all documents gives one order of shingles, rare ones first.  It decides
   only how short the lists below are, never which documents link.
2. A document's prefix is so many of its first shingles that two documents that link must share one.  Documents with the
   same prefix and set size form one group, and only groups are put into the inverted lists, once each.
3. Pairs of groups that meet in a list are filtered by set size, by the place of the shingle in both prefixes and by the
   overlap of the prefixes, all known of groups.  A pair is passed over where one of the few shared shingles before this one
   is common to both, for it has met there already.
4. Pairs of groups that are left are expanded into pairs of their classes (documents of equal sets), which are verified on
   the whole sets.
5. Only which documents are connected is asked, so this runs twice.  At first each list's members meet one of them, its hub,
   which connects nearly all copies of a text in linear time.  Then all others meet, in lists without the pairs that are in one
   component already: members of a list's largest component meet those outside it only.  No pair that could join two
   components is left out.
6. Classes of one group that are in different components by then meet only where they agree in a part of what is behind the
   prefix; of so many parts that two sets which link must agree in one that isn't empty (see inside_pairs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHasher, discard, map_arrow, mixed, slices, table, tally, unused, written
from .components import components

CELLS = 1 << 20
#: Bits of the filter that spares sets no pair asks for; it is of one size at any input's, and lets too much through at worst.
FILTER = 1 << 24
#: UTF-8 bytes of the texts that are shingled at once (a longer text alone).
SLICE = 1 << 22
_U = np.uint64


class Shingler:
    """Sets of 64-bit shingle hashes of texts: sorted, without repeats; words are hashed for many texts at once."""

    def __init__(self, words: int):
        self.n = words
        self.factors = mixed(np.arange(1, words + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
        self.words = WordHasher([0x20, *range(0x09, 0x0E)])

    def windows(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Each text's shingle hashes, one for each place, in order."""
        for at in range(0, len(texts), 64):
            parts = [t.encode().lower() if t else b"" for t in texts[at : at + 64]]  # of bytes: lowers A-Z alone
            words, starts, _ = self.words.words(b"\n" + b"\n".join(parts) + b"\n")
            ends = np.searchsorted(starts, np.cumsum([len(p) + 1 for p in parts]))
            runs = np.full(max(0, len(words) - self.n + 1), self.n, _U)
            for k in range(self.n if len(runs) else 0):
                runs += words[k : k + len(runs)] * self.factors[k]
            runs = mixed(runs)
            begin = 0
            for end in ends.tolist():
                if end - begin >= self.n:
                    yield runs[begin : end - self.n + 1]
                elif end > begin:  # a text of fewer words is one shingle
                    few = words[begin:end] * self.factors[: end - begin]
                    yield mixed(np.array([few.sum(dtype=_U)]) + _U(end - begin))
                else:
                    yield words[:0]
                begin = end

    def sets(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for s in self.windows(texts):
            s = np.sort(s)
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def prefix_length(size: int, percent: int) -> int:
    return size - -(-size * percent // 100) + 1


def frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """Counts of shingles by hash cell over all documents: CELLS numbers, whatever the input's size."""
    shingles = Shingler(words)

    def mark(cells: np.ndarray, batch: pa.RecordBatch) -> None:
        for part in slices([batch], SLICE):
            for s in shingles.windows(part.column("text").to_pylist()):
                np.add.at(cells, (s & _U(CELLS - 1)).astype(np.int64), 1)

    return tally(docs.select("text"), mark, CELLS, np.int64)


def sketched(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n, cls (digest of the set), gid (of prefix and size), prefix, and its last shingle in order, of each row."""
    kind = docs.schema["doc_id"].dataType
    known = docs.sparkSession.sparkContext.broadcast(frequencies(docs, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, order = Shingler(words), known.value
        for batch in slices(batches, SLICE):
            sizes, digests, groups, prefixes, often, last = [], [], [], [], [], []
            for s in shingles.sets(batch.column("text").to_pylist()):
                n = len(s)
                sizes.append(n)
                if not n:
                    for column in (digests, groups, prefixes, often, last):
                        column.append(None)
                    continue
                counts = order[(s & _U(CELLS - 1)).astype(np.int64)]
                chosen = np.argsort(counts, kind="stable")[: prefix_length(n, percent)]
                first = s[chosen]
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                groups.append(xxhash.xxh3_64_intdigest(first.tobytes(), seed=n) - (1 << 63))
                prefixes.append(first.view(np.int64))
                often.append(int(counts[chosen[-1]]))
                last.append(int(first[-1]) - (1 << 63))
            columns = ((sizes, pa.int64()), (digests, pa.binary()), (groups, pa.int64()), (prefixes, pa.list_(pa.int64())), (often, pa.int64()), (last, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in columns)], ["doc_id", "n", "cls", "gid", "prefix", "often", "last"])

    shape = T.StructType([T.StructField("doc_id", kind), *T._parse_datatype_string("n bigint, cls binary, gid bigint, prefix array<bigint>, often bigint, last bigint").fields])
    return map_arrow(docs.select("doc_id", "text"), run, shape)


def shared(groups: DataFrame) -> DataFrame:
    """gid, size, end (often, last) and tokens of each group (gid, size, often, last, prefix) that has any.

    tokens: pos and token of each shingle of its prefix that another group's prefix has too, by place.
    """
    postings = groups.select("gid", F.posexplode("prefix").alias("pos", "token"))
    several = postings.groupBy("token").count().where("count > 1").select("token")
    tokens = postings.join(several, "token").groupBy("gid").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("tokens"))
    return groups.select("gid", "size", F.struct("often", "last").alias("end")).join(tokens, "gid")


def listed(lists: DataFrame, *more: str) -> DataFrame:
    """gid, size and more of each group of shared(), once for each of its tokens, with pos, token and the tokens before, if any, as p1 and p2."""
    at = lambda k: F.when(F.col("i") >= k, F.element_at("tokens", F.greatest(F.col("i") - (k - 1), F.lit(1)))["token"])
    rows = lists.select("gid", "size", *more, "tokens", F.posexplode(F.col("tokens.pos")).alias("i", "pos"))
    return rows.select("gid", "size", *more, "pos", F.element_at("tokens", F.col("i") + 1)["token"].alias("token"), at(1).alias("p1"), at(2).alias("p2"))


def _near(x: str, y: str, percent: int) -> Column:
    """Whether sizes and places of a token that both have leave a chance."""
    least, most = F.least(f"{x}.size", f"{y}.size"), F.greatest(f"{x}.size", f"{y}.size")
    rest = F.least(F.col(f"{x}.size") - F.col(f"{x}.pos"), F.col(f"{y}.size") - F.col(f"{y}.pos"))
    return (100 * least >= percent * most) & ((100 + percent) * rest >= percent * (F.col(f"{x}.size") + F.col(f"{y}.size")))


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (ga, gb) of groups: ga the first by place in one of the lists, gb another of it."""
    rows = listed(lists).select("token", "gid", "size", "pos")
    hubs = rows.groupBy("token").agg(F.min(F.struct("pos", "size", "gid")).alias("hub")).select("token", "hub.*")
    met = rows.alias("l").join(hubs.alias("h"), (F.col("l.token") == F.col("h.token")) & (F.col("l.gid") != F.col("h.gid")) & _near("l", "h", percent))
    return met.select(F.col("h.gid").alias("ga"), F.col("l.gid").alias("gb")).distinct()


def open_pairs(lists: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (ga, gb) of groups that meet in a list and aren't in one component as a whole.

    labels: gid, label (null: the group's classes are in several components).  A pair that has met at one of the two tokens
    before is passed over; the first token of both is never such a one.
    """
    named = listed(lists.join(labels, "gid"), "label")
    counts = named.groupBy("token", "label").agg(F.count("*").alias("n"))
    # a null label is never the main one, and leaves its list open
    main = F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label")))["label"]
    opened = counts.groupBy("token").agg(main.alias("main"), F.count("*").alias("labels"), F.max(F.col("label").isNull()).alias("torn"))
    rows = named.join(opened.where("labels > 1 OR torn").select("token", "main"), "token")
    rows = rows.withColumn("inside", F.coalesce(F.col("label") == F.col("main"), F.lit(False))).drop("main")
    # sizes in proportion percent : 100 or closer are in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(100.0 / percent))) if percent < 100 else F.col("size")
    rows = written(rows.withColumn("band", band))
    outside = rows.where("NOT inside").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    once = F.col("b.inside") | (F.struct("a.size", "a.gid") < F.struct("b.size", "b.gid"))
    apart = ~F.coalesce(F.col("a.label") == F.col("b.label"), F.lit(False))
    before = F.coalesce(F.col("a.p1").isin(F.col("b.p1"), F.col("b.p2")), F.lit(False)) | F.coalesce(F.col("a.p2").isin(F.col("b.p1"), F.col("b.p2")), F.lit(False))
    met = outside.alias("a").join(rows.alias("b"), (F.col("a.token") == F.col("b.token")) & (F.col("a.band") == F.col("b.band")) & once & apart & ~before & _near("a", "b", percent))
    pairs = written(met.select(F.col("a.gid").alias("ga"), F.col("b.gid").alias("gb")).distinct())
    discard(rows)
    return pairs


def inside_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes (cls, gid, label, shingles, prefix) of one group in different components that may link.

    Sets of one size that link differ in a number of shingles that the size bounds, and never in their common prefix.  The
    others are dealt by their hash to parts, more than half of that number, so that in some part two such sets differ in one
    shingle at most.  A part has four quarters and four digests, each without one quarter, and two such sets agree in one of
    them.  Pairs come from equal (group, part, quarter, digest) alone.  As there are a few parts more, a set in which only
    few parts have an empty digest needs none of those; sets in which more have are listed under them too.  A pair is given if
    it agrees in as many parts as the differences can't spoil, without those that have an empty digest.
    """
    sized = members.withColumn("n", F.size("shingles").cast("long"))
    overlap = F.expr(f"(2 * n * {percent} + {100 + percent} - 1) div {100 + percent}")
    sized = sized.withColumn("half", F.col("n") - overlap).withColumn("parts", F.col("half") + 2 + F.expr("half * 3 div 20"))
    tokens = sized.select("cls", "gid", "label", "half", "parts", F.explode(F.array_except("shingles", "prefix")).alias("token")).withColumn("hash", F.xxhash64("token"))
    quarter = F.pmod(F.xxhash64(F.lit("quarter"), "token"), F.lit(4))
    keys = ["cls", "gid", "label", "half", "parts", "part"]
    dealt = tokens.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "token"), F.col("parts"))).groupBy(*keys).agg(*(F.bit_xor(F.when(quarter == q, F.col("hash"))).alias(f"q{q}") for q in range(4)))

    def without(q: int) -> Column:
        others = [F.col(f"q{k}") for k in range(4) if k != q]
        x, y, z = (F.coalesce(c, F.lit(0).cast("long")) for c in others)
        return F.struct(F.lit(q).alias("quarter"), F.when(F.coalesce(*others).isNotNull(), x.bitwiseXOR(y).bitwiseXOR(z)).alias("sign"))

    signed = dealt.withColumn("signs", F.array(*map(without, range(4)))).select(*keys, "signs", (~F.exists("signs", lambda s: s["sign"].isNull())).alias("usable"))
    count = signed.groupBy("cls").agg(F.count_if("usable").alias("usable"), F.collect_list("part").alias("there"))
    counted = written(sized.join(count, "cls", "left").select("cls", "gid", "label", "half", "parts", "there", F.coalesce("usable", F.lit(0)).alias("usable")))
    few = counted.where("usable <= half")
    missing = F.array_except(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.coalesce("there", F.array().cast("array<bigint>")))
    empty = F.array(*(F.struct(F.lit(q).alias("quarter"), F.lit(None).cast("long").alias("sign")) for q in range(4)))
    none = few.select("cls", "gid", "label", F.explode(missing).alias("part")).select("*", F.explode(empty).alias("s"))
    every = signed.select("cls", "gid", "label", "part", F.explode("signs").alias("s"))
    blank = every.where("s.sign IS NULL").join(few.select("cls"), "cls", "left_semi")
    listed_parts = every.where("s.sign IS NOT NULL").unionByName(blank).unionByName(none).select("cls", "part", "s.*")
    need = F.greatest(F.col("usable") - F.col("half"), F.lit(1)).alias("need")
    rows = written(listed_parts.join(counted.select("cls", "gid", "label", need), "cls"))
    same = (F.col("x.gid") == F.col("y.gid")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.quarter") == F.col("y.quarter")) & F.col("x.sign").eqNullSafe(F.col("y.sign"))
    met = rows.alias("x").join(rows.alias("y"), same & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.label") != F.col("y.label")))
    agreed = met.groupBy(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), F.col("x.part").alias("part")).agg(F.max(F.greatest("x.need", "y.need")).alias("need"))
    pairs = written(agreed.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("a", "b"))
    discard(rows, counted)
    return pairs


def sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """cls and its set as sorted longs, once for each class of docs (text) in wanted (cls).

    Texts don't move: each is shingled where it is, and only sets that a filter of fixed size lets through are shuffled.
    """
    shingles = Shingler(words)

    def mark(cells: np.ndarray, batch: pa.RecordBatch) -> None:
        for c in batch.column("cls").to_pylist():
            k = int.from_bytes(c[:8], "little") % FILTER
            cells[k >> 3] |= 1 << (k & 7)

    bits = docs.sparkSession.sparkContext.broadcast(tally(wanted.select("cls"), mark, FILTER // 8, np.uint8, np.bitwise_or))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = bits.value
        for batch in slices(batches, SLICE):
            digests, sets = [], []
            for s in shingles.sets(batch.column("text").to_pylist()):
                if not len(s):
                    continue
                c = xxhash.xxh3_128_digest(s.tobytes())
                k = int.from_bytes(c[:8], "little") % FILTER
                if cells[k >> 3] >> (k & 7) & 1:
                    digests.append(c)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["cls", "shingles"])

    return map_arrow(docs.select("text"), run, "cls binary, shingles array<bigint>").dropDuplicates(["cls"]).join(wanted, "cls", "left_semi")


def plausible(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (ga, gb) of groups whose prefixes alone don't rule them out.

    Of two prefixes, take the one whose last shingle comes first in order: its shingles can only be met in the other's
    prefix, so the sets share at most those, and what stands after it.
    """
    known = lists.select("gid", "size", "end", F.col("tokens.token"))
    left, right = known.toDF("ga", "n_a", "end_a", "t_a"), known.toDF("gb", "n_b", "end_b", "t_b")
    both = pairs.join(right, "gb").join(left, "ga")
    after = lambda n: F.ceil(F.col(n) * percent / 100) - 1  # noqa: E731  a set's size without its prefix
    rest = F.when(F.col("end_a") <= F.col("end_b"), after("n_a")).otherwise(after("n_b"))
    most = F.size(F.array_intersect("t_a", "t_b")) + rest
    return both.where((100 + percent) * most >= percent * (F.col("n_a") + F.col("n_b"))).select("ga", "gb")


def expanded(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the classes (cls, gid, label) of the groups of each pair (ga, gb) that are in different components."""
    known = classes.select("gid", "cls", "label")
    both = pairs.join(known.toDF("gb", "b", "label_b"), "gb").join(known.toDF("ga", "a", "label_a"), "ga")
    return both.where("label_a <> label_b").select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b of the pairs (a, b) of classes whose sets reach the similarity."""
    left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("set_a", "set_b"))
    return both.where(100 * common >= percent * (F.size("set_a") + F.size("set_b") - common)).select("a", "b")


def linked(docs: DataFrame, pairs: DataFrame, known: DataFrame | None, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) of classes that link, and the sets of all classes asked for so far (known: those of earlier calls)."""
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = written(wanted if known is None else wanted.join(known, "cls", "left_anti"))
    new = written(sets_of(docs, wanted, words))
    links = written(verified(pairs, new if known is None else known.unionByName(new), percent))
    discard(wanted)
    return links, new


def similarity_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of docs (doc_id, text; further columns are ignored).

    Two rows link when 100 * |A & B| >= percent * |A | B| for their sets of `words`-word shingles (a text of fewer words is
    one shingle).  component_id is the least doc_id that links reach.  A null or empty text, or one of white space, has an
    empty set, links with nothing and is a component of its own.  Rows of a null doc_id take part, and keep a null
    component_id only if no row with an id is reached.  Repeated rows are returned as often as they came; no rows give no
    rows.  Texts of any length are taken whole.
    """
    whole = written(sketched(docs, words, percent))
    there = whole.where("n > 0")
    groups = written(there.groupBy("gid").agg(F.first(F.struct(F.col("n").alias("size"), "often", "last", "prefix")).alias("g")).select("gid", "g.*"))
    base = written(whole.select("doc_id", "n", "cls", "gid"))
    discard(whole)
    classes = written(base.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("gid").alias("gid")))
    lists = written(shared(groups))
    within = classes.groupBy("gid").agg(F.min("cls").alias("a"), F.count("*").alias("n")).where("n > 1").select("gid", "a")
    within = classes.join(within, "gid").where("cls <> a").select("a", F.col("cls").alias("b"))
    single = classes.select("cls", "gid", F.col("cls").alias("label"))
    pairs = written(expanded(plausible(hub_pairs(lists, percent), lists, percent), single).unionByName(within))
    links, sets = linked(docs, pairs, None, words, percent)
    discard(pairs)

    first = components(links)
    named = written(classes.join(first.toDF("cls", "label"), "cls", "left").withColumn("label", F.coalesce("label", "cls")))
    of_groups = named.groupBy("gid").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).select("gid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("label"))
    rest = expanded(plausible(open_pairs(lists, of_groups, percent), lists, percent), named)
    # every class of a group of several has its set already, for it has met the group's first one
    torn = named.join(of_groups.where("label IS NULL").select("gid"), "gid", "left_semi")
    within = inside_pairs(torn.join(sets, "cls").join(groups.select("gid", "prefix"), "gid").select("cls", "gid", "label", "shingles", "prefix"), percent)
    pairs = written(rest.unionByName(within))
    more, last_sets = linked(docs, pairs, sets, words, percent)
    discard(pairs, sets, last_sets, lists, groups, within)
    # links between components, named by their labels, join them
    nodes = named.select("cls", "label")
    joins = more.join(nodes.toDF("a", "label_a"), "a").join(nodes.toDF("b", "label_b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    second = components(joins)
    final = written(named.join(second.toDF("label", "now"), "label", "left").select("cls", "rep", F.coalesce("now", "label").alias("label")))
    least = final.groupBy("label").agg(F.min("rep").alias("component"))
    component = final.join(least, "label").select("cls", "component")
    found = base.select("doc_id", F.col("n").alias("n_shingles"), "cls").join(component, "cls", "left")
    discard(links, more, first, second, named, classes)
    return found.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def deduplicated(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs (doc_id, text; other columns pass through, whatever their names) of each component.

    That is the row of the least doc_id (null last), and of rows alike in that, of the least digest of the text; rows alike
    in both stand for one another, and one of them stays.  A row without shingles (null or empty text) is left out only for
    rows alike in both.  No rows give no rows.
    """
    digest, key = unused(docs, "digest"), unused(docs, "key")
    keyed = docs.withColumn(digest, F.unhex(F.md5("text")))
    row = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(digest).alias("digest"))
    groups = similarity_groups(keyed.select(row.alias("doc_id"), "text"), words, percent)
    of = lambda id_, d: F.concat(F.coalesce(F.hex(d), F.lit("-")), F.lit(" "), F.coalesce(id_.cast("string"), F.lit("-")))
    kept = groups.where(F.col("doc_id") == F.col("component_id")).select(of(F.col("doc_id.id"), F.col("doc_id.digest")).alias(key))
    rows = keyed.withColumn(key, of(F.col("doc_id"), F.col(digest)))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_groups(table(spark, sf_dir, "documents"), words=3, percent=90)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(x.n) + any_value(y.n) - count(*))
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.reached) AS component_id
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id
"""
