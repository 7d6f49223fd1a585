"""Mixing sources to target weights with a low-discrepancy schedule, by DataFrame operations alone.

1. Each source gets a target of words: its share by weight, stopped at `max_repeats` times its size, the excess shared out
   again by weight.
2. Slot i of the schedule maps the van der Corput point of i through the cumulative targets to a source, and slots are ranked
   within their sources.  The points of any stretch of the schedule are spread evenly, so every stretch of the mix keeps the
   weights.
3. The documents of a source are shuffled by a hash, laid end to end and cut into blocks of equally many words (the last may be
   shorter).  The slot of rank r in its source joins block r modulo the source's number of blocks, so words repeat only once all
   were taken, and none is taken more than `max_repeats` times.
4. A schedule can't meet a target that is no multiple of a block, and gives a source up to about log2 of all slots too many or
   too few.  This rest is settled source by source: ranks beyond the target go, missing ranks are added at the end, and the last
   one takes a finer block, of as many words as are left.  So every source meets its target to the word, however small it is.

There is a slot for every `BLOCK` words of the corpus, listed, joined and ranked by distributed operations.  Running totals are
two-level sums and blocks are joined by source and number, so a source with a third of all rows is spread over many tasks.
The table of sources (a row each, a plan someone wrote) is ordered in one task and must stay small; documents never do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, running_total, table, unused, written

MAX_REPEATS = 3
#: Words of a block, and of a slot of the schedule.
BLOCK = 1024
_CELLS, _BITS = 1024, 52


def cycling_weights(rank, cycle=(1, 2, 3)):
    """Weight of the source of that rank (from 0): the cycle over and over."""
    return F.element_at(F.array(*map(F.lit, cycle)), (rank % len(cycle) + 1).cast("int"))


def targets(sizes: DataFrame, weigh=cycling_weights, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sizes (source, size): a row per source with sid, source, source_size, target, low, high.

    A null source is one of its own, a null size counts 0, repeated rows count each, further columns are ignored and no rows
    give no rows.  [low, high) is the source's part of [0, 1).  Sources are ranked by code point, null last.  With caps sorted by cap over
    weight, the level at which weights fill what the capped sources leave is the largest over all cuts of that order.
    """
    everything = Window.partitionBy()
    s = sizes.groupBy("source").agg(F.sum(F.coalesce("size", F.lit(0))).alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("w", weigh(F.col("sid")).cast("double")).withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", left / F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("w")))
    by_sid = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("upto", F.sum("target").over(by_sid))
    s = s.withColumn("all", F.max("upto").over(everything)).withColumn("before", F.coalesce(F.lag("upto").over(Window.orderBy("sid")), F.lit(0.0)))
    part = lambda c: F.when(F.col("all") > 0, F.col(c) / F.col("all")).otherwise(0.0)
    return s.select("sid", "source", "source_size", "target", part("before").alias("low"), part("upto").alias("high"))


def schedule(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """slot, sid and rank (from 0, of the slot in its source) of each slot.

    The points are cut into cells, and a source meets the slots of the cells it reaches into, by an equality join; each
    cell holds equally many slots.
    """
    point = F.conv(F.reverse(F.lpad(F.bin("slot"), _BITS, "0")), 2, 10).cast("double") / F.lit(float(1 << _BITS))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point)
    points = points.withColumn("cell", F.floor(F.col("point") * _CELLS))
    cell = lambda c: F.least(F.floor(F.col(c) * _CELLS), F.lit(_CELLS - 1))
    reach = sources.where("high > low").select("sid", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    taken = points.join(reach, "cell").where("low <= point AND point < high").select("slot", "sid")
    chunk = F.floor(F.col("slot") / min(max(1, slots // 1024), 1 << 14))
    return running_total(taken, ["sid"], [F.col("slot")], chunk, F.lit(1), "rank")


def slots_below(x: str, slots: int) -> Column:
    """How many of the schedule's first `slots` points are less than column x (from 0 to 1), exactly.

    Each bit k of `slots` stands for a stretch of 2^k slots that share their higher bits: its points lie 2^-k apart, from the
    point of the stretch's first slot on.  All is in whole multiples of 2^-_BITS.
    """
    end, out = F.ceil(F.col(x) * F.lit(float(1 << _BITS))).cast("long"), F.lit(0).cast("long")
    for k in range(slots.bit_length()):
        if slots >> k & 1:
            begin, apart = int(f"{slots >> k + 1 << k + 1:0{_BITS}b}"[::-1], 2), _BITS - k
            out = out + F.least(F.shiftright(F.greatest(end - begin + ((1 << apart) - 1), F.lit(0)), apart), F.lit(1 << k))
    return out


def blocks_taken(spark: SparkSession, sources: DataFrame, words: int, max_repeats: int = MAX_REPEATS, block: int = BLOCK) -> DataFrame:
    """sid, block, times (slots that take the whole block), upto (where the source's last, finer block ends; null elsewhere).

    sources as targets() makes them.  Words of a source are numbered from 0 as they are laid, block b begins at b * block.
    """
    slots = -(-words // block)
    drawn = F.least(F.floor(F.col("target") + 0.5), F.col("source_size") * max_repeats)
    given = slots_below("high", slots) - slots_below("low", slots)
    plan = sources.where("source_size > 0").select("sid", "source_size", drawn.alias("drawn"), given.alias("given")).where("drawn > 0")
    plan = plan.withColumn("blocks", F.expr(f"(source_size + {block - 1}) div {block}")).withColumn("rest", F.expr("drawn % source_size"))
    plan = plan.withColumn("passes", F.expr("drawn div source_size"))
    plan = plan.withColumn("needed", F.expr(f"passes * blocks + (rest + {block - 1}) div {block}"))
    missing = plan.where("given < needed").select("sid", F.explode(F.expr("sequence(given, needed - 1)")).alias("rank"))
    ranked = schedule(spark, sources, slots).select("sid", "rank").unionByName(missing)
    slot = ranked.join(plan, "sid").where("rank < needed").select("sid", F.expr("rank % blocks").alias("block"), F.expr("rank div blocks < passes").alias("whole"), "rest")
    upto = F.least((F.col("block") + 1) * block, F.col("rest"))
    return slot.groupBy("sid", "block").agg(F.count_if("whole").alias("times"), F.max(F.when(~F.col("whole"), upto)).alias("upto"))


def mix(docs: DataFrame, weigh=cycling_weights, max_repeats: int = MAX_REPEATS, seed: str = "mix", block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row of docs (doc_id, text, source; further columns ignored).

    A null text has size 0; a null source is a source of its own; a row of a null doc_id shuffles by its text.  A very long text
    lies in many blocks, each joined for itself.  Repeated rows count each; rows that tie in shuffled order are alike in all that
    is returned.  No rows, or no words, take nothing.  Reruns agree, and so do all block lengths: nothing depends on partitions.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = written(
        docs.select(
            "doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.md5(text)))).alias("h")
        )
    )
    sources = written(targets(sized.select("source", "size"), weigh, max_repeats))
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    named = sized.join(sources.select("sid", F.col("source").alias("_source")), F.col("source").eqNullSafe(F.col("_source"))).select("doc_id", "size", "h", "sid")
    digits = max(3, (words.bit_length() - 11) // 4)  # so many chunks of a source that one has at most about 2^14 words, or is one of 4,096
    laid = running_total(named.where("size > 0"), ["sid"], [F.col("h"), F.col("doc_id"), F.col("size")], F.substring("h", 1, digits), F.col("size"), "start")
    pieces = laid.select("sid", "doc_id", "size", "start", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))
    begin, end = F.greatest("start", F.col("block") * block), F.col("start") + F.col("size")
    whole = F.least(end, (F.col("block") + 1) * block) - begin
    finer = F.greatest(F.least(end, F.col("upto")) - begin, F.lit(0))
    words_of = F.col("times") * whole + F.when(F.col("upto").isNotNull(), finer).otherwise(0)
    met = pieces.join(blocks_taken(docs.sparkSession, sources, words, max_repeats, block), ["sid", "block"], "left")
    taken = met.groupBy("sid", "start", "doc_id", "size").agg(F.coalesce(F.sum(words_of), F.lit(0)).cast("long").alias("taken")).drop("start")
    idle = named.where("size = 0").select("sid", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(idle).join(sources, "sid").select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs as often as the mix takes them (taken over size, rounded; at most one document of a source is cut).

    Rows alike in doc_id, source and number of words may stand for one another.  A row without words (null or empty text) is
    never taken, so no rows come of a table without words or without rows.  Texts of any length count whole, null ids and
    null sources are values like others, and other columns pass through, whatever their names.
    """
    size, nth_, copies, copy = (unused(docs, c) for c in ("size", "nth", "copies", "copy"))
    sized = docs.withColumn(size, F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")).where(F.col(size) > 0)
    left = sized.withColumn(nth_, F.row_number().over(Window.partitionBy("doc_id", "source", size).orderBy(F.xxhash64("text"))))
    right = mix(docs, **how).where("taken > 0").withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("taken")))
    right = right.select(*(F.col(k).alias(unused(docs, f"r_{k}")) for k in ("doc_id", "source", "size", "n")), F.round(F.col("taken") / F.col("size")).cast("int").alias(copies))
    same = None
    for mine, k in (("doc_id", "doc_id"), ("source", "source"), (size, "size"), (nth_, "n")):
        alike = F.col(mine).eqNullSafe(F.col(unused(docs, f"r_{k}")))
        same = alike if same is None else same & alike
    out = left.join(right, same).where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


#: What the schedule and its settled rest come to: each source's target to the word, in shuffled order, round after round.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS h FROM documents
), s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sized GROUP BY source
), s1 AS (SELECT *, (1 + sid % 3)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s0
), s2 AS (
  SELECT *, ((SELECT sum(source_size) FROM s0)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1
), s3 AS (SELECT *, least(cap, (SELECT max(level) FROM s2) * w) AS target FROM s2
), s AS (SELECT *, least(floor(target + 0.5)::BIGINT, 3 * source_size) AS drawn FROM s3
), laid AS (
  SELECT sized.*, source_size, target, drawn,
         sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM sized JOIN s ON sized.source IS NOT DISTINCT FROM s.source
)
SELECT doc_id, size, source_size, target, source,
       CASE WHEN size = 0 THEN 0
            ELSE drawn // source_size * size + greatest(least(drawn % source_size - start, size), 0) END::BIGINT AS taken
FROM laid
"""
