"""Reviewing: decisions on blocks and pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import decision_key, parsed_key, preview
from ..schemas import BLOCK_DECISIONS
from .duplicates import KEY, ranked


def initialised(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """decisions with an undecided row for every block that has none; nothing is overwritten."""
    missing = blocks.select(*KEY).distinct().join(decisions, KEY, "left_anti")
    return decisions.select(*KEY, "decision").unionByName(missing.withColumn("decision", F.lit("undecided")))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of rows with equal keys the one of the highest version: an upsert by union."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), version).alias("_row")).select(*keys, "_row.*")


def changed(decisions: DataFrame, stored: DataFrame) -> DataFrame:
    """Decisions that differ from the stored ones of known blocks."""
    old = stored.select(*KEY, F.col("decision").alias("_old"))
    return decisions.join(old, KEY).where(~F.col("_old").eqNullSafe(F.col("decision"))).drop("_old")


def updated(decisions: DataFrame, blocks: DataFrame, updates: DataFrame) -> DataFrame:
    """decisions after updates (key columns, decision): invalid values and unknown blocks are ignored."""
    valid = updates.where(F.col("decision").isin(*BLOCK_DECISIONS)).join(blocks.select(*KEY), KEY, "left_semi")
    both = decisions.select(*KEY, "decision").withColumn("_v", F.lit(0)).unionByName(valid.select(*KEY, "decision").withColumn("_v", F.lit(1)))
    return latest(both, KEY, "_v").drop("_v")


def update(decisions: DataFrame, blocks: DataFrame, key: str, decision: str) -> tuple[DataFrame, bool]:
    """decisions after one update by key text, and whether it holds: an invalid value, a key that can't be read or names no
    block changes nothing and is False; what is decided so already changes nothing and is True."""
    spark = blocks.sparkSession
    asked = spark.range(1).select(parsed_key(F.lit(key)).alias("k"), F.lit(decision).alias("decision")).select("k.*", "decision")
    known = asked.where(F.col("decision").isin(*BLOCK_DECISIONS)).join(blocks.select(*KEY), KEY, "left_semi")
    return updated(decisions, blocks, asked), not known.isEmpty()


def decide_pair(pairs: DataFrame, result_id: str, decision: str) -> DataFrame:
    """The decision row of one pair (result_id, block_id_1, block_id_2, analysis_type), for an upsert by decision_id; none for
    an unknown pair or value."""
    rows = pairs.where((F.col("result_id") == result_id) & F.lit(decision).isin(*BLOCK_DECISIONS))
    return rows.select(F.col("result_id").alias("decision_id"), "block_id_1", "block_id_2", "analysis_type", F.lit(decision).alias("decision"))


def pair_review(pairs: DataFrame, decisions: DataFrame, blocks: DataFrame, number: int, size: int = 1) -> DataFrame:
    """A page (from 0) of pairs by falling score, with what is decided so far and a preview of both texts."""
    known = decisions.select(F.col("decision_id").alias("result_id"), "decision")
    shown = pairs.join(known, "result_id", "left").withColumn("decision", F.coalesce("decision", F.lit("undecided")))
    one = page(shown.withColumn("_o", -F.coalesce("score", F.lit(0.0))), ["_o", "result_id"], number, size)
    text = lambda k: blocks.select(F.col("block_id").alias(f"block_id_{k}"), preview(F.col("text")).alias(f"preview_{k}"))
    return one.join(text(1), "block_id_1", "left").join(text(2), "block_id_2", "left").orderBy("_o", "result_id").select("result_id", "block_id_1", "preview_1", "block_id_2", "preview_2", "score", "decision")


def decide(members: DataFrame, group: str, keep: tuple[int, ...] = (), delete: tuple[int, ...] = ()) -> DataFrame:
    """Updates for the members (by rank, from 1) of one group."""
    rows = ranked(members.where(F.col("h") == group)).where(F.col("rank").isin(*keep, *delete))
    return rows.select(*KEY, F.when(F.col("rank").isin(*keep), "keep").otherwise("delete").alias("decision"))


def delete_all_but_first(members: DataFrame, group: str | None = None) -> DataFrame:
    rows = members if group is None else members.where(F.col("h") == group)
    return rows.where("NOT first").select(*KEY, F.lit("delete").alias("decision"))


def pending(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Blocks that nothing, or only undecided, is decided for; a null decision decides nothing."""
    return blocks.join(decisions.where("decision IS NOT NULL AND decision <> 'undecided'").select(*KEY), KEY, "left_anti")


def undecided_pairs(results: DataFrame, decisions: DataFrame) -> DataFrame:
    """Results without a decision, or with one that says undecided, is empty or null."""
    decisive = decisions.where("decision IS NOT NULL AND decision NOT IN ('', 'undecided')")
    return results.join(decisive, results["result_id"] == decisive["decision_id"], "left_anti")


def page(rows: DataFrame, order: list[str], number: int, size: int = 1) -> DataFrame:
    """One page (from 0) of rows for review."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def status(blocks: DataFrame, members: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """One row of counts; blocks carry decision."""
    counts = blocks.agg(
        F.count("*").alias("blocks"),
        F.count_if(F.col("decision").isin("keep", "delete")).alias("decided"),
        F.count_if(F.col("decision") == "undecided").alias("undecided"),
    )
    groups = members.agg(F.count_if("first").alias("exact_groups"))
    out = counts.crossJoin(groups)  # one row by one row
    return out.withColumn("similar_pairs", F.lit(0).cast("long")) if pairs is None else out.crossJoin(pairs.agg(F.count("*").alias("similar_pairs")))


def keyed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("decision_key", decision_key(F.col("path"), F.col("block_id"), F.col("block_type")))


def numbered(members: DataFrame) -> DataFrame:
    """Groups in order of their first member, for paging."""
    return members.where("first").withColumn("group_no", F.row_number().over(Window.orderBy("path", "block_id")))
