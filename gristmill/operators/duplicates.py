"""Exact duplicates of files and blocks, and what to do about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FENCE, fingerprint, one_of, strip
from ..schemas import BLOCK_DECISIONS

KEY = ["path", "block_id", "block_type"]


def file_groups(files: DataFrame, content: str = "content") -> DataFrame:
    """digest, size, n_files, paths (sorted) of each group of two or more files of equal content."""
    hashed = files.select("path", F.sha2(F.col(content), 256).alias("digest"), F.octet_length(content).cast("long").alias("size"))
    return hashed.groupBy("digest", "size").agg(F.count("*").alias("n_files"), F.sort_array(F.collect_list("path")).alias("paths")).where("n_files >= 2")


def file_group_heads(files: DataFrame, content: str = "content") -> DataFrame:
    """digest, size, n_files, first_path of each such group, by partial sums: no row holds a group's paths."""
    hashed = files.select("path", F.sha2(F.col(content), 256).alias("digest"), F.octet_length(content).cast("long").alias("size"))
    return hashed.groupBy("digest", "size").agg(F.count("*").alias("n_files"), F.min("path").alias("first_path")).where("n_files >= 2")


def unique_files(files: DataFrame, mode: str = "strict", min_size: int | None = None, max_size: int | None = None, content: str = "content") -> DataFrame:
    """Paths of files without a copy; strict leaves out every member of a group, keep_first all but the first path.

    Copies are counted, and the first path taken, by partial sums over (path, digest, size) alone, so contents don't move.
    Size bounds in bytes are off by default.  `functions.paths.by_parts` puts paths in order.
    """
    hashed = files.select("path", F.sha2(F.col(content), 256).alias("digest"), F.octet_length(content).cast("long").alias("size"))
    if min_size is not None:
        hashed = hashed.where(F.col("size") >= min_size)
    if max_size is not None:
        hashed = hashed.where(F.col("size") <= max_size)
    if mode == "keep_first":
        return hashed.groupBy("digest", "size").agg(F.min("path").alias("path")).select("path")
    if mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    return hashed.groupBy("digest", "size").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1").select("path")


def unknown_paths(groups: DataFrame, listing: DataFrame) -> DataFrame:
    """Paths of groups that the listing doesn't have."""
    return groups.select(F.explode("paths").alias("path")).join(listing.select("path"), "path", "left_anti")


def with_decisions(blocks: DataFrame, decisions: DataFrame) -> DataFrame:
    """blocks with `decision`: what was decided for the key, undecided where nothing, or nothing valid, was."""
    known = decisions.select(*KEY, F.col("decision").alias("_decision"))
    joined = blocks.join(known, KEY, "left")
    return joined.withColumn("decision", one_of(F.col("_decision"), BLOCK_DECISIONS, "undecided")).drop("_decision")


def skip_reason(decided: bool = True) -> Column:
    """Why a block takes no part in exact comparison; null if it does."""
    reason = F.when(F.col("block_type") == "heading", "heading").when(F.col("path").isNull(), "no_path")
    if decided:
        reason = reason.when(F.col("decision") == "delete", "deleted")
    return reason.when((F.col("block_type") == "code") & (strip(F.col("text")) == FENCE), "fence").when(F.col("text").isNull(), "no_text")


def _keyed(blocks: DataFrame) -> DataFrame:
    return blocks.where(skip_reason().isNull()).withColumn("h", fingerprint(F.col("block_type"), F.col("text")))


def group_heads(blocks: DataFrame) -> DataFrame:
    """h, n, path and block_id of the first member of each group of exact_groups(), by partial sums alone."""
    groups = _keyed(blocks).groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("path", "block_id")).alias("first"))
    return groups.where("n > 1").select("h", "n", "first.path", "first.block_id")


def exact_groups(blocks: DataFrame) -> DataFrame:
    """Members of groups of equal type and stripped text: blocks (with decision) with h, n and first.

    Sizes and first members come from an aggregation with partial sums over fingerprints and keys alone, and reach the
    blocks by a join, which is split where one text has very many copies.
    """
    keyed = _keyed(blocks)
    groups = group_heads(blocks).select("h", "n", F.struct("path", "block_id").alias("_first"))
    first = (F.col("path") == F.col("_first.path")) & (F.col("block_id") == F.col("_first.block_id"))
    return keyed.join(groups, "h").withColumn("first", first).drop("_first")


def ranked(members: DataFrame) -> DataFrame:
    """members with rank (from 1) by path and id in their group, for review."""
    return members.withColumn("rank", F.row_number().over(Window.partitionBy("h").orderBy("path", "block_id")).cast("long"))


def group_arrays(members: DataFrame) -> DataFrame:
    """h, n, members (sorted by path and id) of each group."""
    return members.groupBy("h").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("path", "block_id"))).alias("members"))


def suggestions(members: DataFrame) -> DataFrame:
    """Key and suggestion of group members: keep the first, delete the others that are undecided."""
    suggested = F.when(F.col("first"), "keep").when(F.col("decision") == "undecided", "delete")
    return members.withColumn("suggestion", suggested).where("suggestion IS NOT NULL").select(*KEY, "suggestion")


def applied(blocks: DataFrame, suggested: DataFrame) -> DataFrame:
    """blocks (with decision) after suggestions, which only settle what is undecided."""
    joined = blocks.join(suggested, KEY, "left")
    new = F.when((F.col("decision") == "undecided") & F.col("suggestion").isin("keep", "delete"), F.col("suggestion")).otherwise(F.col("decision"))
    return joined.withColumn("decision", new).drop("suggestion")
