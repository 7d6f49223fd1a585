"""Where blocks went and what stands next to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import scratch


def _written(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    at = scratch(spark, "lineage")
    rows.write.parquet(at)
    return spark.read.schema(rows.schema).parquet(at)


def ends(pointers: DataFrame, key: str = "block_id", to: str = "merged_into") -> DataFrame:
    """key, root, hops: the end of the chain of pointers that begins at each row, and the pointers on the way.

    A row of a null key or pointer, or one that points to itself, has none and is left out, like the ends themselves; of
    several pointers of one key the least counts.  root and hops are null where a chain runs in a circle.  Each round every
    row takes over its target's pointer, so a chain of n takes log2(n) rounds: a shuffle join and a written table each, with
    one pointer a row at any time.  Targets that many rows share are split by AQE, as a target has one pointer itself.
    """
    kind = pointers.schema[key].dataType
    given = pointers.select(F.col(key).alias("id"), F.col(to).cast(kind).alias("to")).where("id IS NOT NULL AND to IS NOT NULL AND id <> to")
    now = _written(given.groupBy("id").agg(F.min("to").alias("to")).withColumn("hops", F.lit(1).cast("long")))
    n, reach = now.count(), 1
    while True:
        there = now.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("hops").alias("more"))
        moved = now.join(there, "to", "left")
        moved = moved.select("id", F.coalesce("further", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.col("further").isNotNull().alias("moved"))
        now = _written(moved)
        # chains without a circle are at their ends once the reach before this round was n
        if now.where("moved").isEmpty() or reach >= n:
            break
        reach, now = 2 * reach, now.drop("moved")
    end = lambda c: F.when(~F.col("moved"), F.col(c))
    return now.select(F.col("id").alias(key), end("to").alias("root"), end("hops").alias("hops"))


def neighbours(blocks: DataFrame) -> DataFrame:
    """file_id, block_id, prev_id, next_id by place in the file (ties by id); null at a file's ends."""
    w = Window.partitionBy("file_id").orderBy("pos", "block_id")
    return blocks.select("file_id", "block_id", F.lag("block_id").over(w).alias("prev_id"), F.lead("block_id").over(w).alias("next_id"))
