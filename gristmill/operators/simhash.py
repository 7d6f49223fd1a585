"""Near-duplicate blocks by 64-bit SimHash (an extension that was only planned)."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fingerprints(blocks: DataFrame) -> DataFrame:
    """block_id, simhash of blocks: the sign of each bit's sum over the hashes of the words."""

    @F.pandas_udf("long")
    def signs(hashes: pd.Series) -> pd.Series:
        bits = np.arange(64, dtype=np.uint64)

        def one(h) -> int:
            if h is None or not len(h):
                return 0
            ones = ((np.asarray(h, np.int64).view(np.uint64)[:, None] >> bits) & np.uint64(1)).sum(0)
            value = (np.uint64(1) << bits)[2 * ones > len(h)].sum(dtype=np.uint64)
            return int(value.astype(np.int64))

        return hashes.map(one)

    words = F.filter(F.split(F.lower("text"), r"(?U)[\W_]+"), lambda w: w != "")
    return blocks.select("block_id", signs(F.transform(words, lambda w: F.xxhash64(w))).alias("simhash"))


def similar(prints: DataFrame, distance: int = 3) -> DataFrame:
    """simhash_1 < simhash_2, distance of different fingerprints within so many bits.

    Of twice as many parts as bits may differ, half agree at least, so pairs meet on each choice of half the parts (about 32
    bits, whatever the number of rows).  Blocks of one fingerprint are its members in `prints`, not pairs.
    """
    parts = 2 * max(1, distance)
    edges = [64 * k // parts for k in range(parts + 1)]
    each = prints.select("simhash").distinct()
    width = lambda k: edges[k + 1] - edges[k]
    part = lambda k: F.shiftrightunsigned("simhash", edges[k]).bitwiseAND(F.lit((1 << width(k)) - 1))
    joined = lambda chosen: reduce(lambda key, k: F.shiftleft(key, width(k)).bitwiseOR(part(k)), chosen[1:], part(chosen[0]))
    keys = F.array(*map(joined, combinations(range(parts), parts - max(1, distance))))
    keyed = each.select("simhash", F.posexplode(keys).alias("choice", "key"))
    # merged, as Spark takes the rows before they are multiplied for its measure of what a broadcast through the driver would be
    met = keyed.toDF("simhash_1", "choice", "key").hint("merge").join(keyed.toDF("simhash_2", "choice", "key"), ["choice", "key"]).where("simhash_1 < simhash_2")
    apart = F.bit_count(F.col("simhash_1").bitwiseXOR(F.col("simhash_2")))
    return met.select("simhash_1", "simhash_2", apart.alias("distance")).where(F.col("distance") <= distance).distinct()


def similar_blocks(prints: DataFrame, distance: int = 3) -> DataFrame:
    """block_id_1 < block_id_2, distance: a pair for each pair of similar() and of each fingerprint's first block with its others.

    Blocks of one fingerprint are told by pairs with their first, and fingerprints by their first blocks, so copies aren't
    expanded into all pairs and none is lost.
    """
    first = prints.groupBy("simhash").agg(F.min("block_id").alias("first"))
    copies = prints.join(first, "simhash").where("block_id <> first").select(F.col("first").alias("a"), F.col("block_id").alias("b"), F.lit(0).alias("distance"))
    near = similar(prints, distance).join(first.toDF("simhash_1", "a"), "simhash_1").join(first.toDF("simhash_2", "b"), "simhash_2").select("a", "b", "distance")
    return copies.unionByName(near).select(F.least("a", "b").alias("block_id_1"), F.greatest("a", "b").alias("block_id_2"), "distance").distinct()
