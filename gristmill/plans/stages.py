"""Outputs of stages that stay valid while what they were made from stays the same."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def digest_of(rows: DataFrame, *columns: str) -> str:
    """A digest of rows' columns whatever their order: number, sum and exclusive or of two hashes of each row."""
    one, two = F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(one.cast("decimal(38,0)")).alias("sum"), F.bit_xor(two).alias("xor")).first()
    return f"{got['n']}.{got['sum']}.{got['xor']}"


class Stages:
    """A folder with an output for each stage and digest of what that was made from.

    An output is whole once Spark has put its _SUCCESS there.  Two writers of one output leave two copies that say the same,
    and an unfinished one is passed over, so nothing is locked, overwritten or renamed.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.ran: list[str] = []  # stages that had to run, in order
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _copy(self, folder: str) -> str | None:
        if not self.fs.exists(self.path(folder)):
            return None
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder)))
        return next((f"{folder}/{x}" for x in names if self.fs.exists(self.path(f"{folder}/{x}/_SUCCESS"))), None)

    def of(self, stage: str, made_from: dict, make: Callable[[], DataFrame]) -> tuple[DataFrame, str]:
        """The stage's output and its digest, which later stages name among what they are made from; made only if there is
        none.  made_from: whatever the output depends on, as JSON has it."""
        digest = hashlib.sha256(json.dumps({"stage": stage, **made_from}, sort_keys=True).encode()).hexdigest()[:32]
        folder = f"{self.base}/{stage}/{digest}"
        at = self._copy(folder)
        if at is None:
            self.ran.append(stage)
            at = f"{folder}/{uuid.uuid4().hex}"
            make().write.parquet(at)
        return self.spark.read.parquet(at), digest
