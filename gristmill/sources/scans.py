"""Scans of folders that are remembered: what has not changed since is not read again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MARKDOWN_SUFFIXES
from ..shipping import ship
from .files import listing

LOG = "root string, scanned_at timestamp, path string, size bigint, modified timestamp, digest string, day date"
#: Bytes of a file that are read at once.
CHUNK = 1 << 20


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, state (new, gone, changed, unchanged) of the files of two listings (path, size, modified).

    A file is unchanged if size and time of its last change are.  A path that a listing has repeatedly counts once, by its
    latest time, then its greatest size; rows of a null path are left out.
    """
    one = lambda files: files.where("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("modified", "size")).alias("now"))
    both = one(before).withColumnRenamed("now", "old").join(one(after), "path", "full")
    state = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "gone").when(F.col("old").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return both.select("path", state.alias("state"))


def latest_scans(log: DataFrame, now: Column, seconds: int) -> DataFrame:
    """The rows (of LOG) of each root's latest scan, of those that are no older than so many seconds before now."""
    fresh = log.where((F.col("scanned_at") <= now) & (F.col("scanned_at") >= now - F.make_dt_interval(secs=F.lit(seconds))))
    last = fresh.groupBy("root").agg(F.max("scanned_at").alias("scanned_at"))
    return fresh.join(last, ["root", "scanned_at"], "left_semi").select(*log.columns)


def copies(scan: DataFrame, path: str | None = None) -> DataFrame:
    """path, digest, size, n_files of the files of a scan that have copies, or of the group of one path."""
    files = scan.where("path IS NOT NULL AND digest IS NOT NULL")
    groups = files.groupBy("digest", "size").agg(F.count("*").alias("n_files")).where("n_files > 1")
    if path is not None:
        groups = groups.join(files.where(F.col("path") == path).select("digest", "size"), ["digest", "size"], "left_semi")
    return files.join(groups, ["digest", "size"]).select("path", "digest", "size", "n_files")


def digests(files: DataFrame) -> DataFrame:
    """files (path and other columns) with the SHA-256 of what is in them, read in parts of bounded size where the rows are;
    null for a file that is gone or can't be read by then."""

    def read(path: str) -> str | None:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        out = hashlib.sha256()
        try:
            with where.open_input_stream(at) as f:
                while part := f.read(CHUNK):
                    out.update(part)
        except OSError:
            return None
        return out.hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(digest=f["path"].map(read).astype(object))

    ship(files.sparkSession)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInPandas(run, f"{shape}, digest string")


class ScanLog:
    """Scans as rows of LOG in a Parquet folder, one folder below for each day; days go after `days`, a scan is fresh for
    `seconds`.  Times are in UTC; the session's time zone has to be."""

    def __init__(self, spark: SparkSession, base: str, seconds: int = 3600, days: int = 30):
        self.spark, self.base, self.seconds, self.days = spark, base.rstrip("/"), seconds, days

    def rows(self, since: datetime | None = None) -> DataFrame:
        """The log, or the days of it from that time on."""
        try:
            log = self.spark.read.schema(LOG).parquet(self.base)
        except AnalysisException:
            log = self.spark.createDataFrame([], LOG)
        return log if since is None else log.where(F.col("day") >= F.lit(since.date()))

    def _at(self, now: datetime | None) -> datetime:
        return (now or datetime.now(timezone.utc)).replace(tzinfo=None)

    def recent(self, root: str, now: datetime | None = None) -> DataFrame:
        """The latest fresh scan of the root; no rows if there is none.  A scan has a row of a null path, also if it found nothing."""
        now = self._at(now)
        log = self.rows(now - timedelta(seconds=self.seconds)).where(F.col("root") == root)
        return latest_scans(log, F.lit(now), self.seconds)

    def scan(self, root: str, suffixes: tuple[str, ...] = MARKDOWN_SUFFIXES, recursive: bool = True, now: datetime | None = None, fresh: bool = True) -> DataFrame:
        """root, scanned_at, path, size, modified, digest of the folder's files.

        With fresh, a fresh scan is given as it is.  Else the folder is listed, and files that are new or have changed since the
        last scan are read; the others keep their digest.
        """
        now = self._at(now)
        if fresh:
            found = self.recent(root, now)
            if not found.isEmpty():
                return found.where("path IS NOT NULL").drop("day")
        seen = listing(self.spark, root, suffixes, recursive).select("path", "size", "modified")
        before = latest_scans(self.rows(now - timedelta(days=self.days)).where(F.col("root") == root), F.lit(now), self.days * 86_400)
        known = before.where("path IS NOT NULL AND digest IS NOT NULL").select("path", "size", "modified", "digest").dropDuplicates(["path", "size", "modified"])
        files = seen.join(known, ["path", "size", "modified"], "left")
        read = digests(files.where("digest IS NULL").select("path", "size", "modified"))
        mark = self.spark.range(1).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("digest"))
        rows = files.where("digest IS NOT NULL").select("path", "size", "modified", "digest").unionByName(read).unionByName(mark)
        out = rows.select(F.lit(root).alias("root"), F.lit(now).alias("scanned_at"), "path", "size", "modified", "digest", F.lit(now.date()).alias("day"))
        out.write.mode("append").partitionBy("day").parquet(self.base)
        done = self.rows(now).where((F.col("root") == root) & (F.col("scanned_at") == F.lit(now)) & F.col("path").isNotNull())
        return done.drop("day")

    def expire(self, now: datetime | None = None) -> int:
        """Deletes days that are over, and says how many."""
        first = (self._at(now) - timedelta(days=self.days)).date().isoformat()
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self.base)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        days = [s.getPath() for s in fs.listStatus(top)] if fs.exists(top) else []
        gone = [p for p in days if p.getName().startswith("day=") and p.getName() < f"day={first}"]
        for p in gone:
            fs.delete(p, True)
        return len(gone)
