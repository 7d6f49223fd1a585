"""Tables of files, blocks, results and decisions as Parquet segments under a log of versions."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import codecs, schemas
from .errors import EngineError
from .functions.text import one_of
from .operators.decisions import latest, undecided_pairs
from .operators.duplicates import KEY
from .shipping import scratch

_KEYS = {
    "files": (schemas.FILES, ["file_id"]),
    "blocks": (schemas.BLOCKS, ["file_id", "block_id"]),
    "results": (schemas.RESULTS, ["result_id"]),
    "pair_decisions": (schemas.PAIR_DECISIONS, ["decision_id"]),
    "block_decisions": (schemas.BLOCK_DECISION_TABLE, ["path", "block_id", "block_type"]),
}


_ENUMS = {
    "pair_decisions": {"decision": (schemas.BLOCK_DECISIONS, "undecided")},
    "block_decisions": {"decision": (schemas.BLOCK_DECISIONS, "undecided")},
}
#: Key ranges of a table (by a hash of its first key), and segments of a range from which on compact() merges them.
RANGES, SEGMENTS = 32, 8


class Log:
    """The versions of one table: a small JSON file each, which names the segments that it adds and those that it replaces.

    A segment is a folder of Parquet with a folder below for each key range that it has rows of.  A version counts once its
    file is in place, and putting it there fails if another writer has taken its number; so readers see whole versions only,
    and of two writers of one version one has to go on from the other's.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(base).getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, path) -> dict:
        stream = self.fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def entries(self) -> list[dict]:
        """The versions in order."""
        folder = self.path(f"{self.base}/log")
        if not self.fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in self.fs.listStatus(folder))
        return [self._read(self.path(folder, n)) for n in names if n.removesuffix(".json").isdigit()]

    def segments(self, entries: list[dict]) -> dict[int, list[str]]:
        """The segments of each key range after these versions, oldest first."""
        live: dict[int, list[str]] = {}
        for e in entries:
            for k in e["ranges"]:
                live[k] = ([] if e["replaces"] else live.get(k, [])) + [e["segment"]]
        return live

    def commit(self, entry: dict) -> bool:
        """Puts entry in as its version; False if that version is another writer's."""
        at = f"{self.base}/log/{entry['version']:020d}.json"
        draft = self.path(f"{self.base}/log/.{uuid.uuid4().hex}")
        out = self.fs.create(draft)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        jvm = self.spark._jvm
        try:
            if self.fs.getScheme() == "file":
                # a local rename would overwrite; a hard link fails if the name is there, in one step
                local = lambda p: jvm.java.nio.file.Paths.get(self.fs.makeQualified(p).toUri())
                jvm.java.nio.file.Files.createLink(local(self.path(at)), local(draft))
                return True
            return bool(self.fs.rename(draft, self.path(at)))  # false or an error if the name is there
        except Exception:
            if self.fs.exists(self.path(at)):
                return False
            raise
        finally:
            if self.fs.exists(draft):
                self.fs.delete(draft, False)


class Store:
    """Reads give DataFrames; writes are keyed upserts.  A write adds a segment with the rows that change and reads the key
    ranges that they are in, and no other; compact() merges the segments of ranges that have many."""

    def __init__(self, spark: SparkSession, base: str, ranges: int = RANGES):
        self.spark, self.base, self.ranges = spark, base.rstrip("/"), ranges

    def _log(self, name: str) -> Log:
        return Log(self.spark, f"{self.base}/{name}")

    def _range(self, name: str, entries: list[dict], key: Column | None = None) -> Column:
        """A row's key range; the number of ranges is what the table began with."""
        _, keys = _KEYS[name]
        n = entries[0]["of"] if entries else self.ranges
        return F.pmod(F.xxhash64(F.col(keys[0]) if key is None else key), F.lit(n)).cast("int")

    def _merged(self, name: str, live: dict[int, list[str]], columns: list[str] | None = None) -> DataFrame:
        """The rows of these segments, or some columns of them; of rows of one key that of the latest segment."""
        schema, keys = _KEYS[name]
        if columns is not None:  # what isn't asked for is not read, nor moved where segments are merged
            schema = T.StructType([f for f in schema if f.name in {*keys, *columns}])
        single = [f"{s[0]}/range={k}" for k, s in live.items() if len(s) == 1]
        parts = [self.spark.read.schema(schema).parquet(*single)] if single else []
        several = [[f"{s[i]}/range={k}" for k, s in live.items() if len(s) > 1 and i < len(s)] for i in range(max(map(len, live.values()), default=0))]
        steps = [self.spark.read.schema(schema).parquet(*paths).withColumn("_v", F.lit(i)) for i, paths in enumerate(several) if paths]
        if steps:
            rows = steps[0]
            for s in steps[1:]:
                rows = rows.unionByName(s)
            parts.append(latest(rows, keys, "_v").select(*(f.name for f in schema)))
        out = parts[0] if parts else self.spark.createDataFrame([], schema)
        return out.unionByName(parts[1]) if len(parts) > 1 else out

    def read(self, name: str, version: int | None = None, key: str | None = None) -> DataFrame:
        """The table's latest version, or an earlier one, or the key range of one value of its first key; empty if there is none."""
        log = self._log(name)
        entries = log.entries()
        live = log.segments(entries if version is None else [e for e in entries if e["version"] <= version])
        if key is not None and entries:
            k = self.spark.range(1).select(self._range(name, entries, F.lit(key))).first()[0]
            live = {k: live[k]} if k in live else {}
        return self._merged(name, live)

    def history(self, name: str) -> DataFrame:
        """version, operation, ranges (number of them), rows of each version."""
        rows = [(e["version"], e["operation"], len(e["ranges"]), e["rows"]) for e in self._log(name).entries()]
        return self.spark.createDataFrame(rows, "version int, operation string, ranges int, rows bigint")

    def _segment(self, name: str, rows: DataFrame, of: Column) -> tuple[str, list[int], int]:
        """A written segment: its folder, its ranges and its number of rows."""
        folder = f"{self.base}/{name}/data/{uuid.uuid4().hex}"
        rows.withColumn("range", of).write.partitionBy("range").parquet(folder)
        log = self._log(name)
        names = [s.getPath().getName() for s in log.fs.listStatus(log.path(folder))]
        found = sorted(int(n.removeprefix("range=")) for n in names if n.startswith("range="))
        return folder, found, self.spark.read.parquet(folder).count() if found else 0

    def upsert(self, name: str, rows: DataFrame, attempts: int = 20) -> bool:
        """Puts rows in by key; of rows with equal key the new one stays.  False, and no version made, if nothing changes.

        Rows without a key part are left out.  Of rows of one key among the new ones, that of the greatest values stays.  If
        another writer has been quicker, the same is done again on top of what it wrote, where that is in the same ranges.
        """
        schema, keys = _KEYS[name]
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
        for k in keys:
            rows = rows.where(F.col(k).isNotNull() & (F.col(k) != ""))
        return self._put(name, rows, attempts)

    def _put(self, name: str, rows: DataFrame, attempts: int = 20, seen: int | None = None, whole: bool = False) -> bool:
        """upsert() of rows with full keys.  seen: the number of versions on top of which they are all of different keys and
        none is stored as it is; whole: and all that their key ranges have."""
        schema, keys = _KEYS[name]
        values = [c.name for c in schema if c.name not in keys]
        json_of = lambda: F.to_json(F.struct(*values))
        digest = lambda d: d.select(*keys, F.sha2(json_of(), 256).alias("_digest"))
        log = self._log(name)
        for _ in range(attempts):
            entries = log.entries()
            of, live = self._range(name, entries), log.segments(entries)
            known = seen == len(entries)
            # hashes of keys tell whether one comes twice (or might); only then whole rows have to move for it
            times = rows.select(of.alias("k"), F.xxhash64(*keys).alias("h")).groupBy("k", "h").agg(F.count("*").alias("n"))
            found = times.groupBy("k").agg(F.max("n").alias("n")).collect()  # at most as many as there are ranges
            touched = [r["k"] for r in found]
            new = rows
            if any(r["n"] > 1 for r in found):
                new = latest(rows.withColumn("_v", json_of()), keys, "_v").select(*(f.name for f in schema))
            stored = {k: live[k] for k in touched if k in live}
            if stored and not known:
                new = new.withColumn("_digest", F.sha2(json_of(), 256)).join(digest(self._merged(name, stored)), [*keys, "_digest"], "left_anti").drop("_digest")
            folder, found, count = self._segment(name, new, of)
            if not found:
                log.fs.delete(log.path(folder), True)
                return False
            while True:
                version = (entries[-1]["version"] if entries else 0) + 1
                if log.commit({"version": version, "operation": "upsert", "segment": folder, "ranges": found, "replaces": known and whole, "rows": count, "of": entries[0]["of"] if entries else self.ranges}):
                    return True
                now = log.entries()
                theirs = {k for e in now[len(entries) :] for k in e["ranges"]}
                again = not entries or theirs & set(touched)
                entries = now
                if again:
                    break
            log.fs.delete(log.path(folder), True)
        raise EngineError(f"other writers were quicker {attempts} times", "UNEXPECTED_ERROR", {"table": name})

    def compact(self, name: str, segments: int = SEGMENTS) -> bool:
        """Merges the segments of each key range that has so many or more; False if there is none, or another writer was quicker
        in one of them."""
        log = self._log(name)
        entries = log.entries()
        many = {k: s for k, s in log.segments(entries).items() if len(s) >= max(2, segments)}
        if not many:
            return False
        folder, found, count = self._segment(name, self._merged(name, many), self._range(name, entries))
        seen = len(entries)
        while not log.commit({"version": entries[-1]["version"] + 1, "operation": "compact", "segment": folder, "ranges": found, "replaces": True, "rows": count, "of": entries[0]["of"]}):
            entries = log.entries()
            if {k for e in entries[seen:] for k in e["ranges"]} & set(many):
                log.fs.delete(log.path(folder), True)
                return False
        return True

    def vacuum(self, name: str) -> int:
        """Deletes the segments that the latest version reads nothing of, and says how many; earlier versions can't be read then."""
        log = self._log(name)
        entries = log.entries()
        live = {s for of in log.segments(entries).values() for s in of}
        gone = [e["segment"] for e in entries if e["segment"] not in live and log.fs.exists(log.path(e["segment"]))]
        for s in gone:
            log.fs.delete(log.path(s), True)
        return len(gone)

    def register_files(self, files: DataFrame) -> DataFrame:
        """file_id of each path, the known one or one made from the path; new paths are added."""
        new = files.select("path").distinct().join(self.read("files").select("path"), "path", "left_anti")
        self.upsert("files", new.select(F.md5("path").alias("file_id"), "path", F.current_timestamp().alias("registered_at"), F.create_map().cast("map<string,string>").alias("metadata")))
        return self.read("files").select("file_id", "path")

    def load_json(self, name: str, path: str) -> DataFrame:
        """The table's records in a JSON file: an array of objects, or an object of them by id.

        A missing or empty file gives no rows.  One that isn't such JSON is renamed, with .corrupt and the time behind its
        name, and gives no rows either, as a missing one does from then on.  Values of unknown enumerations become their default.
        """
        schema, keys = _KEYS[name]
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        at = hadoop.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        none = self.spark.createDataFrame([], schema)
        if not fs.exists(at) or not fs.getFileStatus(at).getLen():
            return none
        whole = self.spark.read.text(path, wholetext=True)
        record = T.StructType(list(schema.fields))
        listed, named = F.from_json("value", T.ArrayType(record)), F.map_values(F.from_json("value", T.MapType(T.StringType(), record)))
        begins = F.substring(F.ltrim("value"), 1, 1)
        parsed = whole.select(F.trim("value").alias("value"), F.when(begins == "[", listed).when(begins == "{", named).alias("rows"))
        if not parsed.where((F.col("value") != "") & (F.col("rows").isNull() | F.expr("try_parse_json(value) IS NULL"))).isEmpty():
            fs.rename(at, hadoop.Path(f"{path}.corrupt.{datetime.now():%Y%m%d%H%M%S}"))
            return none
        rows = parsed.select(F.explode("rows").alias("r")).select("r.*")
        for c, (values, default) in _ENUMS.get(name, {}).items():
            rows = rows.withColumn(c, one_of(F.col(c), values, default))
        for k in keys:
            rows = rows.where(F.col(k).isNotNull() & (F.col(k) != ""))
        return rows

    def load_records(self, name: str, records: DataFrame, column: str = "value") -> dict[str, int]:
        """Puts JSON records (codecs.decoded()) in by key and says how many were accepted and rejected.

        Rejected ones, with the reason, are added to what rejects() has of the table, before the others are put in.
        """
        at = scratch(self.spark, "records")
        codecs.decoded(records, name, column=column).write.parquet(at)  # parsed once, and of one time
        rows = self.spark.read.parquet(at)
        counts = {r["bad"]: r["count"] for r in rows.groupBy(F.col("reject").isNotNull().alias("bad")).count().collect()}
        if counts.get(True):
            codecs.rejected(rows).withColumn("rejected_at", F.current_timestamp()).write.mode("append").parquet(f"{self.base}/{name}/rejects")
        self.upsert(name, codecs.accepted(rows, name))
        return {"accepted": counts.get(False, 0), "rejected": counts.get(True, 0)}

    def rejects(self, name: str) -> DataFrame:
        """reject, record, rejected_at of every record that load_records() has rejected for the table."""
        log = self._log(name)
        schema = "reject string, record string, rejected_at timestamp"
        if not log.fs.exists(log.path(f"{self.base}/{name}/rejects")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.base}/{name}/rejects")

    def block_decisions(self) -> DataFrame:
        """path, block_id, block_type, decision of every stored block with a path, as its metadata has it; undecided where that
        has none or no known one."""
        status = one_of(F.element_at("metadata", schemas.STATUS_KEY), schemas.BLOCK_DECISIONS, "undecided")
        log = self._log("blocks")
        rows = self._merged("blocks", log.segments(log.entries()), [*KEY, "metadata"])
        return rows.where("path <> ''").select(*KEY, status.alias("decision"))

    def save_block_decisions(self, decisions: DataFrame) -> dict[str, int]:
        """Puts decisions (path, block_id, block_type, decision) into the metadata of their blocks, file by file.

        Only key ranges of files with decisions are read, found by the table of files, and only those with a changed block are
        written; segments of others stay as they are, and where every block changes the new segment replaces the old.  Returns the number of decisions that are valid, of blocks that changed,
        of files that these are in, and of valid decisions that no stored block has.  Of several for one block the greatest in
        order of text stays; invalid ones and ones without a full key are left out.
        """
        valid = decisions.where(F.col("decision").isin(*schemas.BLOCK_DECISIONS))
        for k in KEY:
            valid = valid.where(F.col(k).isNotNull())

        def kept(rows: DataFrame, label: str) -> DataFrame:
            at = scratch(self.spark, label)
            rows.write.parquet(at)
            return self.spark.read.schema(rows.schema).parquet(at)

        asked = kept(valid.groupBy(*KEY).agg(F.max("decision").alias("_new")), "asked")
        touched = asked.select("path").distinct().join(self.read("files").select("file_id", "path"), "path").select("file_id").distinct()
        entries = self._log("blocks").entries()
        live = self._log("blocks").segments(entries)
        ranges = [r[0] for r in touched.select(self._range("blocks", entries).alias("k")).distinct().collect()]  # at most as many as there are ranges
        live = {k: live[k] for k in ranges if k in live}
        _, keys = _KEYS["blocks"]
        # first by keys and metadata alone; whole rows are read for those that change
        status = lambda: F.element_at("metadata", schemas.STATUS_KEY)
        differs = (~status().eqNullSafe(F.col("_new"))).alias("differs")
        known = kept(self._merged("blocks", live, [*KEY, "metadata"]).join(asked, KEY).select(*keys, "_new", differs), "decided")
        one = F.lit(1)
        n = known.agg(F.count(one).alias("known"), F.count_if("differs").alias("saved"), F.count_distinct(F.when(F.col("differs"), F.col("file_id"))).alias("files")).first()
        valid = asked.count()
        if n["saved"]:
            stored = self._merged("blocks", live)
            whole = all(len(s) == 1 for s in live.values()) and stored.count() == n["saved"]
            others = F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, _: k != schemas.STATUS_KEY)
            changed = stored.join(known.where("differs").select(*keys, "_new"), keys)
            changed = changed.withColumn("metadata", F.map_concat(others, F.create_map(F.lit(schemas.STATUS_KEY), F.col("_new"))))
            self._put("blocks", changed.select(*(f.name for f in schemas.BLOCKS)), seen=len(entries), whole=whole)
        return {"valid": valid, "saved": n["saved"], "files": n["files"], "unknown": valid - n["known"]}

    def file(self, file_id: str) -> DataFrame:
        return self.read("files", key=file_id).where(F.col("file_id") == file_id)

    def block(self, block_id: str) -> DataFrame:
        return self.read("blocks").where(F.col("block_id") == block_id)

    def blocks_by_file(self, file_id: str) -> DataFrame:
        return self.read("blocks", key=file_id).where(F.col("file_id") == file_id).orderBy("pos")

    def blocks(self, **criteria) -> DataFrame:
        return matching(self.read("blocks"), criteria, ("file_id", "block_type"))

    def save_results(self, analysis_type: str, results: DataFrame) -> bool:
        return self.upsert("results", results.where(F.col("analysis_type") == analysis_type))

    def results(self, analysis_type: str, **criteria) -> DataFrame:
        return results_matching(self.read("results"), analysis_type, **criteria)

    def decisions(self, **criteria) -> DataFrame:
        return decisions_matching(self.read("pair_decisions"), **criteria)

    def undecided(self, analysis_type: str) -> DataFrame:
        return undecided_pairs(self.results(analysis_type), self.read("pair_decisions"))


def matching(rows: DataFrame, criteria: dict, known: tuple[str, ...]) -> DataFrame:
    """Rows that equal all known criteria; others are ignored."""
    for k, v in criteria.items():
        if k in known and v is not None:
            rows = rows.where(F.col(k) == v)
    return rows


def results_matching(results: DataFrame, analysis_type: str, min_score: float | None = None, block_id: str | None = None) -> DataFrame:
    out = results.where(F.col("analysis_type") == analysis_type)
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    if block_id is not None:
        out = out.where((F.col("block_id_1") == block_id) | (F.col("block_id_2") == block_id))
    return out


def decisions_matching(decisions: DataFrame, block_id: str | None = None, **criteria) -> DataFrame:
    out = matching(decisions, criteria, ("analysis_type", "decision", "decision_id"))
    return out if block_id is None else out.where((F.col("block_id_1") == block_id) | (F.col("block_id_2") == block_id))
