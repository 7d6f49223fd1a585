"""What the operators share: reading tables, the shared folder, written intermediate tables, distributed ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: The words of a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Parts in which a tallied array is put together.
CHUNKS = 64
_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; one of our own where that is unset and Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        sc = spark.sparkContext
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
        base = sc._jsc.sc().getCheckpointDir().get()
    return base.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def written(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there and an executor's loss costs nothing.

    The folder goes when the session ends.
    """
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/gristmill-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(out)
    frame = spark.read.schema(df.schema).parquet(out)
    frame.folder = path
    return frame


def discard(*frames: DataFrame | None) -> None:
    """Deletes what written() has written, once nothing that is yet to run reads it.

    Executors keep the shuffle files of finished plans until the driver collects its garbage, so that is done here too.
    """
    gone = [f for f in frames if f is not None and hasattr(f, "folder")]
    for f in gone:
        f.folder.getFileSystem(f.sparkSession._jsc.hadoopConfiguration()).delete(f.folder, True)
    if gone:
        gone[0].sparkSession._jvm.System.gc()


def _tidy(run: Callable) -> Callable:
    """run, giving its memory back at the end: workers outlive their tasks, and idle ones count too."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return tidied


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """df.mapInArrow(run, schema) with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidy(run), schema)


def slices(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches' rows, in parts of at most `most` bytes of the column (a longer value alone), so that what is made of a part is bounded."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            used = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, used + most, "right")))
            yield batch.slice(begin, end - begin)
            begin = end


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit hashes with their bits spread; changes h."""
    h ^= h >> _U(33)
    h *= _U(0xFF51AFD7ED558CCD)
    h ^= h >> _U(33)
    h *= _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


class WordHasher:
    """64-bit hashes of words in UTF-8: sums over their bytes of a value of the byte times a power of its place.

    separators: the bytes that aren't part of a word.  lower: whether A-Z count as a-z.
    """

    def __init__(self, separators: list[int], lower: bool = False):
        self.values = mixed(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
        if lower:
            self.values[65:91] = self.values[97:123]
        self.space = np.zeros(257, bool)
        self.space[separators] = True
        self.powers = np.ones(1, _U)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, start and size of each word of data, which begins and ends with a separator."""
        raw = np.frombuffer(data, np.uint8)
        space = self.space[raw]
        edges = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            return np.zeros(0, _U), starts, sizes
        if sizes.max() >= len(self.powers):
            self.powers = np.concatenate([[_U(1)], np.cumprod(np.full(int(sizes.max()) * 2, _U(0xA0761D6478BD642F)))])
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
        terms = self.values[raw[~space]] * self.powers[place]
        return mixed(np.add.reduceat(terms, first) + sizes.astype(_U)), starts, sizes


def tally(df: DataFrame, mark: Callable, size: int, kind, join=np.add) -> np.ndarray:
    """An array of fixed size gathered over all rows: mark(cells, batch) puts in a batch, join puts tasks' arrays together, by parts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size, kind)
        for batch in batches:
            mark(cells, batch)
        parts = [(k, x) for k, x in enumerate(np.split(cells, CHUNKS)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x.tobytes() for _, x in parts], pa.binary())], ["chunk", "cells"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(size // CHUNKS, kind)
        for x in group["cells"]:
            join(total, np.frombuffer(x.as_py(), kind), out=total)
        return pa.table({"chunk": group["chunk"][:1], "cells": pa.array([total.tobytes()], pa.binary())})

    shape = "chunk int, cells binary"
    out = np.zeros((CHUNKS, size // CHUNKS), kind)
    for r in map_arrow(df, count, shape).groupBy("chunk").applyInArrow(add, shape).collect():
        out[r["chunk"]] = np.frombuffer(r["cells"], kind)
    return out.ravel()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(a: Column) -> Column:
    """The array in turn in about as many parts as each has elements; none of an empty array."""
    width = F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(1)).cast("int")
    parts = let(width, lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / w).cast("int")), lambda b: F.slice(a, b * w + 1, w)))
    return F.when(F.size(a) > 0, parts).otherwise(F.slice(F.array(a), 1, 0))


def running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array of longs, what `step` (associative, with 0 neutral) makes of all before it, 0 at the first.

    A running value needs an array that grows, and each growth copies it: so parts of about the square root of the length
    are run through alone and then set one after the other, and the work grows with the power 1.5 of the length.
    """
    zero = F.array(F.lit(0).cast("long"))
    along = lambda a, of: F.aggregate(a, zero, lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), of(x)))))
    inner = let(values, lambda a: F.transform(_blocks(a), lambda part: along(part, lambda x: x)))
    shifted = lambda parts, first: F.transform(parts, lambda p, b: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: step(first[b], x)))
    return F.flatten(let(inner, lambda parts: let(along(parts, lambda p: F.element_at(p, -1)), lambda first: shifted(parts, first))))


def cut(text: Column, spans: Column) -> Column:
    """The parts of text in `spans` (an array of start, end in code points; sorted, without overlap), in turn.

    To find a place, text is read from its beginning; so it is first cut for about the square root of the spans at a time.
    """
    at = lambda s, start, end: F.substr(s, start + 1, end - start)
    pieces = lambda x: F.transform(_blocks(x["spans"]), lambda g: F.struct(g.alias("g"), at(x["text"], g[0]["start"], F.element_at(g, -1)["end"]).alias("piece")))
    small = lambda y: F.transform(y["g"], lambda s: at(y["piece"], s["start"] - y["g"][0]["start"], s["end"] - y["g"][0]["start"]))
    return F.flatten(F.transform(let(F.struct(text.alias("text"), spans.alias("spans")), pieces), small))


def running_total(df: DataFrame, keys: list[str], order: list[Column], chunk: Column, value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows of the same keys that come earlier.

    `chunk` must be the leading part of the order and bounded in number.  The sums of the chunks are taken first (with
    partial aggregation), so no task ever holds more than one chunk of a key, however many rows that key has.
    """
    rows = df.withColumn("_chunk", chunk).withColumn("_value", value)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.sum("_value").alias("_sum"))
        .withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
        .drop("_sum")
    )
    same = None
    for k in (*keys, "_chunk"):
        same = F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}")) if same is None else same & F.col(f"_l.{k}").eqNullSafe(F.col(f"_r.{k}"))
    inside = rows.withColumn("_inside", F.coalesce(F.sum("_value").over(within), F.lit(0)))
    joined = inside.alias("_l").join(starts.alias("_r"), same)
    return joined.select("_l.*", (F.col("_l._inside") + F.col("_r._before")).alias(name)).drop("_inside", "_chunk", "_value")
