"""Similar blocks by the cosine of their vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError
from ..shipping import ship
from ..schemas import SIMILARITY_THRESHOLD
from .encoding import Encoder, Loader, encoded

#: Rows of a block of the pair matrix at least, and at most; in between, blocks' number and so the copies of each vector stay the same.
BLOCK, BLOCKS, LARGEST = 4096, 16, 1 << 16
#: Rows of the tile of the pair matrix that a task computes at once.
TILE = 2048
#: Vectors that others are measured by, and numbers of axes at which their product is bounded.
PIVOTS, DEPTHS = 64, (1, 2, 4, 8, 16, 32)


def clamped(threshold: float) -> float:
    return min(1.0, max(0.0, threshold))


def load_encoder(name: str) -> Encoder:
    """The function that "module:function" names; it takes a list of texts and gives an array of vectors."""
    import importlib

    module, _, function = name.partition(":")
    try:
        found = getattr(importlib.import_module(module), function)
    except (ImportError, AttributeError, ValueError) as e:
        raise EngineError(f"no encoder {name!r}", "MODEL_LOADING_ERROR") from e
    if not callable(found):
        raise EngineError(f"{name!r} can't be called", "MODEL_LOADING_ERROR")
    return found


def hashing_encoder(texts: list[str], dimensions: int = 64) -> np.ndarray:
    """Deterministic vectors of hashed words for tests; they know nothing of meaning."""
    import zlib

    out = np.zeros((len(texts), dimensions))
    for i, t in enumerate(texts):
        for w in t.lower().split():
            out[i, zlib.crc32(w.encode()) % dimensions] += 1
    return out


def eligible(blocks: DataFrame) -> DataFrame:
    """Blocks (with decision) that take part: no headings, none without a path, none deleted."""
    return blocks.where("block_type <> 'heading' AND path IS NOT NULL AND decision <> 'delete'")


def encoded_texts(blocks: DataFrame, encoder: Encoder | Loader, batch: int = 32, cache: DataFrame | None = None) -> DataFrame:
    """text_md5, embedding of each distinct text that isn't in the cache (same columns), together with the cache; texts that
    the encoder fails on have an empty embedding (encoding.encoded() says why)."""
    return encoded(blocks, encoder, batch, cache).select("text_md5", "embedding")


def with_vectors(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """blocks with embedding; an empty or unknown text has an empty one."""
    joined = blocks.withColumn("text_md5", F.md5("text")).join(vectors, "text_md5", "left").drop("text_md5")
    return joined.withColumn("embedding", F.coalesce("embedding", F.array().cast("array<double>")))


def _unit(v: list[np.ndarray] | pd.Series) -> np.ndarray:
    m = np.stack(list(v)).astype(np.float64)
    m = m / np.maximum(np.abs(m).max(1, keepdims=True), 1e-300)  # so that no square overflows or vanishes
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-12)


class Space:
    """What vectors of one number of components are measured by: a few of them as pivots, and directions drawn from these."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = pivots
        self.axes = np.linalg.svd(pivots, full_matrices=False)[2]
        self.depths = [k for k in (0, *DEPTHS) if k < len(self.axes)] + [len(self.axes)]

    def cells(self, u: np.ndarray) -> np.ndarray:
        """The nearest pivot of each."""
        return (u @ self.pivots.T).argmax(1)

    def measures(self, u: np.ndarray) -> np.ndarray:
        """Angles to the pivots, places along the axes, and lengths of what the first axes leave, for each depth."""
        along = u @ self.axes.T
        left = np.cumsum(np.concatenate([np.zeros((len(u), 1)), along * along], axis=1), axis=1)[:, self.depths]
        return np.concatenate([np.arccos(np.clip(u @ self.pivots.T, -1, 1)), along, np.sqrt(np.maximum((u * u).sum(1, keepdims=True) - left, 0))], axis=1)

    def bound(self, low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> float:
        """No cosine between vectors of two cells, given the range of each measure, is larger.

        The angle of two vectors is at least the difference of their angles to any pivot; and their product is at most what
        it can be along the first axes, and the product of the lengths of the rest.
        """
        p, k = len(self.pivots), len(self.axes)
        gap = max(0.0, float(np.maximum(low[:p] - other_high[:p], other_low[:p] - high[:p]).max()))
        a, b, c, d = low[p : p + k], high[p : p + k], other_low[p : p + k], other_high[p : p + k]
        along = np.concatenate([[0.0], np.cumsum(np.maximum.reduce([a * c, a * d, b * c, b * d]))])[self.depths]
        return min(float(np.cos(min(gap, np.pi))), float((along + high[p + k :] * other_high[p + k :]).min()))


@dataclass
class Blocks:
    """How the pair matrix is cut: cells (number of components, pivot), each in blocks of bounded size, and which cells meet.

    Vectors of a number of components that no pivot has are in the one cell (0, 0), which meets itself only.
    """

    spaces: dict[int, Space]
    first: dict[tuple[int, int], int]  # a cell's first block
    many: dict[tuple[int, int], int]  # and its number of blocks
    meets: dict[tuple[int, int], list[tuple[int, int]]]  # cells that a cell meets, itself included

    def cells(self, v: list) -> list[tuple[int, int]]:
        """The cell of each vector."""
        out = [(0, 0)] * len(v)
        sizes = np.array([len(x) for x in v])
        for size in set(sizes.tolist()) & set(self.spaces):
            of = np.flatnonzero(sizes == size)
            for i, c in zip(of.tolist(), self.spaces[size].cells(_unit([v[i] for i in of])).tolist(), strict=True):
                out[i] = (size, c)
        return out

    def partners(self, cell: tuple[int, int], block: int, left: bool) -> list[int]:
        """Blocks whose numbers are no smaller (left) or no larger than a block's, of the cells that its cell meets."""
        every = (b for c in self.meets[cell] for b in range(self.first[c], self.first[c] + self.many[c]))
        return [b for b in every if (b >= block if left else b <= block)]

    def counts(self) -> tuple[int, int]:
        """Pairs of blocks that meet, and all pairs of blocks."""
        n = sum(self.many.values())
        met = sum(self.many[a] * self.many[b] for a in self.meets for b in self.meets[a] if self.first[a] < self.first[b])
        return met + sum(k * (k + 1) // 2 for k in self.many.values()), n * (n + 1) // 2


def usable(vectors: DataFrame, key: str) -> DataFrame:
    """id, v of vectors that take part: not null or empty, no component null or non-finite, and a key.  Floats stay floats, at
    half the bytes; they are computed with as doubles."""
    kept = isinstance(getattr(vectors.schema["embedding"].dataType, "elementType", None), T.FloatType)
    vector = F.col("embedding") if kept else F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where((F.size("embedding") > 0) & ~bad & F.col(key).isNotNull()).select(F.col(key).alias("id"), vector.alias("v"))


def planned(rows: DataFrame, threshold: float, pivots: int = PIVOTS, block: int = BLOCK) -> Blocks:
    """Blocks of rows (id, v) and which of them may hold a pair that reaches the threshold; at most `pivots` rows and as many
    sums reach the driver.  There are about two pivots for each block's rows, and none if all fit into one block."""
    ship(rows.sparkSession)
    n = -(-rows.count() // block)
    if n <= 1:
        return Blocks({}, {(0, 0): 0}, {(0, 0): 1}, {(0, 0): [(0, 0)]})
    pivots = min(pivots, 2 * n)
    chosen = rows.select("v").orderBy(F.xxhash64(F.lit("pivot"), "id"), "v").limit(pivots).collect()
    by_size: dict[int, list] = {}
    for r in chosen:
        by_size.setdefault(len(r["v"]), []).append(np.array(r["v"]))
    plan = Blocks({n: Space(_unit(v)) for n, v in by_size.items()}, {}, {}, {})

    def ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low: dict[tuple[int, int], np.ndarray] = {}
        high: dict[tuple[int, int], np.ndarray] = {}
        count: Counter = Counter()
        for f in frames:
            v = f["v"].tolist()
            cells = plan.cells(v)
            count.update(cells)
            for size, space in plan.spaces.items():
                of = [i for i, c in enumerate(cells) if c[0] == size]
                if of:
                    measures, own = space.measures(_unit([v[i] for i in of])), np.array([cells[i][1] for i in of])
                    for c in set(own.tolist()):
                        m, at = measures[own == c], (size, c)
                        low[at] = np.minimum(low[at], m.min(0)) if at in low else m.min(0)
                        high[at] = np.maximum(high[at], m.max(0)) if at in high else m.max(0)
        rows = [(*at, n, low[at].tolist() if at in low else [], high[at].tolist() if at in high else []) for at, n in count.items()]
        yield pd.DataFrame(rows, columns=["size", "cell", "n", "low", "high"])

    parts = rows.select("v").mapInPandas(ranges, "size int, cell int, n long, low array<double>, high array<double>")
    extreme = lambda f, c: F.transform(F.sequence(F.lit(0), F.size(F.first(c)) - 1), lambda k: f(F.transform(F.collect_list(c), lambda x: x[k])))
    whole = F.size(F.first("low")) > 0
    none = F.array().cast("array<double>")
    merged = parts.withColumn("part", F.spark_partition_id() % 64)
    for keys in (["size", "cell", "part"], ["size", "cell"]):  # in two steps, as tasks may be many
        merged = merged.groupBy(*keys).agg(F.sum("n").alias("n"), F.when(whole, extreme(F.array_min, "low")).otherwise(none).alias("low"), F.when(whole, extreme(F.array_max, "high")).otherwise(none).alias("high"))
    found = {(r["size"], r["cell"]): r for r in merged.collect()}
    for cell, r in sorted(found.items()):
        plan.first[cell] = sum(plan.many.values())
        plan.many[cell] = -(-r["n"] // block)
    as_array = {c: (np.array(r["low"]), np.array(r["high"])) for c, r in found.items()}
    for a in found:
        plan.meets[a] = [b for b in found if a == b or (a[0] == b[0] and a[0] and plan.spaces[a[0]].bound(*as_array[a], *as_array[b]) >= threshold - 1e-9)]
    return plan


def block_rows(n: int) -> int:
    """Rows of a block for n vectors: each vector travels to all blocks that its own meets, so their number must not grow with n,
    until blocks are as large as a task may hold."""
    return min(LARGEST, max(BLOCK, -(-n // BLOCKS)))


def similar_pairs(vectors: DataFrame, threshold: float = SIMILARITY_THRESHOLD, key: str = "block_id", block: int | None = None) -> DataFrame:
    """id_1 < id_2 and score of every pair whose cosine reaches the threshold, computed in double precision.

    vectors: `key` and embedding; null and empty vectors, those with a null or non-finite component and rows of a null key
    take no part, and only vectors of as many components are compared.  Vectors are put into cells by their nearest pivot and
    a cell into blocks of at most about `block` rows; cells whose bounds stay below the threshold never meet, and every other
    pair of blocks is computed in one task as matrix products of its tiles: exact, and bounded in memory whatever the number of
    rows.  Unless `block` is given, blocks grow with the rows (block_rows()).
    Vectors without any cluster structure can't be told apart by such bounds; then all blocks meet.
    """
    rows = usable(vectors, key)
    kind = rows.schema["id"].dataType
    plan = planned(rows, threshold, block=block_rows(rows.count()) if block is None else block)
    ship(vectors.sparkSession)

    def dealt(left: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = plan.cells(batch.column("v").to_pylist())
                groups: dict[tuple, list[int]] = {}
                for i, (c, h) in enumerate(zip(cells, batch.column("hash").to_pylist(), strict=True)):
                    groups.setdefault((c, plan.first[c] + h % plan.many[c]), []).append(i)
                for (c, b), of in groups.items():
                    part = batch.take(pa.array(of))
                    n = part.num_rows
                    for other in plan.partners(c, b, left):
                        i, j = (b, other) if left else (other, b)
                        yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.array(np.full(n, left)), pa.array(np.full(n, i, np.int64)), pa.array(np.full(n, j, np.int64))], shape.names)

        return rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("hash")).mapInArrow(run, shape)

    shape = T.StructType([T.StructField("id", kind), T.StructField("v", rows.schema["v"].dataType), T.StructField("left", T.BooleanType()), T.StructField("i", T.LongType()), T.StructField("j", T.LongType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # a block pair's vectors by side and number of components; its pairs leave tile by tile, as they may be far more
        sides: dict[tuple[bool, int], tuple[list, list]] = {}
        square = None
        for f in batches:
            square = f["i"].iloc[0] == f["j"].iloc[0] if len(f) else square
            for (side, n), of in f.groupby([f["left"], f["v"].map(len)]):
                ids, units = sides.setdefault((bool(side), int(n)), ([], []))
                ids.append(of["id"].to_numpy())
                units.append(_unit(of["v"]))
        for n in sorted({n for _, n in sides}):
            if (True, n) in sides and (False, n) in sides:
                (left, u), (right, w) = ((np.concatenate(x) for x in sides[side, n]) for side in (True, False))
                for x, y in product(range(0, len(u), TILE), range(0, len(w), TILE)):
                    yield met(left[x : x + TILE], u[x : x + TILE], right[y : y + TILE], w[y : y + TILE], square)

    def met(left: np.ndarray, u: np.ndarray, right: np.ndarray, w: np.ndarray, square: bool) -> pd.DataFrame:
        s = u @ w.T
        x, y = np.nonzero(s >= threshold)
        one, two = left[x], right[y]
        keep = one < two if square else one != two
        low, high = np.where(one < two, one, two)[keep], np.where(one < two, two, one)[keep]
        return pd.DataFrame({"id_1": low, "id_2": high, "score": s[x, y][keep]})

    name = kind.simpleString()
    return dealt(True).unionByName(dealt(False)).groupBy("i", "j").applyInPandas(run, f"id_1 {name}, id_2 {name}, score double")


def ranked(pairs: DataFrame) -> DataFrame:
    """Pairs by falling score; ties by ids."""
    return pairs.orderBy(F.desc("score"), "id_1", "id_2")
