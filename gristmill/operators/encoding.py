"""Vectors of texts by an encoder that may fail: loaded once for each worker, failures kept as rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import CODES
from ..shipping import scratch, ship

Encoder = Callable[[list[str]], np.ndarray]
ENCODED = "text_md5 string, embedding array<double>, code int, reason string"

#: What a worker has loaded, or the error that came of it, by the loader's name.
_loaded: dict[str, Encoder | Exception] = {}


@dataclass(frozen=True)
class Loader:
    """An encoder that each worker makes for itself: `make` is called there once, whatever the number of tasks.

    Loaders of one name share what a worker has loaded, so a name stands for one model.  A worker doesn't try again what has
    failed to load.
    """

    name: str
    make: Callable[[], Encoder]

    def load(self) -> Encoder:
        if self.name not in _loaded:
            try:
                _loaded[self.name] = self.make()
            except Exception as e:  # noqa: BLE001 - whatever a model's own code raises
                _loaded[self.name] = e
        found = _loaded[self.name]
        if isinstance(found, Exception):
            raise found
        return found


def name_of(encoder: Encoder | Loader) -> str:
    """What tells encoders apart: a loader's name, or where a function is from."""
    return encoder.name if isinstance(encoder, Loader) else f"{encoder.__module__}:{encoder.__qualname__}"


def _said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:200]


def _vectors(encoder: Encoder, texts: list[str]) -> list[tuple[list[float], int | None, str | None]]:
    """A vector, or an empty one with code and reason, for each text.  A batch that fails is halved until the texts that it
    fails on are alone, so that they cost no other text its vector."""
    try:
        out = np.asarray(encoder(texts), dtype=np.float64)
        if out.ndim != 2 or len(out) != len(texts):
            raise ValueError(f"{len(texts)} texts gave an array of shape {out.shape}")
    except Exception as e:  # noqa: BLE001
        if len(texts) == 1:
            return [([], CODES["VECTOR_COMPUTATION_ERROR"], _said(e))]
        half = len(texts) // 2
        return _vectors(encoder, texts[:half]) + _vectors(encoder, texts[half:])
    whole = np.isfinite(out).all(axis=1)
    return [(v, None, None) if ok else ([], CODES["VECTOR_COMPUTATION_ERROR"], "not finite") for v, ok in zip(out.tolist(), whole.tolist(), strict=True)]


def encoded(blocks: DataFrame, encoder: Encoder | Loader, batch: int = 32, cache: DataFrame | None = None) -> DataFrame:
    """text_md5, embedding, code, reason of each distinct text of blocks, together with the cache's (text_md5, embedding).

    Null and empty texts have no row.  A text that the encoder fails on has an empty embedding, the error's code and what it
    said; so has every text of a worker that can't load its encoder.  Only failures have a code; texts of the cache have none
    and aren't encoded again.  Very long texts go to the encoder whole.
    """
    texts = blocks.where("text IS NOT NULL AND text <> ''").select(F.md5("text").alias("text_md5"), "text").dropDuplicates(["text_md5"])
    if cache is not None:
        texts = texts.join(cache.select("text_md5"), "text_md5", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready, failed = None, None
        try:
            ready = encoder.load() if isinstance(encoder, Loader) else encoder
        except Exception as e:  # noqa: BLE001
            failed = ([], CODES["MODEL_LOADING_ERROR"], _said(e))
        for f in frames:
            rows = []
            for at in range(0, len(f), batch):
                part = f["text"].iloc[at : at + batch].tolist()
                rows.extend([failed] * len(part) if failed else _vectors(ready, part))
            out = pd.DataFrame(rows, columns=["embedding", "code", "reason"])
            yield pd.DataFrame({"text_md5": f["text_md5"].to_numpy(), "embedding": out["embedding"], "code": out["code"].astype("Int32"), "reason": out["reason"].astype(object)})

    ship(blocks.sparkSession)
    new = texts.mapInPandas(run, ENCODED)
    if cache is None:
        return new
    known = cache.select("text_md5", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(None).cast("int").alias("code"), F.lit(None).cast("string").alias("reason"))
    return known.unionByName(new)


def saved(rows: DataFrame) -> DataFrame:
    """encoded() rows written to the shared folder and read back, so that no later use calls the encoder again."""
    spark = rows.sparkSession
    at = scratch(spark, "vectors")
    rows.write.parquet(at)
    return spark.read.schema(ENCODED).parquet(at)


def cacheable(rows: DataFrame) -> DataFrame:
    """text_md5, embedding of encoded() rows without failures, for the cache of a later run."""
    return rows.where("code IS NULL").select("text_md5", "embedding")


def failures(rows: DataFrame) -> DataFrame:
    """text_md5, code, reason of encoded() rows that have no vector."""
    return rows.where("code IS NOT NULL").select("text_md5", "code", "reason")


def loads(spark: SparkSession, encoder: Encoder | Loader) -> str | None:
    """Why an executor can't load the encoder; None if it can.  A job of one row, before anything is encoded."""
    if not isinstance(encoder, Loader):
        return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            try:
                encoder.load()
                yield pd.DataFrame({"reason": [None] * len(f)}, dtype=object)
            except Exception as e:  # noqa: BLE001
                yield pd.DataFrame({"reason": [_said(e)] * len(f)})

    ship(spark)
    return spark.range(1, numPartitions=1).mapInPandas(run, "reason string").first()["reason"]
