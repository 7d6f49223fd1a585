"""BPE encoding and decoding of whole texts."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bpe import codec
from .common import map_arrow, slices, table

#: UTF-8 bytes of the texts that are encoded at once (a longer text alone).
SLICE = 1 << 20

#: The outputs that encode() offers.
FIELDS = {
    "n_tokens": (T.LongType(), pa.int64()),
    "ids": (T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    "decoded": (T.StringType(), pa.string()),
    "ids_sha256": (T.StringType(), pa.string()),
    "decoded_sha256": (T.StringType(), pa.string()),
}


def tokenizer_spec(name: str = "byte_bpe_50k.json") -> str:
    """The JSON text of one of the installed public tokenizers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str, outputs: tuple[str, ...] = ("n_tokens", "ids")) -> DataFrame:
    """doc_id and the asked outputs of each row of docs (doc_id, text; further columns are ignored).

    n_tokens, ids; decoded: the text that decoding the ids gives; ids_sha256, decoded_sha256: lowercase hex digests, of the
    decimal ids joined by commas and of the decoded text.  A null text is empty and has no ids; a very long text is encoded
    whole, alone.  Each row stands alone, so
    repeated rows, null ids and empty tables need nothing special, and a lost task is done again from its own rows.
    A task keeps what it has encoded, up to a fixed number of bytes and one text's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(sent.value)
        gc.disable()  # nothing here makes cycles, and looking for some goes through the whole cache time and again
        try:
            for part in slices(batches, SLICE):
                rows: dict[str, list] = {k: [] for k in outputs}
                for text in part.column("text").to_pylist():
                    ids = c.encode(text or "")
                    decoded = c.decode(ids) if "decoded" in rows or "decoded_sha256" in rows else ""
                    for k, out in rows.items():
                        if k == "n_tokens":
                            out.append(ids.count(",") + 1 if ids else 0)
                        elif k == "ids":
                            out.append(np.array(ids.split(",") if ids else [], np.int32))
                        elif k == "decoded":
                            out.append(decoded)
                        else:
                            out.append(hashlib.sha256((ids if k == "ids_sha256" else decoded).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(rows[k], FIELDS[k][1]) for k in outputs)], ["doc_id", *outputs])
        finally:
            gc.enable()
            c.forget()  # the codec outlives the task in its worker; what it has encoded need not

    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(k, FIELDS[k][0]) for k in outputs)]
    return map_arrow(docs.select("doc_id", "text"), run, T.StructType(fields))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), tokenizer_spec(), ("n_tokens", "ids_sha256", "decoded_sha256"))
