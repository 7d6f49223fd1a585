"""A corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input.

language: rejects documents in which no language is found.  near_duplicates: keeps one document of each group of five-word
shingle similarity 0.8 or more.  secrets: replaces secrets inside texts.  mix: repeats or leaves out documents so that
sources come to their target weights.  encode: BPE ids of what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import bpe_codec, language_crf, secret_scan, shingle_join, source_mix
from gristmill.llm.common import shared_dir, table, unused

#: SQL cannot express the first and the last stage; the whole is tested against a brute-force version.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; lang is what was found.  The model learns from the stage's own input.

    A null or empty text, or one without a letter, has no language and goes; so do all where no document has a lang to learn
    from.  Repeated rows and rows of a null doc_id stay as they are, texts of any length are read whole, other columns pass
    through, whatever their names, and no rows give no rows.
    """
    own = {c: unused(docs, f"own_{c}") for c in ("lang_pred", "score") if c in docs.columns}
    found = language_crf.predict(docs.withColumnsRenamed(own), language_crf.trained(docs))
    kept = found.where(F.col("lang_pred") != language_crf.UNDETERMINED)
    return kept.withColumn("lang", F.col("lang_pred")).drop("lang_pred", "score").withColumnsRenamed({b: a for a, b in own.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the least doc_id; hard rows as in shingle_join.deduplicated()."""
    return shingle_join.deduplicated(docs, words=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with secrets masked and n_chars counted again; hard rows as in secret_scan.redacted()."""
    return secret_scan.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times; hard rows as in source_mix.mixed()."""
    return source_mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row, repeats included; hard rows as in bpe_codec.encode()."""
    return bpe_codec.encode(docs, bpe_codec.tokenizer_spec(), ("n_tokens", "ids"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir; none if there are none.  Each stage is written and reread."""
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(top)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    for k, (name, stage) in enumerate(STAGES):
        out = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
