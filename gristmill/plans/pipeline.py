"""The whole analysis as one lazy plan: scan, split, type, merge, exact groups, similar pairs, decisions, rendering."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigurationError
from ..metrics import Metrics, skipped
from ..operators import decisions as dec
from ..operators import duplicates, encoding, merge, render, semantic
from ..schemas import BLOCK_DECISION_TABLE
from ..sources import files as src
from .stages import Stages, digest_of


@dataclass(frozen=True)
class Config:
    input_dir: str = ""
    output_dir: str = "output"
    threshold: float = 0.80
    skip_semantic: bool = False
    merge_code: bool = False
    max_gap: int = 1
    prefilter: str | None = None
    style: str = "basic"
    encoder: encoding.Encoder | encoding.Loader | None = None

    def __post_init__(self):
        if not 0 <= self.threshold <= 1:
            raise ConfigurationError("the similarity threshold must be from 0 to 1", {"threshold": self.threshold})
        if self.prefilter not in (None, "strict", "keep_first"):
            raise ConfigurationError("unknown prefilter", {"prefilter": self.prefilter})


@dataclass
class Analysis:
    blocks: DataFrame  # with decision
    members: DataFrame
    pairs: DataFrame | None
    config: Config
    encoder_failures: DataFrame | None = None  # text_md5, code, reason
    semantic_skipped: str | None = None  # why no similar pairs were looked for, though an encoder was given

    def rendered(self) -> DataFrame:
        return render.render(self.blocks, self.config.style, self.config.input_dir, self.config.output_dir)

    def status(self) -> DataFrame:
        return dec.status(self.blocks, self.members, self.pairs)


def _blocks(files: DataFrame, config: Config) -> DataFrame:
    if config.prefilter:
        files = files.join(duplicates.unique_files(files, config.prefilter), "path", "left_semi")
    blocks = src.blocks(src.split_markdown(files))
    if not config.merge_code:
        return blocks
    merged = merge.merge_code_blocks(blocks, config.max_gap).where("merged_into IS NULL").select("file_id", "pos", "block_id", "block_type", "text", "language")
    paths = blocks.select("file_id", "path").distinct()
    metadata = F.map_filter(F.create_map(F.lit("original_path"), F.col("path"), F.lit("language"), F.col("language")), lambda k, v: v.isNotNull())
    return merged.join(paths, "file_id").select("file_id", "path", "block_id", "pos", "block_type", "text", metadata.alias("metadata"))


def _exact(blocks: DataFrame, decisions: DataFrame | None, metrics: Metrics | None) -> tuple[DataFrame, DataFrame]:
    """Blocks with decisions after the exact stage's suggestions, and members of groups."""
    known = decisions if decisions is not None else blocks.sparkSession.createDataFrame([], BLOCK_DECISION_TABLE)
    decided = duplicates.with_decisions(blocks, known)
    if metrics:
        decided = metrics.observed(decided, "exact", **skipped(duplicates.skip_reason()))
    members = duplicates.exact_groups(decided)
    return duplicates.applied(decided, duplicates.suggestions(members)), members


def analyse(spark: SparkSession, config: Config, files: DataFrame | None = None, decisions: DataFrame | None = None, metrics: Metrics | None = None) -> Analysis:
    """files (file_id, path, content) default to the input folder's; decisions are those of earlier runs.

    An encoder that executors can't load skips the semantic stage and says so; texts that it fails on take no part and are
    listed with a reason.  metrics, if given, count files, blocks and what the exact stage skips and why, in the same plan.
    """
    if files is None:
        if not config.input_dir:
            raise ConfigurationError("no input folder is set")
        files = src.markdown_files(spark, config.input_dir)
    if metrics:
        files = metrics.observed(files, "files", bytes=F.sum(F.octet_length("content")))
    decided, members = _exact(_blocks(files, config), decisions, metrics)
    pairs, failed, why = None, None, None
    if not config.skip_semantic and config.encoder is not None:
        why = encoding.loads(spark, config.encoder)
        if why is None:
            able = semantic.eligible(decided)
            vectors = encoding.saved(encoding.encoded(able, config.encoder))
            failed = encoding.failures(vectors)
            pairs = semantic.similar_pairs(semantic.with_vectors(able, encoding.cacheable(vectors)), config.threshold)
    return Analysis(decided, members, pairs, config, failed, why)


def analyse_again(spark: SparkSession, config: Config, stages: Stages, decisions: DataFrame | None = None) -> Analysis:
    """analyse() of the input folder, taking from `stages` what an earlier run made from the same things.

    Changed files (path, size or time; contents aren't read for it), prefilter or merging make everything new, changed
    decisions all but blocks and vectors, another encoder (by name) vectors and pairs, another threshold pairs alone.  Texts
    that an encoder failed on stay without a vector until their blocks are made new or the encoder has another name.
    """
    if not config.input_dir:
        raise ConfigurationError("no input folder is set")
    inputs = digest_of(src.listing(spark, config.input_dir), "path", "size", "modified")
    blocks, of_blocks = stages.of(
        "blocks",
        {"files": inputs, "prefilter": config.prefilter, "merge": config.max_gap if config.merge_code else None},
        lambda: _blocks(src.markdown_files(spark, config.input_dir), config),
    )
    known = digest_of(decisions, *duplicates.KEY, "decision") if decisions is not None else None
    made_from = {"blocks": of_blocks, "decisions": known}
    decided, of_decided = stages.of("decided", made_from, lambda: _exact(blocks, decisions, None)[0])
    members, _ = stages.of("members", made_from, lambda: _exact(blocks, decisions, None)[1])
    pairs, failed, why = None, None, None
    if not config.skip_semantic and config.encoder is not None:
        why = encoding.loads(spark, config.encoder)
        if why is None:
            every = blocks.where("block_type <> 'heading' AND path IS NOT NULL")
            vectors, of_vectors = stages.of("vectors", {"blocks": of_blocks, "encoder": encoding.name_of(config.encoder)}, lambda: encoding.encoded(every, config.encoder))
            failed = encoding.failures(vectors)
            able = semantic.with_vectors(semantic.eligible(decided), encoding.cacheable(vectors))
            pairs, _ = stages.of("pairs", {"decided": of_decided, "vectors": of_vectors, "threshold": config.threshold}, lambda: semantic.similar_pairs(able, config.threshold))
    return Analysis(decided, members, pairs, config, failed, why)
