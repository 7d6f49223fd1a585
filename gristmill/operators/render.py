"""Writing what is kept back as Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import OUTPUT_SUFFIX


def rendered(style: str = "basic") -> Column:
    """A block's Markdown.  basic: headings of level 1, fenced code, all else as it is; rich: also heading levels from
    metadata, list marks and the fence's language."""
    text, kind = F.col("text"), F.col("block_type")
    if style == "basic":
        return F.when(kind == "heading", F.concat(F.lit("# "), text)).when(kind == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(text)
    if style != "rich":
        raise ValueError(f"unknown style {style!r}")
    element = F.coalesce(F.element_at("metadata", "element_type"), F.lit(""))
    number = F.coalesce(F.nullif(F.regexp_extract(element, r"[-_](\d+)$", 1), F.lit("")), F.element_at("metadata", "category_depth"))
    level = F.when(element.contains("Title"), 1).otherwise(F.coalesce(number.try_cast("int"), F.lit(2)))
    level = F.least(F.greatest(level, F.lit(1)), F.lit(6))
    fence = F.concat(F.lit("```"), F.coalesce(F.element_at("metadata", "language"), F.lit("")), F.lit("\n"), text, F.lit("\n```"))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text))
        .when(kind.isin("code", "code_merged"), fence)
        .when(kind == "list_item", F.concat(F.lit("- "), text))
        .otherwise(text)
    )


def output_path(path: Column, input_dir: str = "", output_dir: str = "") -> Column:
    """The file's place below the output folder, <stem>_deduped.md; a file outside the input folder goes to its top."""
    root = input_dir.rstrip("/") + "/" if input_dir else ""
    below = F.when(path.startswith(root), F.substr(path, F.lit(len(root) + 1))).otherwise(F.regexp_extract(path, r"([^/]*)$", 1)) if root else path
    name = F.concat(F.regexp_replace(below, r"(?<=[^/])\.[^./]*$", ""), F.lit(OUTPUT_SUFFIX + ".md"))
    return F.concat(F.lit(output_dir.rstrip("/") + "/"), name) if output_dir else name


def render(blocks: DataFrame, style: str = "basic", input_dir: str = "", output_dir: str = "") -> DataFrame:
    """output_path, content of each file that keeps a block: blocks (with decision) that aren't deleted, in order."""
    kept = blocks.where(F.coalesce("decision", F.lit("undecided")) != "delete").select("path", "pos", rendered(style).alias("line"))
    whole = kept.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n\n").alias("content"))
    return whole.select(output_path(F.col("path"), input_dir, output_dir).alias("output_path"), "content")


def write(rendered_files: DataFrame) -> int:
    """Writes each content to its output_path, from the executors, through the Hadoop file system's Python counterpart, and
    says how many there were.

    Paths must be in a folder that all executors share.  A task that runs again writes its files again.
    """

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for frame in frames:
            for at, content in zip(frame["output_path"], frame["content"], strict=True):
                where, path = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)
                where.create_dir(path.rsplit("/", 1)[0])
                with where.open_output_stream(path) as f:
                    f.write(content.encode())
            yield pd.DataFrame({"n": [len(frame)]})

    return rendered_files.select("output_path", "content").mapInPandas(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
