"""Sources: Markdown folders, tables of documents, duplicate listings of an external scanner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CODES, EngineError
from ..functions.paths import canonical
from ..functions.text import block_type, clipped, infer_element_type, normalize, strip
from ..schemas import DUPLICATE_GROUPS, MARKDOWN_SUFFIXES


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def has_suffix(path: Column, suffixes: tuple[str, ...] = MARKDOWN_SUFFIXES) -> Column:
    return suffix(path).isin(*suffixes)


def depth(path: Column, root: str | Column) -> Column:
    """Folders between root and the file."""
    top = F.concat(F.regexp_replace(F.lit(root) if isinstance(root, str) else root, "/+$", ""), F.lit("/"))
    below = F.when(path.startswith(top), F.substr(path, F.length(top) + 1)).otherwise(path)
    return F.length(below) - F.length(F.replace(below, F.lit("/"), F.lit("")))


def listing(spark: SparkSession, root: str, suffixes: tuple[str, ...] = MARKDOWN_SUFFIXES, recursive: bool = True, max_depth: int | None = None) -> DataFrame:
    """path, size, modified of the files of a folder.  Names that begin with _ or . are hidden, as in every file source."""
    from pyspark.errors import AnalysisException

    either = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    glob = "*{" + ",".join(map(either, suffixes)) + "}"  # so that other files are listed only, not read
    try:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", glob).load(root)
    except AnalysisException as e:
        raise EngineError(f"not a readable folder: {root}", "INVALID_DIRECTORY") from e
    rows = rows.select(canonical(F.col("path")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content")
    rows = rows.where(has_suffix(F.col("path"), suffixes))
    return rows if max_depth is None else rows.where(depth(F.col("path"), canonical(F.lit(root))) <= max_depth)


def markdown_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """file_id, path, content of a folder's Markdown files that are UTF-8; quarantined() has the others."""
    return decoded(listing(spark, root, recursive=recursive)).where("content IS NOT NULL")


def markdown_file(spark: SparkSession, path: str) -> DataFrame:
    """The same of one file; an error if it isn't there, isn't Markdown or isn't UTF-8."""
    try:
        found = decoded(listing(spark, path, recursive=False))
        row = found.first()
    except EngineError as e:
        raise EngineError(f"no such file: {path}", "FILE_NOT_FOUND") from e
    if row is None or row["content"] is None:
        raise EngineError(f"not a Markdown file in UTF-8: {path}", "FILE_PROCESSING_ERROR", {"path": path})
    return found


def decoded(files: DataFrame) -> DataFrame:
    """file_id, path, content of files (path, binary content); content is null where the bytes aren't UTF-8."""
    return files.select(F.md5("path").alias("file_id"), "path", F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def quarantined(files: DataFrame) -> DataFrame:
    """path, code, reason of files (path, binary content) that can't be processed; the others go on without them."""
    rows = decoded(files).where("content IS NULL")
    return rows.select("path", F.lit(CODES["FILE_PROCESSING_ERROR"]).alias("code"), F.lit("not UTF-8").alias("reason"))


def with_analysis_text(blocks: DataFrame) -> DataFrame:
    """blocks (text) whose analysis_text is the text (empty, if that is null) wherever it is missing."""
    own = F.col("analysis_text") if "analysis_text" in blocks.columns else F.lit(None).cast("string")
    return blocks.withColumn("analysis_text", F.coalesce(own, "text", F.lit("")))


def document_files(docs: DataFrame, *more: str) -> DataFrame:
    """file_id, path, content, and more columns, from a table of documents (doc_id, text, source)."""
    path = F.concat_ws("/", F.col("source"), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")))
    return docs.select(F.md5(path).alias("file_id"), path.alias("path"), F.coalesce("text", F.lit("")).alias("content"), *more)


def fenced(lines: Column) -> Column:
    """The fenced code of an array of lines: first and last line (from 0) of each, in order.

    A fence is three or more backticks or tildes behind three spaces at most.  It is closed by a line of at least as many of
    the same and nothing else, or by the end; whatever is in between belongs to it.  A line of backticks with another backtick
    behind them opens nothing.
    """
    fence = r"^ {0,3}(`{3,}|~{3,})(.*)$"
    mark = lambda x: F.regexp_extract(x, fence, 1)
    rest = lambda x: F.regexp_extract(x, fence, 2)
    span = "array<struct<first:int,last:int>>"
    marked = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), mark(x).alias("mark"), rest(x).alias("rest"))), lambda x: x["mark"] != "")
    state = lambda at, mark, spans: F.struct(at.cast("int").alias("at"), mark.alias("mark"), spans.cast(span).alias("spans"))
    none = lambda spans: state(F.lit(-1), F.lit(""), spans)
    one = lambda first, last: F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))

    def step(s: Column, x: Column) -> Column:
        opens = (s["at"] < 0) & (x["mark"].startswith("~") | ~x["rest"].contains("`"))
        closes = (s["at"] >= 0) & x["mark"].startswith(s["mark"]) & (strip(x["rest"]) == "")
        return F.when(opens, state(x["at"], x["mark"], s["spans"])).when(closes, none(F.concat(s["spans"], one(s["at"], x["at"])))).otherwise(s)

    last = lambda s: F.when(s["at"] >= 0, F.concat(s["spans"], one(s["at"], F.size(lines) - 1))).otherwise(s["spans"])
    return F.aggregate(marked, none(F.array()), step, last)


def split_markdown(files: DataFrame) -> DataFrame:
    """file_id, path, pos, element_type, raw_text: a file's elements in order.

    Fenced code stays whole (see fenced()).  Headings, list items and table rows end with their line (rows that follow each
    other are one table), other lines form paragraphs up to a blank line; a paragraph underlined by = or - is a heading, without
    that line.  Lines indented by four spaces or a tab are code, unless they go on with a paragraph or belong to a list item.
    Segmentation is our own.
    """
    whole = files.select("file_id", "path", F.split("content", r"\r?\n", -1).alias("lines"))
    whole = whole.withColumn("spans", fenced(F.col("lines"))).withColumn("spans", F.concat("spans", F.array(F.struct(F.size("lines").alias("first"), F.size("lines").alias("last")))))

    def units(span: Column, k: Column) -> Column:
        """The lines before a fence, each alone, and the fence."""
        begin = F.when(k == 0, F.lit(0)).otherwise(F.element_at("spans", F.greatest(k, F.lit(1)))["last"] + 1)
        unit = lambda at, fence, raw: F.struct(at.cast("int").alias("line"), F.lit(fence).alias("fence"), raw.alias("raw"))
        lines = F.transform(F.slice("lines", begin + 1, span["first"] - begin), lambda x, i: unit(begin + i, False, x))
        code = F.array(unit(span["first"], True, F.array_join(F.slice("lines", span["first"] + 1, span["last"] - span["first"] + 1), "\n")))
        return F.concat(lines, F.when(span["first"] < F.size("lines"), code).otherwise(F.slice(code, 1, 0)))

    lines = whole.select("file_id", "path", F.explode(F.flatten(F.transform("spans", units))).alias("u")).select("file_id", "path", "u.*")
    w = Window.partitionBy("file_id").orderBy("line")
    indented = F.col("raw").rlike(r"^( {4}| {0,3}\t)")
    kind = (
        F.when(F.col("fence"), "fence")
        .when(strip(F.col("raw")) == "", "blank")
        .when(F.col("raw").rlike(r"^#{1,6}\s+"), "Title")
        .when(F.col("raw").rlike(r"^\s*([-*+]|\d+\.)\s+"), "ListItem")
        .when(F.col("raw").rlike(r"^\s*\|.*\|\s*$"), "Table")
        .when(indented, "indented")
        .otherwise("Text")
    )
    lines = lines.withColumn("kind", kind)
    solid = lambda c: F.when(~F.col("kind").isin("blank", "indented"), c)
    # what an indented line goes on with: the last line of another kind, if no blank one is between, or else a list item
    behind = F.last(solid(F.col("kind")), ignorenulls=True).over(w)
    gap = F.coalesce(F.last(F.when(F.col("kind") == "blank", F.col("line")), ignorenulls=True).over(w), F.lit(-1)) > F.coalesce(F.last(solid(F.col("line")), ignorenulls=True).over(w), F.lit(-1))
    ahead = F.when(behind == "ListItem", "Text").when((behind == "Text") & ~gap, "Text").otherwise("code")
    lines = lines.withColumn("kind", F.when(F.col("kind") == "indented", ahead).otherwise(F.col("kind")))
    under = F.col("raw").rlike(r"^ {0,3}(=+|-+)\s*$") & (F.col("kind") == "Text")
    # a line of - or = underlines a paragraph; right after another such line it begins one
    lines = lines.withColumn("under", under).withColumn("before", F.lag("kind").over(w)).withColumn("line_before", F.lag("under").over(w))
    lines = lines.withColumn("under", F.col("under") & F.coalesce((F.col("before") == "Text") & ~F.col("line_before"), F.lit(False)))
    after = F.coalesce(F.lag("under").over(w), F.lit(False))
    opens = F.col("before").isNull() | (F.col("kind") != F.col("before")) | F.col("kind").isin("Title", "ListItem", "fence") | after
    lines = lines.withColumn("element", F.sum(opens.cast("int")).over(w)).where("kind <> 'blank'")
    text = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("line", "raw", "under"))), lambda x: ~x["under"]), lambda x: x["raw"]), "\n")
    kinds = F.when(F.max("under"), "Title").when(F.first("kind").isin("fence", "code"), "CodeSnippet").otherwise(F.first("kind"))
    elements = lines.groupBy("file_id", "path", "element").agg(F.min("line").alias("line"), kinds.alias("element_type"), text.alias("raw_text"))
    pos = F.row_number().over(Window.partitionBy("file_id").orderBy("line")) - 1
    return elements.select("file_id", "path", pos.alias("pos"), "element_type", "raw_text")


def split_lines(files: DataFrame, *more: str) -> DataFrame:
    """The same columns, and more of files', with an element for each line that isn't blank."""
    lines = files.select("file_id", "path", *more, F.posexplode(F.split("content", "\n", -1)).alias("pos", "raw_text"))
    return lines.where(strip(F.col("raw_text")) != "").select("file_id", "path", "pos", F.lit("Text").alias("element_type"), "raw_text", *more)


def blocks(elements: DataFrame) -> DataFrame:
    """Typed, normalised blocks of elements, keyed by (file_id, block_id) with an explicit place."""
    typed = elements.withColumn("element_type", infer_element_type(F.col("element_type"), F.col("raw_text")))
    text = normalize(F.col("element_type"), F.col("raw_text"))
    return typed.select(
        "file_id",
        "path",
        F.concat_ws("#", "file_id", F.col("pos").cast("string")).alias("block_id"),
        "pos",
        block_type(F.col("element_type")).alias("block_type"),
        text.alias("text"),
        F.create_map(F.lit("original_path"), F.col("path"), F.lit("element_type"), F.col("element_type"), F.lit("original_text_preview"), clipped(F.col("raw_text"))).alias("metadata"),
    )


def external_groups(json: DataFrame, column: str = "value") -> DataFrame:
    """files, header of an external scanner's JSON arrays (a string column): entries without path or size and groups
    without entries go, groups of one stay, text that isn't such JSON gives nothing."""
    parsed = F.from_json(F.col(column), DUPLICATE_GROUPS, {"mode": "PERMISSIVE"})
    groups = json.select(F.explode(parsed).alias("g")).select(F.filter("g.files", lambda f: f["path"].isNotNull() & f["size"].isNotNull()).alias("files"), "g.header")
    return groups.where(F.size("files") > 0)
