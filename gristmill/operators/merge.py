"""Stitching code blocks that a splitter broke apart: an ordered fold over the blocks of each file."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FENCE, rstrip, strip


def language_of(first_line: str) -> str | None:
    found = re.match(r"```(\w+)", first_line.strip())
    return found[1] if found else None


def _joined_by_space(a: str, b: str) -> bool:
    word = lambda c: c.isalnum() or c == "_"
    return bool(a and b) and word(a[-1]) and word(b[0]) and (a[-1].isalnum() or b[0].isalnum())


def _opens(line: str) -> bool:
    return line.strip().startswith(FENCE) and line.strip() != FENCE


def body_of(texts: list[str]) -> str:
    """The code of a fenced segment: the opening line and the closing fence go, line ends stay, broken words stay apart.

    A member that is only its opening line leaves an empty line, a blank member ends the line before it and adds one.
    """
    body, ended = "", True
    for k, text in enumerate(texts):
        if not text.strip():
            body += "\n" if ended or not body else "\n\n"
            ended = True
            continue
        lines = text.splitlines(keepends=True)
        if k == 0 and _opens(lines[0]):
            body = "".join(lines[1:]) or "\n"
        elif k == len(texts) - 1 and lines[-1].strip() == FENCE:
            body += "".join(lines[:-1])
        else:
            apart = not ended and text[0] not in "\n " and _joined_by_space(body, text)
            body += f" {text}" if apart else text
        ended = text.endswith("\n")
    return body


def fold(rows: list[dict], max_gap: int = 1) -> tuple[list[dict], list[dict]]:
    """(blocks, members) of one file's ordered rows; members carry the id of the block they went into."""
    out: list[dict] = []
    members: list[dict] = []
    segment: list[dict] = []
    gap = 0

    def flush() -> None:
        texts = [r["text"] or "" for r in segment]
        bare = all(t.strip() == FENCE for t in texts) and len(texts) == 2
        language = None if bare else language_of(texts[0].strip().split("\n")[0])
        body = "" if bare else body_of(texts)
        if max_gap == 0 and not bare:
            body = f"{FENCE}{language or ''}\n{body.rstrip()}\n{FENCE}"
        first = segment[0]
        new = hashlib.md5((first["file_id"] + body).encode()).hexdigest()
        out.append(first | {"block_id": new, "block_type": "code_merged", "text": body, "status": "keep", "char_count": len(body), "token_count": sum(r["token_count"] for r in segment), "language": language})
        members.extend(r | {"status": "delete", "merged_into": new} for r in segment)

    for k, r in enumerate(rows):
        t = (r["text"] or "").strip()
        code = r["block_type"] == "code"
        opens = code and t.startswith(FENCE)
        whole = opens and t != FENCE and t.endswith(FENCE)
        closes = code and t == FENCE
        if not segment:
            following = (rows[k + 1]["text"] or "").strip() if k + 1 < len(rows) else None
            if not whole and ((closes and following == FENCE) or (opens and not closes)):
                segment, gap = [r], 0
            else:
                out.append(r)
        elif closes:
            segment.append(r)
            flush()
            segment = []
        elif not code:
            gap += 1
            segment.append(r)
            if gap > max_gap:
                out.extend(segment)
                segment = []
        else:
            segment.append(r)
    if segment:
        flush()
    return out, members


#: A line's end, as text lines have it, and characters that end none.
_END = r"(?:\r\n|\r(?!\n)|[\n\x0B\f\x1c-\x1e\x85\u2028\u2029])"
_INSIDE = r"[^\r\n\x0B\f\x1c-\x1e\x85\u2028\u2029]"
_FIRST_LINE = rf"(?s)\A({_INSIDE}*(?:{_END}|\z))(.*)\z"
_LAST_LINE = rf"(?s)\A(|.*{_END})({_INSIDE}+(?:{_END})?|{_END})\z"
_WORD = r"[\p{L}\p{N}_]"


def segments(rows: Column, max_gap: int) -> Column:
    """First and last place (from 0) of each segment in an array of rows (block_type, bare: the stripped text), in order.

    A state machine as a fold: inside a segment from a row that opens one to the row that closes it or the end; rows that
    aren't code count as gaps, and one too many leaves the rows so far as they were.
    """
    code = lambda x: F.coalesce(x["block_type"] == "code", F.lit(False))
    span = lambda first, last: F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))
    state = lambda at, gap, spans: F.struct(at.cast("int").alias("at"), gap.cast("int").alias("gap"), spans.cast("array<struct<first:int,last:int>>").alias("spans"))
    out = lambda spans: state(F.lit(-1), F.lit(0), spans)

    def item(x: Column, i: Column) -> Column:
        following = F.try_element_at(rows, i + 2)["bare"]
        closes, opens = code(x) & (x["bare"] == FENCE), code(x) & x["bare"].startswith(FENCE)
        whole = opens & ~closes & x["bare"].endswith(FENCE)
        starts = ~whole & ((closes & F.coalesce(following == FENCE, F.lit(False))) | (opens & ~closes))
        return F.struct(i.alias("i"), code(x).alias("code"), closes.alias("closes"), starts.alias("starts"))

    def step(s: Column, x: Column) -> Column:
        free = s["at"] < 0
        return (
            F.when(free & x["starts"], state(x["i"], F.lit(0), s["spans"]))
            .when(free, s)
            .when(x["closes"], out(F.concat(s["spans"], span(s["at"], x["i"]))))
            .when(~x["code"] & (s["gap"] >= max_gap), out(s["spans"]))
            .when(~x["code"], state(s["at"], s["gap"] + 1, s["spans"]))
            .otherwise(s)
        )

    rest = lambda s: F.when(s["at"] >= 0, F.concat(s["spans"], span(s["at"], F.size(rows) - 1))).otherwise(s["spans"])
    return F.aggregate(F.transform(rows, item), out(F.array()), step, rest)


def segment_body(rows: Column) -> Column:
    """body_of() of an array of rows (text, bare) that form a segment; each member's part depends on the one before alone."""
    opening = lambda x: (strip(F.regexp_extract(x["text"], _FIRST_LINE, 1)).startswith(FENCE)) & (strip(F.regexp_extract(x["text"], _FIRST_LINE, 1)) != FENCE)
    behind = lambda x: F.regexp_extract(x["text"], _FIRST_LINE, 2)

    def part(x: Column, k: Column) -> Column:
        before = F.element_at(rows, F.greatest(k, F.lit(1)))
        headless = (k == 1) & opening(before) & (behind(before) == "")  # then an empty line stands for it
        ended = (k == 0) | (before["bare"] == "") | before["text"].endswith("\n")
        last_char = F.when(headless, F.lit("\n")).otherwise(F.right(before["text"], F.lit(1)))
        first_char = F.left(x["text"], F.lit(1))
        apart = ~ended & last_char.rlike(_WORD) & first_char.rlike(_WORD) & ~((last_char == "_") & (first_char == "_"))
        return (
            F.when(x["bare"] == "", F.when(ended, F.lit("\n")).otherwise(F.lit("\n\n")))
            .when((k == 0) & opening(x), F.coalesce(F.nullif(behind(x), F.lit("")), F.lit("\n")))
            .when((k == F.size(rows) - 1) & (strip(F.regexp_extract(x["text"], _LAST_LINE, 2)) == FENCE), F.regexp_extract(x["text"], _LAST_LINE, 1))
            .when(apart, F.concat(F.lit(" "), x["text"]))
            .otherwise(x["text"])
        )

    return F.array_join(F.transform(rows, part), "")


def merge_code_blocks(blocks: DataFrame, max_gap: int = 1) -> DataFrame:
    """Blocks after merging, and, with merged_into set and status delete, the blocks that went into others.

    blocks: file_id, pos, block_id, block_type, text, optional token_count (else 1 each).  A file's blocks are sorted and folded
    as one array, by Spark expressions alone; a file must fit in a task, as it does wherever it is parsed.  fold() says the
    same by a plain loop.
    """
    count = F.col("token_count").cast("long") if "token_count" in blocks.columns else F.lit(1).cast("long")
    text = F.coalesce("text", F.lit(""))
    row = F.struct(F.col("pos").cast("int").alias("pos"), "block_id", "block_type", F.col("text").alias("own"), text.alias("text"), strip(text).alias("bare"), count.alias("token_count"))
    files = blocks.groupBy("file_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    ends = F.struct(F.size("rows").alias("first"), F.size("rows").alias("last"))
    files = files.withColumn("spans", F.concat(segments(F.col("rows"), max_gap), F.array(ends)))

    def pieces(span: Column, k: Column) -> Column:
        """The rows before a segment, each alone, and the segment's."""
        begin = F.when(k == 0, F.lit(0)).otherwise(F.element_at("spans", F.greatest(k, F.lit(1)))["last"] + 1)
        piece = lambda rows, merged: F.struct(rows.alias("rows"), F.lit(merged).alias("merged"))
        single = F.transform(F.slice("rows", begin + 1, span["first"] - begin), lambda x: piece(F.array(x), False))
        whole = F.array(piece(F.slice("rows", span["first"] + 1, span["last"] - span["first"] + 1), True))
        return F.concat(single, F.when(span["first"] < F.size("rows"), whole).otherwise(F.slice(whole, 1, 0)))

    parts = files.select("file_id", F.explode(F.flatten(F.transform("spans", pieces))).alias("p")).select("file_id", "p.rows", "p.merged")
    line = F.split(F.col("rows")[0]["bare"], "\n", 2)[0]
    bare = F.col("merged") & (F.size("rows") == 2) & F.forall("rows", lambda x: x["bare"] == FENCE)
    language = F.nullif(F.regexp_extract(line, rf"^```({_WORD}+)", 1), F.lit(""))
    parts = parts.withColumn("bare", bare).withColumn("language", F.when(F.col("merged") & ~F.col("bare"), language))
    parts = parts.withColumn("body", F.when(F.col("merged"), F.when(F.col("bare"), F.lit("")).otherwise(segment_body(F.col("rows")))))
    if max_gap == 0:
        fenced = F.concat(F.lit(FENCE), F.coalesce("language", F.lit("")), F.lit("\n"), rstrip(F.col("body")), F.lit("\n" + FENCE))
        parts = parts.withColumn("body", F.when(F.col("merged") & ~F.col("bare"), fenced).otherwise(F.col("body")))
    parts = parts.withColumn("new_id", F.md5(F.concat("file_id", "body")))
    nothing = F.lit(None).cast("string")

    def out(x: Column, block_id: Column, kind: Column, text: Column, status: str, tokens: Column, language: Column, merged_into: Column) -> Column:
        values = {"pos": x["pos"], "block_id": block_id, "block_type": kind, "text": text, "status": F.lit(status), "char_count": F.length(F.coalesce(text, F.lit(""))), "token_count": tokens, "language": language, "merged_into": merged_into}
        return F.struct(*(v.alias(k) for k, v in values.items()))

    as_it_is = lambda x, status, into: out(x, x["block_id"], x["block_type"], x["own"], status, x["token_count"], nothing, into)
    total = F.aggregate("rows", F.lit(0).cast("long"), lambda a, x: a + x["token_count"])
    merged = F.array(out(F.col("rows")[0], F.col("new_id"), F.lit("code_merged"), F.col("body"), "keep", total, F.col("language"), nothing))
    members = F.transform("rows", lambda x: as_it_is(x, "delete", F.col("new_id")))
    single = F.transform("rows", lambda x: as_it_is(x, "undecided", nothing))
    return parts.select("file_id", F.explode(F.when(F.col("merged"), F.concat(merged, members)).otherwise(single)).alias("b")).select("file_id", "b.*")
