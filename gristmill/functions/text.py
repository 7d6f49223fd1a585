"""Column expressions over block texts, keys and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import KEY_SEPARATOR, MISSING_KEY_PARTS, PAIR_NAMESPACE

#: White space as Unicode text processing has it: Java's with (?U), and the four separators that leaves out.
SPACE = r"[\s\x1c-\x1f]"
FENCE = "```"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U){SPACE}+\z", "")


def is_fence(c: Column) -> Column:
    return strip(c).startswith(FENCE)


def looks_narrative(c: Column) -> Column:
    """Has a Latin or CJK letter, opens no fence and is more than bare markup."""
    t = strip(c)
    return t.rlike("[a-zA-Z一-鿿]") & ~t.startswith(FENCE) & ~t.rlike(rf"(?U)^(#+{SPACE}*|[-*+]{SPACE}*|>{SPACE}*)\z")


def infer_element_type(element: Column, raw: Column) -> Column:
    """Element type from the declared one and the raw text; the first rule that fits decides."""
    t = strip(raw)
    return (
        F.when(element == "CodeSnippet", element)
        .when(t.startswith(FENCE), F.lit("CodeSnippet"))
        .when(t.rlike(rf"(?U)^#{{1,6}}{SPACE}+"), F.lit("Title"))
        .when(t.rlike(rf"(?U)^{SPACE}*([-*+]|\d+\.){SPACE}+"), F.lit("ListItem"))
        .when(element.isin("Text", "NarrativeText"), F.when(looks_narrative(raw), F.lit("NarrativeText")).otherwise(F.lit("Text")))
        .otherwise(element)
    )


def normalize(element: Column, raw: Column, emphasis: bool = True) -> Column:
    """Text for analysis: code and tables are stripped, titles lose their mark, all else its inline markup."""
    title = strip(F.regexp_replace(raw, rf"(?U)\A#{{1,6}}{SPACE}+", ""))
    t = F.replace(raw, F.lit("`"), F.lit(""))
    if emphasis:
        t = F.regexp_replace(t, r"(?d)(?<!\\)[*_~]{1,2}(.+?)(?<!\\)[*_~]{1,2}", "$1")
    t = F.regexp_replace(t, r"(?d)\[(.*?)\]\(.*?\)", "$1")
    t = F.regexp_replace(t, r"(?d)!\[(.*?)\]\(.*?\)", "$1")
    t = F.regexp_replace(t, rf"(?dU)\A{SPACE}*([-*+]|\d+\.){SPACE}+", "")
    t = F.regexp_replace(t, rf"(?dUm)^{SPACE}*>{SPACE}?", "")
    plain = F.trim(F.regexp_replace(t, rf"(?U){SPACE}+", " "))
    return F.when(element.isin("CodeSnippet", "Table"), strip(raw)).when(element == "Title", title).otherwise(plain)


def block_type(element: Column) -> Column:
    """Block type of an element type: by exact name first, else by what the name holds."""
    low = F.lower(element)
    out = F.when(low.isin("unknown", "text", "heading", "list_item", "code", "code_merged", "table"), low)
    for part, kind in (("Title", "heading"), ("Heading", "heading"), ("ListItem", "list_item"), ("Code", "code"), ("Table", "table"), ("Narrative", "text"), ("Text", "text")):
        out = out.when(element.contains(part), F.lit(kind))
    return out.otherwise(F.lit("unknown"))


def one_of(c: Column, values: tuple[str, ...], default: str) -> Column:
    return F.when(c.isin(*values), c).otherwise(F.lit(default))


def clipped(c: Column, most: int = 100) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def preview(c: Column, most: int = 80) -> Column:
    """One line of a block for display."""
    return F.when(c.isNull(), F.lit("[无内容]")).otherwise(clipped(strip(F.replace(c, F.lit("\n"), F.lit(" "))), most))


def decision_key(path: Column, block_id: Column, kind: Column) -> Column:
    parts = [F.coalesce(F.nullif(c, F.lit("")), F.lit(m)) for c, m in zip((path, block_id, kind), MISSING_KEY_PARTS, strict=True)]
    return F.concat_ws(KEY_SEPARATOR, *parts)


def parsed_key(key: Column) -> Column:
    """struct(path, block_id, block_type): the key split from the right, so a path may hold the separator; else nulls."""
    pattern = r"(?s)\A(.*)::(.*)::(.*)\z"
    part = lambda i: F.when(key.rlike(pattern), F.regexp_extract(key, pattern, i))
    return F.struct(part(1).alias("path"), part(2).alias("block_id"), part(3).alias("block_type"))


def pair_id(a: Column, b: Column, analysis_type: Column) -> Column:
    """Name-based UUID (version 5) of a pair of blocks, whatever their order."""
    name = F.concat_ws("_", F.least(a, b), F.greatest(a, b), analysis_type)
    h = F.sha1(F.concat(F.unhex(F.lit(PAIR_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def sort_key(path: Column, block_id: Column) -> Column:
    """struct(path, id): ids with digits sort by those, padded to ten."""
    digits = F.regexp_replace(block_id, r"\D", "")
    padded = F.lpad(digits, 10, "0")
    return F.struct(path.alias("path"), F.when(digits == "", block_id).when(F.length(digits) > 10, digits).otherwise(padded).alias("id"))


def fingerprint(kind: Column, text: Column) -> Column:
    return F.md5(F.concat(kind, F.lit(":"), strip(text)))


_ISO = r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(Z|[+-]\d{2}:?\d{2}(?::?\d{2})?)?)?$"


def instant(c: Column) -> Column:
    """The time of ISO 8601 text, whatever the session's zone: without a zone of its own it is UTC; null where it is no such
    text.  A date alone is its midnight; digits beyond microseconds are cut."""
    full = F.when(F.length(c) == 10, F.concat(c, F.lit("T00:00:00"))).otherwise(F.replace(c, F.lit(","), F.lit(".")))
    zone = F.regexp_replace(F.regexp_extract(c, _ISO, 1), r"(\d{2}):?(?=\d)", "$1:")
    bare = F.regexp_replace(full, r"(?<=.{10})(?:Z|[+-][\d:]+)$", "")
    seconds = F.when(F.length(bare) == 16, ":00").otherwise("")
    return F.when(c.rlike(_ISO), F.try_to_timestamp(F.concat(bare, seconds, F.when(zone == "", "Z").otherwise(zone))))


def iso(c: Column) -> Column:
    """A time as ISO 8601 text in UTC, to the microsecond where it has any, whatever the session's zone."""
    since = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.unix_micros(c).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)"))
    text = F.replace((F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'") + since).cast("string"), F.lit(" "), F.lit("T"))
    whole, rest = F.substring_index(text, ".", 1), F.substring_index(text, ".", -1)
    return F.concat(F.when(text.contains("."), F.concat(whole, F.lit("."), F.rpad(rest, 6, "0"))).otherwise(text), F.lit("+00:00"))
