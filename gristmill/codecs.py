"""Records of files, blocks, results and pair decisions as JSON text, one a row, and back.

Reading never fails: each record comes back with the table's columns or with the reason why it can't be one, and what was
rejected stays beside what was accepted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas
from .functions.text import instant, iso, one_of, pair_id

SCHEMAS = {"files": schemas.FILES, "blocks": schemas.BLOCKS, "results": schemas.RESULTS, "pair_decisions": schemas.PAIR_DECISIONS}
# Names in JSON that differ from the table's, fields without which a record is none, value sets and defaults.
NAMES = {"files": {"path": "original_path", "registered_at": "registration_time"}, "pair_decisions": {"decided_at": "timestamp"}}
REQUIRED = {
    "files": ("file_id", "original_path"),
    "blocks": ("file_id", "text"),
    "results": ("block_id_1", "block_id_2", "analysis_type"),
    "pair_decisions": ("block_id_1", "block_id_2", "analysis_type"),
}
ENUMS = {"block_type": (schemas.BLOCK_TYPES, "unknown"), "analysis_type": (schemas.ANALYSIS_TYPES, "unknown"), "decision": (schemas.DECISION_TYPES, "undecided")}
_CORRUPT = "_corrupt"


def _named(kind: str) -> dict[str, T.StructField]:
    """The table's fields by their names in JSON."""
    return {NAMES.get(kind, {}).get(f.name, f.name): f for f in SCHEMAS[kind]}


def decoded(records: DataFrame, kind: str, now: Column | None = None, column: str = "value") -> DataFrame:
    """The columns of table `kind`, record (the JSON text) and reject, for each row of records, whose further columns go.

    reject is null for an accepted record, else "unreadable" (no JSON object, null or empty, or a value that its field can't
    hold) or "without" and the required fields that are missing or null; the table's columns are null then.  Unknown values of
    an enumeration become its default; a time that is missing or can't be read becomes `now` (the query's own time), one without
    a zone is UTC.  Ids of pairs are made anew from the pair; a block without an id gets the digest of its record, so equal
    records get equal ids.  Missing metadata is empty, values in it that aren't text are kept as JSON.  Repeated records each
    give a row, and fields that the table doesn't have are passed over.
    """
    named = _named(kind)
    wire = T.StructType([T.StructField(n, T.StringType() if isinstance(f.dataType, T.TimestampType) else f.dataType) for n, f in named.items()] + [T.StructField(_CORRUPT, T.StringType())])
    record = F.col(column)
    rows = records.select(record.alias("record"), F.from_json(record, wire, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}).alias("r"))
    missing = F.array_compact(F.array(*(F.when(F.col(f"r.{n}").isNull(), F.lit(n)) for n in REQUIRED[kind])))
    unreadable = F.col("record").isNull() | ~F.ltrim("record").startswith("{") | F.col(f"r.{_CORRUPT}").isNotNull()
    reject = F.when(unreadable, "unreadable").when(F.size(missing) > 0, F.concat(F.lit("without "), F.array_join(missing, ", ")))
    values = {}
    for n, f in named.items():
        c = F.col(f"r.{n}")
        if f.name in ENUMS:
            c = one_of(c, *ENUMS[f.name])
        elif isinstance(f.dataType, T.TimestampType):
            c = F.coalesce(instant(c), F.current_timestamp() if now is None else now)
        elif f.name == "metadata":
            c = F.coalesce(c, F.create_map().cast(f.dataType))
        elif f.name == "block_id":
            c = F.coalesce(F.nullif(c, F.lit("")), F.md5("record"))
        elif f.name in ("result_id", "decision_id"):
            c = pair_id(F.col("r.block_id_1"), F.col("r.block_id_2"), one_of(F.col("r.analysis_type"), *ENUMS["analysis_type"]))
        values[f.name] = c
    rows = rows.withColumn("reject", reject)
    return rows.select(*(F.when(F.col("reject").isNull(), c).alias(n) for n, c in values.items()), "record", "reject")


def accepted(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where("reject IS NULL").select(*SCHEMAS[kind].names)


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where("reject IS NOT NULL").select("reject", "record")


def encoded(rows: DataFrame, kind: str) -> DataFrame:
    """value: each row of the table as JSON with all its fields, nulls too, and times in UTC; decoded() gives the same row back
    if its required fields aren't null and its enumerations are known."""
    c = lambda f: iso(F.col(f.name)) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
    return rows.select(F.to_json(F.struct(*(c(f).alias(n) for n, f in _named(kind).items())), {"ignoreNullFields": "false"}).alias("value"))
