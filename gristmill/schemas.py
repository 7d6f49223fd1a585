"""Record schemas, value sets and key formats (fixed values that results depend on)."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations, in natural order.
BLOCK_TYPES = ("unknown", "text", "heading", "list_item", "code", "code_merged", "table")
ANALYSIS_TYPES = ("unknown", "md5_duplicate", "semantic_similarity")
DECISION_TYPES = ("undecided", "keep", "merge", "ignore", "mark_duplicate", "mark_similar", "delete")
BLOCK_DECISIONS = ("keep", "delete", "undecided")
MARKDOWN_SUFFIXES = (".md", ".markdown")
KEY_SEPARATOR = "::"
MISSING_KEY_PARTS = ("UNKNOWN_FILE", "UNKNOWN_ID", "UNKNOWN_TYPE")
OUTPUT_SUFFIX = "_deduped"
SIMILARITY_THRESHOLD = 0.80
STATUS_KEY = "kd_processing_status"
PAIR_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "timestamp": T.TimestampType(),
    "map": T.MapType(T.StringType(), T.StringType()),
}


def _fields(**types: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in types.items()])


FILES = _fields(file_id="string", path="string", registered_at="timestamp", metadata="map")
BLOCKS = _fields(file_id="string", path="string", block_id="string", pos="int", block_type="string", text="string", metadata="map")
RESULTS = _fields(result_id="string", block_id_1="string", block_id_2="string", analysis_type="string", score="double")
PAIR_DECISIONS = _fields(
    decision_id="string", block_id_1="string", block_id_2="string", analysis_type="string", decision="string", decided_at="timestamp", notes="string"
)
BLOCK_DECISION_TABLE = _fields(path="string", block_id="string", block_type="string", decision="string", decided_at="timestamp")
DUPLICATE_FILE = _fields(path="string", size="bigint", modified="bigint")
DUPLICATE_GROUPS = T.ArrayType(T.StructType([T.StructField("files", T.ArrayType(DUPLICATE_FILE)), T.StructField("header", T.StringType())]))
