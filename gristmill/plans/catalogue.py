"""Named queries over the engine's operators, each with DuckDB SQL where SQL can say the same.

A document is a file and each of its lines that isn't blank a block.  `labels` stand in for earlier decisions.  Where a
query needs typed blocks, types are put on by the line's place, so that every rule is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import codecs
from ..functions import paths
from ..functions import text as fn
from ..operators import decisions as dec
from ..operators import duplicates, encoding, lineage, merge, render, semantic, simhash
from ..sources import files as src
from ..sources import scans
from ..shipping import scratch
from ..store import Store, decisions_matching, results_matching

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_SPACES = " || ".join(f"chr({c})" for c in range(0x3001) if chr(c).isspace())
#: The oracle's view of files, lines and decisions.
_BASE = f"""
WITH files AS (SELECT doc_id, source || '/doc' || doc_id || '.md' AS path, md5(source || '/doc' || doc_id || '.md') AS file_id, coalesce(text, '') AS content FROM documents),
lines AS (SELECT doc_id, path, file_id, i - 1 AS pos, s[i] AS raw FROM (SELECT *, string_split(content, chr(10)) AS s, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM files)),
blocks AS (SELECT doc_id, path, file_id, file_id || '#' || pos AS block_id, pos::INT AS pos, raw, trim(raw, {_SPACES}) AS text FROM lines WHERE trim(raw, {_SPACES}) <> ''),
prior AS (SELECT doc_id, CASE WHEN min(toxic) = 1 THEN 'delete' WHEN min(quality) = 1 THEN 'keep' ELSE 'undecided' END AS decision FROM labels GROUP BY doc_id),
decided AS (SELECT b.*, coalesce(p.decision, 'undecided') AS decision FROM blocks b LEFT JOIN prior p USING (doc_id)),
g AS (SELECT *, md5('text:' || text) AS h FROM decided WHERE decision <> 'delete'),
groups AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY path, block_id) AS rank FROM g) WHERE n > 1)
"""


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE_SQL[f.__name__] = oracle if oracle.lstrip().startswith("WITH") else _BASE + oracle
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return src.document_files(_table(spark, d, "documents"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Line blocks: path, file_id, block_id, pos, block_type text, raw_text and stripped text."""
    rows = src.split_lines(_files(spark, d))
    block_id = F.concat_ws("#", "file_id", F.col("pos").cast("string"))
    return rows.select("file_id", "path", block_id.alias("block_id"), "pos", F.lit("text").alias("block_type"), "raw_text", fn.strip(F.col("raw_text")).alias("text"))


def _prior(spark: SparkSession, d: str) -> DataFrame:
    """Earlier decisions of documents, by doc_id."""
    label = _table(spark, d, "labels").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min("quality").alias("quality"))
    decision = F.when(F.col("toxic") == 1, "delete").when(F.col("quality") == 1, "keep").otherwise("undecided")
    return label.select("doc_id", decision.alias("decision"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    """Line blocks with their document's decision, which is joined before documents are split."""
    docs = _table(spark, d, "documents").join(_prior(spark, d), "doc_id", "left").withColumn("decision", F.coalesce("decision", F.lit("undecided")))
    files = src.document_files(docs, "decision")
    rows = src.split_lines(files, "decision")
    block_id = F.concat_ws("#", "file_id", F.col("pos").cast("string"))
    return rows.select("file_id", "path", block_id.alias("block_id"), "pos", F.lit("text").alias("block_type"), "raw_text", fn.strip(F.col("raw_text")).alias("text"), "decision")


_EMPTY = lambda c: F.lit("undecided").alias(c)


@query("SELECT file_id, path, length(content)::INT AS n_chars FROM files WHERE regexp_matches(lower(path), '\\.(md|markdown)$') AND len(string_split(path, '/')) <= 2")
def file_scan_filter(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    return f.where(src.has_suffix(F.col("path")) & (src.depth(F.col("path"), "") <= 1)).select("file_id", "path", F.length("content").alias("n_chars"))


@query("SELECT file_id, path, pos, raw AS raw_text, text FROM blocks")
def blocks_from_documents(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("file_id", "path", "pos", "raw_text", "text")


def _marked(c: Column, pos: Column) -> Column:
    """Lines with Markdown marks put before them by their place."""
    return (
        F.when(pos % 7 == 0, F.concat(F.lit("## "), c))
        .when(pos % 7 == 1, F.concat(F.lit("- "), c))
        .when(pos % 7 == 2, F.concat(F.lit("```\n"), c, F.lit("\n```")))
        .when(pos % 7 == 3, F.concat(F.lit("12. "), c))
        .when(pos % 7 == 4, F.lit("1234"))
        .when(pos % 7 == 5, F.concat(F.lit("> see [the "), c, F.lit("](http://x) ")))
        .otherwise(c)
    )


_MARKED = "CASE pos % 7 WHEN 0 THEN '## ' || raw WHEN 1 THEN '- ' || raw WHEN 2 THEN '```' || chr(10) || raw || chr(10) || '```' WHEN 3 THEN '12. ' || raw WHEN 4 THEN '1234' WHEN 5 THEN '> see [the ' || raw || '](http://x) ' ELSE raw END"
_TYPED = f"""typed AS (SELECT *, CASE WHEN m LIKE '```%' THEN 'CodeSnippet' WHEN regexp_matches(m, '^#{{1,6}}\\s+') THEN 'Title'
  WHEN regexp_matches(m, '^\\s*([-*+]|\\d+\\.)\\s+') THEN 'ListItem' WHEN regexp_matches(m, '[a-zA-Z\\x{{4e00}}-\\x{{9fff}}]') AND NOT regexp_matches(m, '^(#+\\s*|[-*+]\\s*|>\\s*)$') THEN 'NarrativeText' ELSE 'Text' END AS element_type
  FROM (SELECT *, {_MARKED} AS m FROM blocks))"""


@query(
    _BASE
    + f""", {_TYPED} SELECT block_id, element_type, CASE element_type WHEN 'Title' THEN 'heading' WHEN 'ListItem' THEN 'list_item' WHEN 'CodeSnippet' THEN 'code' ELSE 'text' END AS block_type FROM typed"""
)
def infer_block_type(spark: SparkSession, d: str) -> DataFrame:
    raw = _marked(F.col("raw_text"), F.col("pos"))
    typed = _lines(spark, d).withColumn("element_type", fn.infer_element_type(F.lit("Text"), raw))
    return typed.select("block_id", "element_type", fn.block_type(F.col("element_type")).alias("block_type"))


@query(
    _BASE
    + f""", {_TYPED} SELECT block_id, CASE element_type WHEN 'CodeSnippet' THEN trim(m, {_SPACES}) WHEN 'Title' THEN trim(regexp_replace(m, '^#{{1,6}}\\s+', ''), {_SPACES})
    ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(m, '`', ''), '\\[(.*?)\\]\\(.*?\\)', '\\1', 'g'), '^\\s*([-*+]|\\d+\\.)\\s+', ''), '^\\s*>\\s?', ''), '\\s+', ' ', 'g')) END AS text FROM typed"""
)
def normalize_blocks(spark: SparkSession, d: str) -> DataFrame:
    raw = _marked(F.col("raw_text"), F.col("pos"))
    element = fn.infer_element_type(F.lit("Text"), raw)
    return _lines(spark, d).select("block_id", fn.normalize(element, raw, emphasis=False).alias("text"))


# Escaped marks are set aside, as SQL's expressions can't look behind.
_ASIDE = {c: 0xE000 + k for k, c in enumerate("*_~")}
_PLAIN = "replace(m, '`', '')"
for _c, _code in _ASIDE.items():
    _PLAIN = f"replace({_PLAIN}, chr(92) || '{_c}', chr({_code}))"
_PLAIN = f"regexp_replace({_PLAIN}, '[*_~]{{1,2}}(.+?)[*_~]{{1,2}}', '\\1', 'g')"
for _c, _code in _ASIDE.items():
    _PLAIN = f"replace({_PLAIN}, chr({_code}), chr(92) || '{_c}')"


@query(ORACLE_SQL["normalize_blocks"].replace("replace(m, '`', '')", _PLAIN))
def normalize_blocks_full(spark: SparkSession, d: str) -> DataFrame:
    raw = _marked(F.col("raw_text"), F.col("pos"))
    return _lines(spark, d).select("block_id", fn.normalize(fn.infer_element_type(F.lit("Text"), raw), raw).alias("text"))


@query("SELECT block_id, md5('text:' || text) AS h FROM blocks")
def md5_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("block_id", fn.fingerprint(F.col("block_type"), F.col("text")).alias("h"))


def _undecided(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.exact_groups(_lines(spark, d).withColumn("decision", F.lit("undecided")))


@query("SELECT h, count(*) AS n, min(path) AS first_path FROM (SELECT md5('text:' || text) AS h, path FROM blocks) GROUP BY h HAVING count(*) > 1")
def md5_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.group_heads(_lines(spark, d).withColumn("decision", F.lit("undecided"))).select("h", "n", F.col("path").alias("first_path"))


@query("SELECT path, block_id, CASE WHEN rank = 1 THEN 'keep' ELSE 'delete' END AS suggestion FROM (SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY path, block_id) AS rank, count(*) OVER (PARTITION BY md5(text)) AS n FROM blocks) WHERE n > 1")
def md5_keep_delete(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.suggestions(_undecided(spark, d)).select("path", "block_id", "suggestion")


@query("SELECT block_id, h, n, rank, decision FROM groups")
def md5_groups_with_prior_decisions(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.ranked(duplicates.exact_groups(_decided(spark, d))).select("block_id", "h", "n", "rank", "decision")


@query("SELECT d.block_id, CASE WHEN d.decision = 'undecided' AND gr.rank = 1 THEN 'keep' WHEN d.decision = 'undecided' AND gr.rank > 1 THEN 'delete' ELSE d.decision END AS decision FROM decided d LEFT JOIN groups gr USING (block_id)")
def decision_precedence(spark: SparkSession, d: str) -> DataFrame:
    decided = _decided(spark, d)
    return duplicates.applied(decided, duplicates.suggestions(duplicates.exact_groups(decided))).select("block_id", "decision")


@query("SELECT coalesce(CASE WHEN decision = 'delete' THEN 'deleted' END, 'none') AS reason, count(*) AS n FROM decided GROUP BY 1")
def skip_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).groupBy(F.coalesce(duplicates.skip_reason(), F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT sha256(content) AS digest, strlen(content) AS size, count(*) AS n_files, min(path) AS first_path FROM files GROUP BY ALL HAVING count(*) >= 2")
def file_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.file_group_heads(_files(spark, d))


@query("SELECT path FROM (SELECT path, count(*) OVER (PARTITION BY content) AS n FROM files) WHERE n = 1")
def unique_files_strict(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.unique_files(_files(spark, d))


@query("SELECT min(path) AS path FROM files GROUP BY content")
def unique_files_keep_first(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.unique_files(_files(spark, d), "keep_first")


@query("SELECT path FROM (SELECT path, count(*) OVER (PARTITION BY content) AS n FROM files WHERE strlen(content) BETWEEN 1024 AND 8192) WHERE n = 1")
def unique_files_sized(spark: SparkSession, d: str) -> DataFrame:
    return duplicates.unique_files(_files(spark, d), min_size=1024, max_size=8192)


@query("SELECT id_1, id_2, round(s, 6) AS score FROM (SELECT a.vec_id AS id_1, b.vec_id AS id_2, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE s >= 0.4")
def semantic_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = semantic.similar_pairs(_table(spark, d, "embeddings"), 0.4, "vec_id")
    return semantic.ranked(pairs).withColumn("score", F.round("score", 6))


@query("SELECT id_1, id_2, round(s, 6) AS score FROM (SELECT a.vec_id AS id_1, b.vec_id AS id_2, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label % 3 <> 0 AND b.label % 3 <> 0) WHERE s >= 0.4")
def semantic_pairs_filtered(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("label") % 3 == 0, "heading").otherwise("text")
    rows = _table(spark, d, "embeddings").withColumns({"block_type": kind, "path": F.lit("p"), "decision": F.lit("undecided")})
    return semantic.similar_pairs(semantic.eligible(rows), 0.4, "vec_id").withColumn("score", F.round("score", 6))


@query("SELECT md5(text) AS text_md5, bool_or(pos % 2 = 0) AS cached, CASE WHEN bool_or(pos % 2 = 0) THEN 1 ELSE 64 END AS dimensions FROM blocks GROUP BY 1")
def distinct_text_cache(spark: SparkSession, d: str) -> DataFrame:
    """Texts of even places are in the cache, as vectors of one component; only the others are encoded, once each."""
    lines = _lines(spark, d)
    cache = lines.where("pos % 2 = 0").select(F.md5("text").alias("text_md5"), F.array(F.lit(-1.0)).alias("embedding")).distinct()
    vectors = semantic.encoded_texts(lines, semantic.hashing_encoder, cache=cache)
    return vectors.select("text_md5", (F.col("embedding")[0] == -1.0).alias("cached"), F.size("embedding").alias("dimensions"))


@query("SELECT b.block_id, CASE WHEN pos % 3 = 0 THEN 'undecided' WHEN pos % 3 = 1 THEN 'keep' ELSE 'undecided' END AS decision FROM blocks b")
def decisions_by_key(spark: SparkSession, d: str) -> DataFrame:
    """Decisions joined to blocks by key: none for a third of them, an invalid value for another."""
    lines = _lines(spark, d)
    known = lines.where("pos % 3 <> 0").select(*duplicates.KEY, F.when(F.col("pos") % 3 == 1, "keep").otherwise("maybe").alias("decision"))
    return duplicates.with_decisions(lines, known).select("block_id", "decision")


@query("SELECT block_id, CASE WHEN pos % 3 = 0 THEN text ELSE upper(block_id) END AS analysis_text FROM blocks")
def analysis_texts(spark: SparkSession, d: str) -> DataFrame:
    own = F.when(F.col("pos") % 3 != 0, F.upper("block_id"))
    return src.with_analysis_text(_lines(spark, d).withColumn("analysis_text", own)).select("block_id", "analysis_text")


@query("SELECT path, 1002 AS code, 'not UTF-8' AS reason FROM files WHERE doc_id % 5 = 0")
def quarantined_files(spark: SparkSession, d: str) -> DataFrame:
    """A file in five ends with a byte that UTF-8 doesn't have."""
    bad = F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("FF"))).otherwise(F.lit("").cast("binary"))
    docs = _table(spark, d, "documents")
    files = src.document_files(docs, "doc_id").withColumn("content", F.concat(F.col("content").cast("binary"), bad))
    return src.quarantined(files)


@query(
    """SELECT result_id, block_id_1, preview_1, block_id_2, preview_2, score, decision FROM (
  SELECT lpad(doc_id::VARCHAR, 12, '0') AS result_id, 'a' || doc_id AS block_id_1, 'first ' || doc_id AS preview_1, 'b' || doc_id AS block_id_2, 'second ' || doc_id AS preview_2,
         (doc_id % 7) / 10.0::DOUBLE AS score, CASE WHEN doc_id % 3 = 0 THEN 'keep' ELSE 'undecided' END AS decision FROM files) ORDER BY score DESC, result_id LIMIT 20 OFFSET 20"""
)
def pair_review_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty pairs under review."""
    docs = _table(spark, d, "documents").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("result_id"))
    of = lambda sign: F.concat(F.lit(sign), F.col("doc_id").cast("string"))
    pairs = docs.select("result_id", of("a").alias("block_id_1"), of("b").alias("block_id_2"), ((F.col("doc_id") % 7) / 10.0).alias("score"))
    decided = docs.where("doc_id % 3 = 0").select(F.col("result_id").alias("decision_id"), F.lit("keep").alias("decision"))
    blocks = docs.select(of("a").alias("block_id"), of("first ").alias("text")).unionByName(docs.select(of("b").alias("block_id"), of("second ").alias("text")))
    return dec.pair_review(pairs, decided, blocks, 1, 20)


_RESULTS = """, pairs AS (SELECT block_id AS a, lead(block_id) OVER (PARTITION BY h ORDER BY path, block_id) AS b, rank, n FROM groups),
named AS (SELECT a, b, rank, n, CASE WHEN rank % 2 = 1 THEN 'md5_duplicate' ELSE 'semantic_similarity' END AS t FROM pairs WHERE b IS NOT NULL),
hashed AS (SELECT *, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(least(a, b) || '_' || greatest(a, b) || '_' || t)) AS x FROM named),
results AS (SELECT substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', ((strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4) + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS result_id,
  a AS block_id_1, b AS block_id_2, t AS analysis_type, (rank % 10) / 10.0::DOUBLE AS score, rank FROM hashed),
pair_decisions AS (SELECT result_id AS decision_id, block_id_1, block_id_2, analysis_type, CASE rank % 3 WHEN 0 THEN 'keep' WHEN 1 THEN 'undecided' ELSE 'delete' END AS decision FROM results WHERE rank % 4 <> 0)
"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    after = F.lead("block_id").over(Window.partitionBy("h").orderBy("path", "block_id"))
    rows = duplicates.ranked(duplicates.exact_groups(_decided(spark, d))).withColumn("block_id_2", after).where("block_id_2 IS NOT NULL")
    kind = F.when(F.col("rank") % 2 == 1, "md5_duplicate").otherwise("semantic_similarity")
    rows = rows.select(F.col("block_id").alias("block_id_1"), "block_id_2", kind.alias("analysis_type"), ((F.col("rank") % 10) / 10.0).alias("score"), "rank")
    return rows.withColumn("result_id", fn.pair_id(F.col("block_id_1"), F.col("block_id_2"), F.col("analysis_type")))


def _pair_decisions(spark: SparkSession, d: str) -> DataFrame:
    decision = F.when(F.col("rank") % 3 == 0, "keep").when(F.col("rank") % 3 == 1, "undecided").otherwise("delete")
    return _results(spark, d).where("rank % 4 <> 0").select(F.col("result_id").alias("decision_id"), "block_id_1", "block_id_2", "analysis_type", decision.alias("decision"))


@query(_RESULTS + "SELECT result_id, block_id_1, block_id_2, analysis_type FROM results")
def result_ids_uuid5(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).select("result_id", "block_id_1", "block_id_2", "analysis_type")


@query(_RESULTS + "SELECT result_id, score FROM results WHERE analysis_type = 'md5_duplicate' AND score >= 0.3")
def results_min_score(spark: SparkSession, d: str) -> DataFrame:
    return results_matching(_results(spark, d), "md5_duplicate", min_score=0.3).select("result_id", "score")


@query(_RESULTS + ", one AS (SELECT min(block_id_1) AS b FROM results) SELECT result_id FROM results, one WHERE analysis_type = 'md5_duplicate' AND (block_id_1 = b OR block_id_2 = b)")
def results_by_block(spark: SparkSession, d: str) -> DataFrame:
    rows = _results(spark, d)
    return results_matching(rows, "md5_duplicate", block_id=rows.agg(F.min("block_id_1")).first()[0] or "").select("result_id")


@query(_RESULTS + "SELECT decision_id, decision FROM pair_decisions WHERE decision = 'keep' AND analysis_type = 'md5_duplicate'")
def decisions_filtered(spark: SparkSession, d: str) -> DataFrame:
    return decisions_matching(_pair_decisions(spark, d), decision="keep", analysis_type="md5_duplicate").select("decision_id", "decision")


@query(_RESULTS + "SELECT result_id FROM results r WHERE NOT EXISTS (SELECT 1 FROM pair_decisions p WHERE p.decision_id = r.result_id AND p.decision <> 'undecided')")
def undecided_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dec.undecided_pairs(_results(spark, d), _pair_decisions(spark, d)).select("result_id")


@query("SELECT block_id, CASE WHEN pos % 5 = 0 THEN 'UNKNOWN_FILE' ELSE path END || '::' || block_id || '::text' AS decision_key FROM blocks")
def decision_keys(spark: SparkSession, d: str) -> DataFrame:
    path = F.when(F.col("pos") % 5 == 0, "").otherwise(F.col("path"))
    return _lines(spark, d).select("block_id", fn.decision_key(path, F.col("block_id"), F.col("block_type")).alias("decision_key"))


@query("SELECT block_id AS id, path || '::x' AS path, block_id, 'text' AS block_type FROM blocks WHERE pos % 3 <> 0 UNION ALL SELECT block_id, NULL, NULL, NULL FROM blocks WHERE pos % 3 = 0")
def parse_decision_keys(spark: SparkSession, d: str) -> DataFrame:
    key = F.when(F.col("pos") % 3 == 0, F.col("path")).otherwise(F.concat_ws("::", "path", F.lit("x"), "block_id", "block_type"))
    return _lines(spark, d).select(F.col("block_id").alias("id"), fn.parsed_key(key).alias("k")).select("id", "k.*")


@query("SELECT block_id, CASE WHEN length(text) > 80 THEN text[1:80] || '...' ELSE text END AS preview FROM blocks")
def block_previews(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).select("block_id", fn.preview(F.col("raw_text")).alias("preview"))


@query("SELECT path, block_id, pos FROM (SELECT path, block_id, pos, row_number() OVER (ORDER BY path, CASE WHEN len(regexp_replace(block_id, '\\D', '', 'g')) > 10 THEN regexp_replace(block_id, '\\D', '', 'g') ELSE lpad(regexp_replace(block_id, '\\D', '', 'g'), 10, '0') END, block_id) AS r FROM blocks) WHERE r <= 100")
def blocks_in_review_order(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a hundred in numeric-aware order."""
    rows = _lines(spark, d).withColumn("k", fn.sort_key(F.col("path"), F.col("block_id")))
    return dec.page(rows, ["k", "block_id"], 0, 100).select("path", "block_id", "pos")


@query("WITH e AS (SELECT user_id, event_type, max_by(event_id, event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY ALL) SELECT * FROM e")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").select("user_id", "event_type", "event_id", "value", F.col("event_id").alias("_v"))
    return dec.latest(rows, ["user_id", "event_type"], "_v").drop("_v").select("user_id", "event_type", "event_id", "value")


@query("SELECT block_id, 'delete' AS decision FROM groups WHERE rank > 1 AND decision <> 'delete'")
def changed_decisions(spark: SparkSession, d: str) -> DataFrame:
    decided = _decided(spark, d)
    new = dec.delete_all_but_first(duplicates.exact_groups(decided))
    return dec.changed(new, decided.select(*duplicates.KEY, "decision")).select("block_id", "decision")


_FINAL = """, final AS (SELECT d.*, CASE WHEN d.decision = 'undecided' AND gr.rank = 1 THEN 'keep' WHEN d.decision = 'undecided' AND gr.rank > 1 THEN 'delete' ELSE d.decision END AS new FROM decided d LEFT JOIN (SELECT block_id, rank FROM groups) gr USING (block_id)) """


@query(_FINAL + "SELECT replace(path, '.md', '_deduped.md') AS output_path, md5(string_agg(CASE WHEN pos % 4 = 0 THEN '# ' || text WHEN pos % 4 = 1 THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10) || chr(10) ORDER BY pos)) AS content_md5 FROM final WHERE new <> 'delete' GROUP BY path")
def render_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    decided = _decided(spark, d)
    done = duplicates.applied(decided, duplicates.suggestions(duplicates.exact_groups(decided)))
    kind = F.when(F.col("pos") % 4 == 0, "heading").when(F.col("pos") % 4 == 1, "code").otherwise("text")
    return render.render(done.withColumn("block_type", kind)).select("output_path", F.md5("content").alias("content_md5"))


@query(_FINAL + "SELECT count(*) AS blocks, count(*) FILTER (new IN ('keep', 'delete')) AS decided, count(*) FILTER (new = 'undecided') AS undecided, (SELECT count(*) FROM groups WHERE rank = 1) AS exact_groups, (SELECT count(*) FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4) AS similar_pairs FROM final")
def status_summary(spark: SparkSession, d: str) -> DataFrame:
    decided = _decided(spark, d)
    members = duplicates.exact_groups(decided)
    pairs = semantic.similar_pairs(_table(spark, d, "embeddings"), 0.4, "vec_id")
    return dec.status(duplicates.applied(decided, duplicates.suggestions(members)), members, pairs)


@query(
    """SELECT 1 AS version, path, 'keep' AS decision FROM files WHERE doc_id % 2 = 0
UNION ALL SELECT 2, path, CASE WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'keep' END FROM files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
UNION ALL SELECT 4, path, CASE WHEN doc_id % 5 = 0 THEN 'undecided' WHEN doc_id % 3 = 0 THEN 'delete' ELSE 'keep' END FROM files WHERE doc_id % 2 = 0 OR doc_id % 3 = 0 OR doc_id % 5 = 0"""
)
def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """A table's rows at each of its versions: three upserts, and a compaction (version 3) between the last two."""
    files = src.document_files(_table(spark, d, "documents"), "doc_id")
    row = files.select("doc_id", "path", F.lit("all").alias("block_id"), F.lit("text").alias("block_type"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("decided_at"))
    store = Store(spark, scratch(spark, "store"), ranges=8)
    for step, (n, decision) in enumerate(((2, "keep"), (3, "delete"), (5, "undecided"))):
        if step == 2:
            store.compact("block_decisions", 2)
        store.upsert("block_decisions", row.where(F.col("doc_id") % n == 0).withColumn("decision", F.lit(decision)))
    at = lambda v: store.read("block_decisions", version=v).select(F.lit(v).alias("version"), "path", "decision")
    return at(1).unionByName(at(2)).unionByName(at(4))


@query(
    """SELECT path, CASE WHEN doc_id % 11 = 0 AND doc_id % 13 <> 0 THEN 'new' WHEN doc_id % 13 = 0 THEN 'gone' WHEN doc_id % 7 = 0 OR doc_id % 5 = 0 THEN 'changed' ELSE 'unchanged' END AS state
FROM files WHERE NOT (doc_id % 11 = 0 AND doc_id % 13 = 0)"""
)
def file_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two listings of the same files: some are in one only, some have another size, some another time."""
    files = src.document_files(_table(spark, d, "documents"), "doc_id").select("doc_id", "path", F.octet_length("content").cast("long").alias("size"), F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("modified"))
    other = lambda n, c, by: F.when(F.col("doc_id") % n == 0, by).otherwise(F.col(c)).alias(c)
    after = files.where("doc_id % 13 <> 0").select("path", other(7, "size", F.col("size") + 1), other(5, "modified", F.col("modified") + F.expr("INTERVAL 1 SECOND")))
    return scans.changes(files.where("doc_id % 11 <> 0"), after)


@query(
    _BASE
    + """, l AS (SELECT path[1:2] AS root, TIMESTAMP '2024-01-01 10:00:00' + to_minutes((doc_id % 90)::INT) AS scanned_at, path, sha256(content) AS digest, strlen(content) AS size FROM files),
f AS (SELECT * FROM l WHERE scanned_at BETWEEN TIMESTAMP '2024-01-01 10:30:00' AND TIMESTAMP '2024-01-01 11:15:00')
SELECT root, path, count(*) OVER (PARTITION BY root, digest, size) AS n_files FROM f WHERE scanned_at = (SELECT max(scanned_at) FROM f g WHERE g.root = f.root)"""
)
def recent_scans(spark: SparkSession, d: str) -> DataFrame:
    """Of scans made at different times, each root's latest that is no older than 45 minutes, and the copies in it."""
    files = src.document_files(_table(spark, d, "documents"), "doc_id")
    at = F.to_timestamp(F.lit("2024-01-01 10:00:00")) + F.make_dt_interval(mins=(F.col("doc_id") % 90).cast("int"))
    log = files.select(F.substring("path", 1, 2).alias("root"), at.alias("scanned_at"), "path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))
    last = scans.latest_scans(log, F.to_timestamp(F.lit("2024-01-01 11:15:00")), 2700)
    counted = last.groupBy("root", "digest", "size").agg(F.count("*").alias("n_files"))
    return last.join(counted, ["root", "digest", "size"]).select("root", "path", "n_files")


_FENCED = {2: "````py", 4: "```", 5: "```", 6: "````", 11: "", 13: "====", 15: "~~~", 16: "~~~~"}
_BEFORE = {8: "## ", 9: "- ", 10: "    ", 14: "| "}


def _markdown(line: Column, i: Column) -> Column:
    """A line of Markdown made of a line by its place: fences within fences, headings, lists, tables, indented code."""
    out = F.when(i % 17 == 14, F.concat(F.lit("| "), line, F.lit(" |")))
    for k, mark in _FENCED.items():
        out = out.when(i % 17 == k, F.lit(mark))
    for k, mark in _BEFORE.items():
        out = out.when(i % 17 == k, F.concat(F.lit(mark), line))
    return out.otherwise(line)


_MARKDOWN = "CASE (i - 1) % 17 WHEN 14 THEN '| ' || x || ' |' " + "".join(f"WHEN {k} THEN '{m}' " for k, m in _FENCED.items()) + "".join(f"WHEN {k} THEN '{m}' || x " for k, m in _BEFORE.items()) + "ELSE x END"


@query(
    _BASE
    + rf""", md AS (SELECT file_id, list_transform(string_split(content, chr(10)), lambda x, i: {_MARKDOWN}) AS lines FROM files),
marks AS (SELECT *, list_filter(list_transform(lines, lambda x, i: {{'at': (i - 1)::INT, 'mark': regexp_extract(x, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 1), 'rest': regexp_extract(x, '^ {{0,3}}(`{{3,}}|~{{3,}})(.*)$', 2), 'spans': []::STRUCT(first INT, last INT)[]}}), lambda x: x.mark <> '') AS m FROM md),
folded AS (SELECT *, list_reduce(m, lambda s, x: CASE
  WHEN s.at < 0 AND (x.mark LIKE '~%' OR NOT contains(x.rest, '`')) THEN {{'at': x.at, 'mark': x.mark, 'rest': '', 'spans': s.spans}}
  WHEN s.at >= 0 AND starts_with(x.mark, s.mark) AND trim(x.rest, {_SPACES}) = '' THEN {{'at': (-1)::INT, 'mark': '', 'rest': '', 'spans': list_append(s.spans, {{'first': s.at, 'last': x.at}})}}
  ELSE s END, {{'at': (-1)::INT, 'mark': '', 'rest': '', 'spans': []::STRUCT(first INT, last INT)[]}}) AS s FROM marks),
spans AS (SELECT file_id, lines, CASE WHEN s.at >= 0 THEN list_append(s.spans, {{'first': s.at, 'last': (len(lines) - 1)::INT}}) ELSE s.spans END AS spans FROM folded),
u0 AS (SELECT file_id, unnest(lines) AS raw, unnest(range(len(lines)))::INT AS line FROM spans),
f0 AS (SELECT file_id, unnest(spans, recursive := true) FROM spans),
f1 AS (SELECT f.file_id, f.first AS line, string_agg(u.raw, chr(10) ORDER BY u.line) AS raw FROM f0 f JOIN u0 u ON f.file_id = u.file_id AND u.line BETWEEN f.first AND f.last GROUP BY ALL),
u AS (SELECT file_id, line, raw, true AS fence FROM f1 UNION ALL SELECT file_id, line, raw, false FROM u0 WHERE NOT EXISTS (SELECT 1 FROM f0 WHERE f0.file_id = u0.file_id AND u0.line BETWEEN f0.first AND f0.last)),
k0 AS (SELECT *, CASE WHEN fence THEN 'fence' WHEN trim(raw, {_SPACES}) = '' THEN 'blank' WHEN regexp_matches(raw, '^#{{1,6}}\s+') THEN 'Title' WHEN regexp_matches(raw, '^\s*([-*+]|\d+\.)\s+') THEN 'ListItem'
  WHEN regexp_matches(raw, '^\s*\|.*\|\s*$') THEN 'Table' WHEN regexp_matches(raw, '^( {{4}}| {{0,3}}\t)') THEN 'indented' ELSE 'Text' END AS kind FROM u),
k1 AS (SELECT *, last_value(CASE WHEN kind NOT IN ('blank', 'indented') THEN kind END IGNORE NULLS) OVER w AS behind,
  coalesce(max(CASE WHEN kind = 'blank' THEN line END) OVER w, -1) > coalesce(max(CASE WHEN kind NOT IN ('blank', 'indented') THEN line END) OVER w, -1) AS gap FROM k0 WINDOW w AS (PARTITION BY file_id ORDER BY line)),
k2 AS (SELECT file_id, line, raw, CASE WHEN kind <> 'indented' THEN kind WHEN behind = 'ListItem' OR (behind = 'Text' AND NOT gap) THEN 'Text' ELSE 'code' END AS kind FROM k1),
k3 AS (SELECT *, regexp_matches(raw, '^ {{0,3}}(=+|-+)\s*$') AND kind = 'Text' AS looks, lag(kind) OVER (PARTITION BY file_id ORDER BY line) AS before FROM k2),
k4 AS (SELECT *, looks AND coalesce(before = 'Text' AND NOT lag(looks) OVER (PARTITION BY file_id ORDER BY line), false) AS under FROM k3),
k5 AS (SELECT *, before IS NULL OR kind <> before OR kind IN ('Title', 'ListItem', 'fence') OR coalesce(lag(under) OVER (PARTITION BY file_id ORDER BY line), false) AS opens FROM k4),
k6 AS (SELECT *, sum(opens::INT) OVER (PARTITION BY file_id ORDER BY line) AS element FROM k5),
k7 AS (SELECT file_id, element, CASE WHEN bool_or(under) THEN 'Title' WHEN any_value(kind) IN ('fence', 'code') THEN 'CodeSnippet' ELSE any_value(kind) END AS element_type,
  coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (NOT under), '') AS raw_text FROM k6 WHERE kind <> 'blank' GROUP BY file_id, element)
SELECT file_id, (row_number() OVER (PARTITION BY file_id ORDER BY element) - 1)::INT AS pos, element_type, md5(raw_text) AS raw_md5 FROM k7"""
)
def markdown_elements(spark: SparkSession, d: str) -> DataFrame:
    made = F.array_join(F.transform(F.split("content", "\n", -1), _markdown), "\n")
    return src.split_markdown(_files(spark, d).withColumn("content", made)).select("file_id", "pos", "element_type", F.md5("raw_text").alias("raw_md5"))


def _merging(text: str, kind: str) -> str:
    """SQL of merge_code_blocks() over lines whose text and type are given: the fold as a list_reduce, bodies by windows."""
    state = "{{'at': {at}::INT, 'gap': {gap}::INT, 'code': false, 'closes': false, 'starts': false, 'spans': {spans}}}"
    none = "[]::STRUCT(first INT, last INT)[]"
    return (
        _BASE
        + rf""", m0 AS (SELECT file_id, block_id, pos, {kind} AS kind, {text} AS text FROM blocks),
m1 AS (SELECT *, trim(text, {_SPACES}) AS bare, (row_number() OVER w - 1)::INT AS i, lead(trim(text, {_SPACES})) OVER w AS following FROM m0 WINDOW w AS (PARTITION BY file_id ORDER BY pos, block_id)),
m2 AS (SELECT *, kind = 'code' AS code, kind = 'code' AND bare = '```' AS closes, kind = 'code' AND starts_with(bare, '```') AND bare <> '```' AS opens FROM m1),
m3 AS (SELECT *, NOT (opens AND ends_with(bare, '```')) AND (opens OR (closes AND coalesce(following = '```', false))) AS starts FROM m2),
m4 AS (SELECT file_id, count(*)::INT AS n, list_reduce(list({{'at': i, 'gap': 0::INT, 'code': code, 'closes': closes, 'starts': starts, 'spans': {none}}} ORDER BY i), lambda s, x: CASE
  WHEN s.at < 0 AND x.starts THEN {state.format(at="x.at", gap="0", spans="s.spans")}
  WHEN s.at < 0 THEN s
  WHEN x.closes THEN {state.format(at="(-1)", gap="0", spans="list_append(s.spans, {'first': s.at, 'last': x.at})")}
  WHEN NOT x.code AND s.gap >= 1 THEN {state.format(at="(-1)", gap="0", spans="s.spans")}
  WHEN NOT x.code THEN {state.format(at="s.at", gap="(s.gap + 1)", spans="s.spans")}
  ELSE s END, {state.format(at="(-1)", gap="0", spans=none)}) AS s FROM m3 GROUP BY file_id),
m5 AS (SELECT file_id, unnest(CASE WHEN s.at >= 0 THEN list_append(s.spans, {{'first': s.at, 'last': n - 1}}) ELSE s.spans END, recursive := true) FROM m4),
m6 AS (SELECT r.*, first, last, r.i - first AS k, last - first + 1 AS members, strpos(text, chr(10)) AS nl FROM m3 r JOIN m5 s ON r.file_id = s.file_id AND r.i BETWEEN s.first AND s.last),
m7 AS (SELECT *, CASE WHEN nl = 0 THEN text ELSE text[1:nl] END AS head, CASE WHEN nl = 0 THEN '' ELSE text[nl + 1:] END AS behind, CASE WHEN ends_with(text, chr(10)) THEN text[1:length(text) - 1] ELSE text END AS u FROM m6),
m8 AS (SELECT *, starts_with(trim(head, {_SPACES}), '```') AND trim(head, {_SPACES}) <> '```' AS opening, CASE WHEN contains(u, chr(10)) THEN length(u) - strpos(reverse(u), chr(10)) + 1 ELSE 0 END AS p FROM m7),
m9 AS (SELECT *, k = 0 OR lag(bare) OVER w = '' OR ends_with(lag(text) OVER w, chr(10)) AS ended, CASE WHEN k = 1 AND lag(opening) OVER w AND lag(behind) OVER w = '' THEN chr(10) ELSE right(lag(text) OVER w, 1) END AS c, left(text, 1) AS d
  FROM m8 WINDOW w AS (PARTITION BY file_id, first ORDER BY i)),
m10 AS (SELECT *, CASE WHEN bare = '' THEN CASE WHEN ended THEN chr(10) ELSE chr(10) || chr(10) END
  WHEN k = 0 AND opening THEN CASE WHEN behind = '' THEN chr(10) ELSE behind END
  WHEN i = last AND trim(text[p + 1:], {_SPACES}) = '```' THEN text[1:p]
  WHEN NOT ended AND regexp_matches(c, '[\p{{L}}\p{{N}}_]') AND regexp_matches(d, '[\p{{L}}\p{{N}}_]') AND NOT (c = '_' AND d = '_') THEN ' ' || text ELSE text END AS part FROM m9),
m11 AS (SELECT file_id, first, min(pos) AS pos, count(*) AS token_count, count(*) = 2 AND bool_and(bare = '```') AS plain, string_agg(part, '' ORDER BY i) AS joined, arg_min(bare, i) AS bare FROM m10 GROUP BY file_id, first),
m12 AS (SELECT *, CASE WHEN plain THEN '' ELSE joined END AS body, CASE WHEN NOT plain THEN nullif(regexp_extract(bare, '^```([\p{{L}}\p{{N}}_]+)', 1), '') END AS language FROM m11)
SELECT file_id, pos, md5(file_id || body) AS block_id, 'code_merged' AS block_type, body AS text, 'keep' AS status, length(body)::INT AS char_count, token_count, language, NULL AS merged_into FROM m12
UNION ALL SELECT r.file_id, r.pos, r.block_id, r.kind, r.text, 'delete', length(r.text)::INT, 1, NULL, md5(r.file_id || m.body) FROM m10 r JOIN m12 m USING (file_id, first)
UNION ALL SELECT file_id, pos, block_id, kind, text, 'undecided', length(text)::INT, 1, NULL, NULL FROM m3 WHERE NOT EXISTS (SELECT 1 FROM m5 WHERE m5.file_id = m3.file_id AND m3.i BETWEEN first AND last)"""
    )


@query(_merging("CASE pos % 6 WHEN 1 THEN '```python' WHEN 4 THEN '```' ELSE text END", "CASE WHEN pos % 6 IN (1, 2, 3, 4) THEN 'code' ELSE 'text' END"))
def merge_code_fragments(spark: SparkSession, d: str) -> DataFrame:
    place = F.col("pos") % 6
    raw = F.when(place == 1, F.lit("```python")).when(place == 4, F.lit("```")).otherwise(F.col("text"))
    kind = F.when(place.isin(1, 2, 3, 4), "code").otherwise("text")
    return merge.merge_code_blocks(_lines(spark, d).withColumns({"text": raw, "block_type": kind}))


@query(
    _merging(
        "CASE pos % 11 WHEN 1 THEN '```py' || chr(10) || text || chr(10) WHEN 3 THEN text || chr(10) || text WHEN 4 THEN '  ' WHEN 6 THEN text || chr(10) || '```' WHEN 7 THEN '```' WHEN 8 THEN '```' WHEN 9 THEN '```' || text || chr(10) || '```' WHEN 10 THEN '```js' ELSE text END",
        "CASE WHEN pos % 11 IN (0, 5) THEN 'text' ELSE 'code' END",
    )
)
def merge_code_multiline(spark: SparkSession, d: str) -> DataFrame:
    """The same over blocks of several lines, blank ones, whole fenced ones and bare fences."""
    place, text = F.col("pos") % 11, F.col("text")
    forms = {1: ("```py\n", text, "\n"), 3: (text, "\n", text), 4: ("  ",), 6: (text, "\n```"), 7: ("```",), 8: ("```",), 9: ("```", text, "\n```"), 10: ("```js",)}
    raw = F.when(F.lit(False), text)
    for k, parts in forms.items():
        raw = raw.when(place == k, F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)))
    kind = F.when(place.isin(0, 5), "text").otherwise("code")
    return merge.merge_code_blocks(_lines(spark, d).withColumns({"text": raw.otherwise(text), "block_type": kind}))


@query()
def simhash_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("block_id"), "text")
    return simhash.similar(simhash.fingerprints(docs))


#: Spellings of a file's path (source, name), by its number.
_SPELLINGS = {
    0: ("file:///data/", "s", "/", "n"), 1: ("/data//", "s", "/./", "n"), 2: ("../", "s", "-x/", "n"), 3: ("/../", "s", "/x/../", "n"),
    4: ("S3A://bucket/", "s", "//y/z/../../", "n", "/"), 5: ("./", "s", "/", "n"), 6: ("s", "/../../", "n"), 7: ("hdfs://host:8020/", "s", "/../.."), 8: ("s", "/.."), 9: ("FILE:/a/../", "n", "/.../..x"),
}


def _spelt(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, source and a spelling of the path of each document."""
    part = {"s": F.coalesce("source", F.lit("")), "n": F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))}
    out = F.lit("")
    for k, spelling in _SPELLINGS.items():
        out = F.when(F.col("doc_id") % 11 == k, F.concat(*[part.get(x, F.lit(x)) for x in spelling])).otherwise(out)
    return _table(spark, d, "documents").select("doc_id", "source", out.alias("spelt"))


_SQL_PART = {"s": "coalesce(source, '')", "n": "'doc' || doc_id || '.md'"}
_CANONICAL = (
    "WITH spelt AS (SELECT doc_id, source, CASE doc_id % 11 "
    + " ".join(f"WHEN {k} THEN " + " || ".join(_SQL_PART.get(x, f"'{x}'") for x in spelling) for k, spelling in _SPELLINGS.items())
    + """ ELSE '' END AS p FROM documents),
cut AS (SELECT *, CASE WHEN regexp_matches(p, '^(?i:file):/') THEN '' ELSE regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.-]+://[^/]*') END AS host FROM spelt),
rest AS (SELECT *, CASE WHEN regexp_matches(p, '^(?i:file):/') THEN regexp_replace(p, '^[A-Za-z]+:/+', '/') ELSE p[length(host) + 1:] END AS q FROM cut),
parts AS (SELECT *, host <> '' OR starts_with(q, '/') AS rooted, list_filter(string_split(q, '/'), lambda x: x NOT IN ('', '.')) AS ps FROM rest),
body AS (SELECT *, list_reduce(ps, lambda s, x: CASE WHEN x <> '..' THEN concat_ws('/', nullif(s, ''), x) WHEN s <> '' AND s <> '..' AND NOT ends_with(s, '/..') THEN regexp_replace(s, '/?[^/]*$', '')
  WHEN rooted THEN s ELSE concat_ws('/', nullif(s, ''), '..') END, '') AS b FROM parts),
canonical AS (SELECT doc_id, source, CASE WHEN rooted THEN lower(split_part(host, '://', 1)) || CASE WHEN host <> '' THEN '://' || split_part(host, '://', 2) ELSE '' END || '/' || b WHEN b = '' THEN '.' ELSE b END AS path FROM body)
"""
)


@query(_CANONICAL + "SELECT doc_id, path FROM canonical")
def canonical_paths(spark: SparkSession, d: str) -> DataFrame:
    """Schemes, doubled separators, `.` and `..` in many places, and the one spelling of each."""
    return _spelt(spark, d).select("doc_id", paths.canonical(F.col("spelt")).alias("path"))


@query(_CANONICAL + "SELECT source, count(DISTINCT path) AS n_paths, arg_min(path, string_split(path, '/')) AS first_path, arg_max(path, string_split(path, '/')) AS last_path FROM canonical GROUP BY source")
def first_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each source's first and last path by parts."""
    path = _spelt(spark, d).select("source", paths.canonical(F.col("spelt")).alias("path"))
    order = paths.by_parts(F.col("path"))
    distinct = path.groupBy("source", "path").agg(F.count("*").alias("n"))
    return distinct.groupBy("source").agg(F.count("*").alias("n_paths"), F.min_by("path", order).alias("first_path"), F.max_by("path", order).alias("last_path"))


def _moody(texts: list[str]):
    """An encoder for the query below: it fails on batches with a text whose length is divisible by 7, and gives a vector that
    isn't finite where it is divisible by 11."""
    import numpy as np

    if any(len(t) % 7 == 0 for t in texts):
        raise ValueError("length")
    return np.array([[len(t), np.inf if len(t) % 11 == 0 else 1.0] for t in texts])


@query(
    """, t AS (SELECT DISTINCT text FROM blocks)
SELECT md5(text) AS text_md5, CASE WHEN length(text) % 7 = 0 OR length(text) % 11 = 0 THEN 0 ELSE length(text) END::DOUBLE AS first_component, CASE WHEN length(text) % 7 = 0 THEN 'ValueError: length' WHEN length(text) % 11 = 0 THEN 'not finite' END AS reason,
CASE WHEN length(text) % 7 = 0 OR length(text) % 11 = 0 THEN 3002 ELSE 0 END::INT AS code FROM t"""
)
def encoder_failures(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct text through an encoder that fails on some, which have a reason and no vector, and cost others nothing."""
    rows = encoding.encoded(_lines(spark, d), _moody)
    return rows.select("text_md5", F.coalesce(F.get("embedding", F.lit(0)), F.lit(0.0)).alias("first_component"), "reason", F.coalesce("code", F.lit(0)).alias("code"))


@query(
    _BASE.replace("WITH", "WITH RECURSIVE", 1)
    + """, n AS (SELECT block_id, CASE WHEN pos % 9 <> 8 THEN lead(block_id) OVER (PARTITION BY file_id ORDER BY pos) END AS goes FROM blocks),
p AS (SELECT block_id, goes FROM n WHERE goes IS NOT NULL),
walk AS (SELECT block_id, goes AS root, 1::BIGINT AS hops FROM p UNION ALL SELECT w.block_id, p.goes, w.hops + 1 FROM walk w JOIN p ON p.block_id = w.root)
SELECT block_id, arg_max(root, hops) AS root, max(hops) AS hops FROM walk GROUP BY block_id"""
)
def lineage_ends(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that each go into the next of their file, up to every ninth, and where each ends up."""
    next_id = lineage.neighbours(_lines(spark, d)).select("block_id", "next_id")
    rows = _lines(spark, d).select("block_id", "pos").join(next_id, "block_id")
    return lineage.ends(rows.select("block_id", F.when(F.col("pos") % 9 != 8, F.col("next_id")).alias("merged_into")))


@query("SELECT file_id, block_id, lag(block_id) OVER w AS prev_id, lead(block_id) OVER w AS next_id FROM blocks WINDOW w AS (PARTITION BY file_id ORDER BY pos)")
def block_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return lineage.neighbours(_lines(spark, d))


@query("SELECT block_id, path FROM decided WHERE decision = 'undecided' AND pos % 10 <> 0 AND block_id NOT IN (SELECT block_id FROM groups)")
def pending_decisions(spark: SparkSession, d: str) -> DataFrame:
    """What is undecided after the exact stage's suggestions and decisions in bulk, of which some are invalid."""
    blocks = _decided(spark, d)
    decided = duplicates.applied(blocks, duplicates.suggestions(duplicates.exact_groups(blocks)))
    bulk = decided.where("pos % 10 IN (0, 1) AND decision = 'undecided'").withColumn("decision", F.when(F.col("pos") % 10 == 0, "keep").otherwise("later"))
    return dec.pending(decided, dec.updated(decided, decided, bulk)).select("block_id", "path")


@query(
    """, t AS (SELECT *, CASE pos % 7 WHEN 0 THEN 'unreadable' WHEN 1 THEN 'without text' WHEN 2 THEN 'without file_id, text' END AS reject FROM blocks)
SELECT block_id AS made_from, CASE WHEN reject IS NULL THEN block_id END AS block_id, CASE WHEN reject IS NULL THEN CASE WHEN pos % 7 = 3 THEN 'unknown' ELSE 'list_item' END END AS block_type,
CASE WHEN reject IS NULL THEN md5(text) END AS text_md5, CASE WHEN reject IS NULL THEN pos % 7 = 4 END AS has_metadata, reject FROM t"""
)
def decoded_records(spark: SparkSession, d: str) -> DataFrame:
    """Each block as a JSON record, some of them cut off, without fields or with a type that there isn't, read back."""
    place = F.col("pos") % 7
    blocks = _lines(spark, d).withColumn("block_type", F.when(place == 3, "nonsense").otherwise("list_item"))
    blocks = blocks.withColumn("metadata", F.when(place == 4, F.create_map(F.lit("of"), F.col("block_id"))))
    blocks = blocks.withColumn("text", F.when(~place.isin(1, 2), F.col("text"))).withColumn("file_id", F.when(place != 2, F.col("file_id")))
    records = codecs.encoded(blocks, "blocks").select("value", F.get_json_object("value", "$.pos").cast("int").alias("pos"))
    cut = records.withColumn("value", F.when(F.col("pos") % 7 == 0, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")))
    rows = codecs.decoded(cut, "blocks")
    made_from = F.regexp_extract("record", r'"block_id":"([^"]*)"', 1).alias("made_from")
    return rows.select(made_from, "block_id", "block_type", F.md5("text").alias("text_md5"), (F.size("metadata") > 0).alias("has_metadata"), "reject")


_TIME = """CASE doc_id % 6 WHEN 5 THEN '2001-02-03T04:05:06+00:00'
  WHEN 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(t, '%Y-%m-%dT%H:%M:%S') WHEN 2 THEN strftime(t - INTERVAL 5 HOUR - INTERVAL 30 MINUTE, '%Y-%m-%dT%H:%M:%S')
  WHEN 3 THEN strftime(t, '%Y-%m-%dT00:00:00') ELSE strftime(t, '%Y-%m-%dT%H:%M:%S') || '.000' || lpad((doc_id % 1000)::VARCHAR, 3, '0') END"""


@query(
    f"""WITH t AS (SELECT doc_id, TIMESTAMP '1969-12-30 00:00:00' + to_seconds(doc_id * 86413) AS t FROM documents)
SELECT 'd' || doc_id AS block_id_1, CASE WHEN doc_id % 6 = 5 THEN {_TIME} WHEN doc_id % 6 = 4 AND doc_id % 1000 = 0 THEN strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') ELSE {_TIME} || '+00:00' END AS decided,
CASE WHEN doc_id % 4 = 0 THEN 'undecided' ELSE 'merge' END AS decision, 'unknown' AS analysis_type FROM t"""
)
def record_times(spark: SparkSession, d: str) -> DataFrame:
    """Pair decisions whose times are spelt in many ways, or not at all, read and written again in UTC."""
    at = F.expr("TIMESTAMP_NTZ '1969-12-30 00:00:00' + make_dt_interval(0, 0, 0, doc_id * 86413)").cast("string")
    text = F.replace(at, F.lit(" "), F.lit("T"))
    micros = F.concat(F.lit(".000"), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"))
    forms = [at, F.concat(text, F.lit("Z")), F.concat(text, F.lit("+0530")), F.substring(at, 1, 10), F.concat(text, micros, F.lit("+00:00")), F.concat(F.lit("on "), at)]
    spelt = forms[-1]
    for k, form in enumerate(forms[:-1]):
        spelt = F.when(F.col("doc_id") % 6 == k, form).otherwise(spelt)
    one = F.struct(
        F.format_string("d%d", "doc_id").alias("block_id_1"), F.lit("other").alias("block_id_2"), F.lit("by hand").alias("analysis_type"),
        F.when(F.col("doc_id") % 4 == 0, "perhaps").otherwise("merge").alias("decision"), spelt.alias("timestamp"),
    )
    rows = codecs.decoded(_table(spark, d, "documents").select(F.to_json(one).alias("value")), "pair_decisions", F.expr("TIMESTAMP '2001-02-03 04:05:06+00:00'"))
    again = codecs.decoded(codecs.encoded(codecs.accepted(rows, "pair_decisions"), "pair_decisions"), "pair_decisions")
    return again.select("block_id_1", fn.iso(F.col("decided_at")).alias("decided"), "decision", "analysis_type")


@query("SELECT path, block_id, CASE WHEN doc_id % 3 = 0 AND pos % 5 = 0 THEN 'delete' WHEN doc_id % 3 = 0 AND pos % 5 = 1 THEN 'keep' ELSE 'undecided' END AS decision FROM blocks")
def decisions_saved_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Stored blocks' decisions after two rounds of saving, the second of which has changes in a third of the files alone."""
    blocks = _lines(spark, d).select(*codecs.SCHEMAS["blocks"].names[:-1], F.create_map(F.lit("original_path"), F.col("path")).alias("metadata"))
    store = Store(spark, scratch(spark, "store"), ranges=8)
    store.register_files(blocks)
    store.upsert("blocks", blocks)
    made = F.when(F.col("pos") % 5 == 0, "delete").when(F.col("pos") % 5 == 1, "keep").otherwise("later")
    number = F.regexp_extract("path", r"doc(\d+)\.md$", 1).cast("long")
    store.save_block_decisions(blocks.select("path", "block_id", "block_type", F.lit("undecided").alias("decision")))
    store.save_block_decisions(blocks.where(number % 3 == 0).select("path", "block_id", "block_type", made.alias("decision")))
    return store.block_decisions().select("path", "block_id", "decision")
