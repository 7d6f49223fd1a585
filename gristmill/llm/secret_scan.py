"""Secret scans over a trigram inverted index, by DataFrame operations alone.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain (lower-cased, so
that the query also covers rules that ignore case): alternatives, each a set of trigrams that must all occur.  The index has a
row for each trigram of the rules and each text that holds it (a posting; texts go by a digest).  Postings of an
alternative's trigrams are intersected by counting them for each text, with partial sums; texts that hold all of an
alternative are the rule's candidates and only they are scanned with its expression.  Rules without a mandatory trigram scan
every text.
"""

from __future__ import annotations

import re
import re._constants as K
import re._parser as parser
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, running, table, unused

_WIDEST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  `group` of a match must have at least `least` characters, else the match is passed over."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The base kinds, in the order that breaks ties.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: A private key from BEGIN to the next END line; where BEGIN comes again before it, or there is none, over the header and
#: base64 lines that follow.  Line ends may be written out as \n, as in JSON, and lines may be quoted.  Repeats are
#: possessive, so that long texts need no stack.
_NAME, _GAP = r"[A-Z ]{0,40}PRIVATE KEY-----", r"""(?:[\x09-\x0D\x20"'>#*,+]|\\[nrt])"""
_PEM = (
    rf"-----BEGIN {_NAME}(?:"
    rf"(?:[^-]++|-(?!----(?:BEGIN|END) {_NAME}))*+-----END {_NAME}"
    rf"|(?:{_GAP}*+[A-Z][A-Za-z]*-[A-Za-z-]{{1,40}}: [^\x09-\x0D\x20\\]++)*+"
    rf"(?:(?:{_GAP}*+(?:[A-Za-z0-9+/]{{16,}}+={{0,2}}|[A-Za-z0-9+/]{{1,15}}={{1,2}}))++(?:(?:[\r\n]|\\[nr])++[A-Za-z0-9+/]{{1,15}}(?=[\r\n\\]|$))?)?)"
)
#: Kinds that this scan adds.
MORE = (
    Rule("pem", _PEM),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
RULES = BASE + MORE


def _of_strings(strings: set[str]):
    """The query of "one of these strings occurs": an alternative is the set of its trigrams; None where one has none."""
    if any(len(s) < 3 for s in strings):
        return None
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a, b):
    if a is None or b is None:
        return a if b is None else b
    out = frozenset(x | y for x in a for y in b)
    return out if len(out) <= _WIDEST else min(a, b, key=len)


def _sequence(nodes) -> tuple[set[str] | None, frozenset | None]:
    """The strings that the nodes match, if they are few, and the query that any match satisfies."""
    exact, run, query = True, {""}, None
    for op, arg in nodes:
        strings, need = _node(op, arg)
        if strings is not None and len(strings) * len(run) <= _WIDEST:
            run = {a + b for a in run for b in strings}
            continue
        query = _both(_both(query, _of_strings(run)), need)
        exact, run = False, {""}
        if strings is not None:
            run = strings
    query = _both(query, _of_strings(run))
    return (run if exact else None), query


def _node(op, arg) -> tuple[set[str] | None, frozenset | None]:
    if op is K.LITERAL:
        return {chr(arg).lower()}, None
    if op is K.IN and all(o is K.LITERAL for o, _ in arg) and len(arg) <= 8:
        return {chr(c).lower() for _, c in arg}, None
    if op is K.SUBPATTERN:
        return _sequence(arg[-1])
    if op is K.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        strings = set().union(*(s for s, _ in parts)) if all(s is not None for s, _ in parts) else None
        needs = [q for _, q in parts]
        return strings, (None if None in needs else frozenset().union(*needs))
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, sub = arg
        strings, need = _sequence(sub)
        if low == 0:
            return ({""} | strings if high == 1 and strings is not None else None), None
        if low == high and strings is not None and len(strings) ** low <= _WIDEST:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in strings}
            return out, None
        return None, need
    if op is K.AT:
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> frozenset[frozenset[str]] | None:
    """Alternatives of trigram sets, one of which every match of the pattern contains; None: the pattern has no such set."""
    query = _sequence(parser.parse(pattern))[1]
    return query and frozenset(alt for alt in query if not any(other < alt for other in query))


def _any_of(grams: list[str]) -> str:
    """An expression that finds the trigrams wherever they begin, also inside one another; by first letter, to fail early."""
    rest: dict[str, list[str]] = {}
    for g in grams:
        rest.setdefault(g[0], []).append(g[1:])
    return "(?=(" + "|".join(f"{re.escape(c)}(?:{'|'.join(map(re.escape, r))})" for c, r in sorted(rest.items())) + "))"


def _key(text: str = "text") -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """gram, key: the postings of the rules' trigrams, each trigram and digest of a text that holds it once."""
    grams = sorted({g for r in rules for alt in trigram_query(r.pattern) or () for g in alt})
    found = F.regexp_extract_all(F.lower("text"), F.lit(_any_of(grams)), F.lit(1)) if grams else F.array().cast("array<string>")
    return docs.select(_key().alias("key"), F.explode(F.array_distinct(found)).alias("gram")).distinct()


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """key, rules (places in rules, at most so many) of each text whose postings satisfy a rule's query."""
    alternatives = [(k, alt) for k, r in enumerate(rules) for alt in sorted(trigram_query(r.pattern) or (), key=sorted)]
    if not alternatives:
        return postings.groupBy("key").agg(F.collect_set(F.lit(0)).alias("rules")).where("false")
    of: dict[str, list[int]] = {}
    for i, (_, alt) in enumerate(alternatives):
        for g in sorted(alt):
            of.setdefault(g, []).append(i)
    every = lambda xs: F.array(*map(F.lit, xs))
    member = F.create_map(*(c for g, xs in of.items() for c in (F.lit(g), every(xs))))
    met = postings.select("key", F.explode(F.element_at(member, F.col("gram"))).alias("alt")).groupBy("key", "alt").count()
    whole = met.where(F.col("count") == F.element_at(every([len(alt) for _, alt in alternatives]), F.col("alt") + 1))
    return whole.groupBy("key").agg(F.collect_set(F.element_at(every([k for k, _ in alternatives]), F.col("alt") + 1)).alias("rules"))


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(k: int, rule: Rule, matches: str) -> Column:
    """Spans of rule k from its matches: lengths of the text between matches and of the matches, added up."""

    def placed(gaps: Column) -> Column:
        sizes = F.transform(matches, lambda m: F.length(m).cast("long"))
        steps = F.zip_with(F.slice(gaps, 1, F.size(matches)), sizes, lambda g, n: g + n)
        return let(running(steps, lambda x, y: x + y), lambda before: F.transform(matches, lambda m, i: span(before[i] + gaps[i], m)))

    def span(start: Column, m: Column) -> Column:
        ok = F.length(F.regexp_extract(m, rule.pattern, rule.group)) >= rule.least if rule.group else F.lit(True)
        return F.struct(start.cast("int").alias("start"), F.lit(k).alias("kind"), (start + F.length(m)).cast("int").alias("end"), ok.alias("ok"))

    gaps = F.transform(F.split("text", rule.pattern, -1), lambda x: F.length(x).cast("long"))
    return F.transform(F.filter(let(gaps, placed), lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds `spans` to docs (text): start, kind (place in rules), end in code points, end exclusive, sorted.

    A kind's matches are leftmost and don't overlap; one whose group is too short is dropped but still stands in the way of
    others.  A null text is empty and has no spans.  Rows are kept one by one, repeated or not, and texts of any length are
    scanned whole; other columns pass through, whatever their names, except that one named spans is replaced.  No rows give
    no rows.
    """
    docs = docs.withColumn("text", F.coalesce("text", F.lit(""))).drop("spans")
    key, found = unused(docs, "key"), unused(docs, "rules")
    hits = candidates(index(docs, rules), rules).toDF(key, found)
    out = docs.withColumn(key, _key()).join(hits, key, "left")
    none, names = F.array().cast("array<string>"), [unused(docs, f"m{k}") for k in range(len(rules))]
    asked = lambda k, r: F.lit(True) if trigram_query(r.pattern) is None else F.coalesce(F.array_contains(found, k), F.lit(False))
    out = out.withColumns({m: F.when(asked(k, r), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none) for k, (m, r) in enumerate(zip(names, rules, strict=True))})
    spans = (F.when(F.size(m) > 0, _spans(k, r, m)).otherwise(F.array().cast(_SPANS)) for k, (m, r) in enumerate(zip(names, rules, strict=True)))
    return out.withColumn("spans", F.sort_array(F.concat(*spans))).select(*docs.columns, "spans")


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by the mask, overlapping or touching ones by one, and n_chars, if there, counted again.

    A null text becomes empty and an empty text stays; texts of any length are read whole.  Rows stand alone, repeated or
    not, and other columns pass through, whatever their names.  No rows give no rows.
    """
    own = unused(docs, "own_spans")
    out = scan(docs.withColumnRenamed("spans", own), rules)
    ends = F.transform("spans", lambda s: s["end"].cast("long"))
    clear = lambda reach: F.transform("spans", lambda s, i: F.struct(reach[i].cast("int").alias("start"), s["start"].alias("end")))
    kept = F.filter(let(running(ends, F.greatest), clear), lambda s: (s["start"] < s["end"]) | (s["start"] == 0) & (s["end"] == 0))
    tail = F.struct(F.array_max(F.transform("spans", lambda s: s["end"])).alias("start"), F.length("text").alias("end"))
    text = F.array_join(cut(F.col("text"), F.concat(kept, F.array(tail))), mask)
    out = out.withColumn("text", F.when(F.size("spans") > 0, text).otherwise(F.col("text"))).drop("spans").withColumnRenamed(own, "spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        of(0).alias("n_assign"),
        of(1).alias("n_access"),
        of(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["kind"] < len(BASE))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _oracle() -> str:
    """The query in DuckDB SQL: matches and the text between them, whose lengths add up to places.

    SQL's expressions fold more than A-Z, so letters in either case are spelt out; they have neither look-ahead nor
    possessive repeats, so a key's markers are listed and each BEGIN goes to an END next to it, else over what follows.  The
    two can differ only in a key without END whose lines begin with + or whose header names an armour line without a body.
    """
    either = lambda m: re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1])
    rules = {r.kind: re.sub(r"\(\?i:([^)]*)\)", lambda m: f"(?:{either(m)})", r.pattern) for r in RULES if r.kind != "pem"}
    rules["assign"] = rules["assign"].replace("((?:", "(?:(?:")
    marker = f"-----(?:BEGIN|END) {_NAME}"
    after = _PEM.split(f"-----END {_NAME}|", 1)[1][:-1].replace("*+", "*").replace("++", "+").replace("}+", "}").replace("(?=", "(?:")
    parts = [
        f"SELECT row, {k} AS kind, {r.least} AS least, {_quoted(rules.get(r.kind, marker))} AS pattern, regexp_extract_all(text, {_quoted(rules.get(r.kind, marker))}) AS m, string_split_regex(text, {_quoted(rules.get(r.kind, marker))}) AS gaps FROM docs"
        for k, r in enumerate(RULES)
    ]
    group = f"length(regexp_extract(m, {_quoted(rules['assign'])}, 1)) >= least"
    kinds = ", ".join(f"'{r.kind}'" for r in RULES)
    pem = next(k for k, r in enumerate(RULES) if r.kind == "pem")
    line = f"regexp_extract(gap_after, {_quoted('^(?:' + after + ')')})"
    tail = r"regexp_matches(body, '[\r\n\\\\]$')"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
matched AS ({" UNION ALL ".join(parts)}),
each AS (SELECT row, kind, least, unnest(m) AS m, unnest(gaps[1:len(m)]) AS gap, unnest(gaps[2:]) AS gap_after, generate_subscripts(m, 1) AS i FROM matched),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER w AS stop, lead(m) OVER w AS next_m FROM each WINDOW w AS (PARTITION BY row, kind ORDER BY i)),
keys AS (SELECT *, {line} AS body FROM placed WHERE kind = {pem} AND m LIKE '-----BEGIN%'),
spans AS (
  SELECT row, kind, stop - length(m) AS start, stop FROM placed WHERE kind <> {pem} AND (least = 0 OR {group})
  UNION ALL SELECT row, kind, stop - length(m), CASE WHEN next_m LIKE '-----END%' THEN stop + length(gap_after) + length(next_m) ELSE stop + length(body) - CASE WHEN {tail} THEN 1 ELSE 0 END END FROM keys
),
named AS (SELECT row, kind, start, ([{kinds}])[kind + 1] || ':' || start::BIGINT || ':' || stop::BIGINT AS s FROM spans)
SELECT any_value(doc_id) AS doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < {len(BASE)}), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
FROM docs LEFT JOIN named USING (row) GROUP BY row
"""


ORACLE = _oracle()
