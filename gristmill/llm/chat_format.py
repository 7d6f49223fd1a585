"""Chat formatting by relational operations alone.

Turns of a conversation are collected as structs and sorted; neighbouring turns of one role become one message, held as
an array slice between two changes of role; messages are joined into one string.

Template.  Every control string starts with ``<``::

    <|role|>user<|text|>first text<|next|>second text<|end|><|role|>assistant<|text|>...<|end|>

``<|next|>`` parts the texts of turns that were merged.  Inside roles and texts a backslash becomes ``\\b`` and ``<``
becomes ``\\l``, so no text can hold a control string and every text can be read back exactly.

Loss mask.  ``loss_spans`` holds [start, end) in code points of `formatted`, one span for each text of a role to learn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, let, running, table

ROLE, TEXT, NEXT, END = "<|role|>", "<|text|>", "<|next|>", "<|end|>"


def _pattern(mark: str) -> str:
    return mark.replace("|", "\\|")


def escaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_messages, formatted, loss_spans of each conversation in `turns` (conv_id, turn, role, text).

    A null text or role counts as empty; rows of a null conv_id form one conversation; rows with equal turn are ordered by
    role, then text, and a null turn comes first.  Repeated rows are repeated turns.  Further columns are ignored.  No rows
    give no rows.  One conversation must fit in a row, as its formatted string must.
    """
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    collected = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # 1-based places at which a message begins, and one past the last turn
    begins = F.filter(
        F.sequence(F.lit(1), F.size("turns")),
        lambda i: (i == 1) | (F.element_at("turns", i).getField("role") != F.element_at("turns", F.greatest(i - 1, F.lit(1))).getField("role")),
    )
    marked = collected.withColumn("begins", begins).withColumn("stops", F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("turns") + 1)))
    messages = F.transform(
        F.arrays_zip("begins", "stops"),
        lambda b: F.struct(
            F.element_at("turns", b["begins"]).getField("role").alias("role"),
            F.transform(F.slice("turns", b["begins"], b["stops"] - b["begins"]), lambda t: escaped(t["text"])).alias("texts"),
        ),
    )
    merged = marked.select("conv_id", messages.alias("messages"))
    head = lambda m: F.concat(F.lit(ROLE), escaped(m["role"]), F.lit(TEXT))
    formatted = F.array_join(F.transform("messages", lambda m: F.concat(head(m), F.array_join(m["texts"], NEXT), F.lit(END))), "")
    # each text as how many code points stand before and in it, then added up
    pieces = F.flatten(
        F.transform(
            "messages",
            lambda m: F.transform(
                m["texts"],
                lambda x, i: F.struct(
                    F.when(i == 0, F.length(head(m))).otherwise(len(NEXT)).alias("before"),
                    F.length(x).alias("size"),
                    F.when(i == F.size(m["texts"]) - 1, len(END)).otherwise(0).alias("after"),
                    m["role"].isin(*loss_roles).alias("loss"),
                ),
            ),
        )
    )
    steps = lambda ps: F.transform(ps, lambda p: (p["before"] + p["size"] + p["after"]).cast("long"))
    placed = lambda ps: let(running(steps(ps), lambda x, y: x + y), lambda at: F.transform(ps, lambda p, i: span((at[i] + p["before"]).cast("int"), p)))
    span = lambda start, p: F.struct(start.alias("start"), (start + p["size"]).alias("end"), p["loss"].alias("loss"))
    spans = F.transform(F.filter(let(pieces, placed), lambda s: s["loss"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return merged.select("conv_id", F.size("messages").alias("n_messages"), formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds `turns`, an array of (role, text) parsed from `formatted` alone, and `loss_text`, all text under the mask."""
    messages = F.filter(F.split("formatted", _pattern(END), -1), lambda m: m != "")
    parts = F.transform(messages, lambda m: F.split(F.substr(m, F.lit(len(ROLE) + 1)), _pattern(TEXT), 2))
    turns = F.flatten(
        F.transform(
            parts,
            lambda p: F.transform(
                F.split(p[1], _pattern(NEXT), -1),
                lambda x: F.struct(unescaped(p[0]).alias("role"), unescaped(x).alias("text")),
            ),
        )
    )
    loss = F.array_join(cut(F.col("formatted"), F.col("loss_spans")), "")
    return formatted.withColumn("turns", turns).withColumn("loss_text", unescaped(loss))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.sql(
        r"""SELECT -7L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, r'\### Assistant: </turn> ok' AS text
            FROM range(2)"""
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    back = read_back(format_conversations(turns))
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_messages").cast("long").alias("n_messages"),
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)
), m AS (
  SELECT *, role IS DISTINCT FROM lag(role) OVER w AS opens,
         length(text) + length(text) - length(replace(text, '\', '')) + length(text) - length(replace(text, '<', '')) AS esc,
         length(role) + length(role) - length(replace(role, '\', '')) + length(role) - length(replace(role, '<', '')) AS esc_role
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(esc + CASE WHEN opens THEN 8 + esc_role + 8 + 7 ELSE 8 END) AS BIGINT) AS formatted_chars,
       CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) AS BIGINT) AS n_messages
FROM m GROUP BY conv_id
"""
