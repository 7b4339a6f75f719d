"""Chat formatting with relational expressions only.

Turns are collected as structs and sorted in chunks of bounded turn ranges, so that a long conversation is split over tasks; inside a chunk adjacent turns
of one role are merged by an array aggregation, and the chunks' runs are joined in order. The template is

    <|turn|>role<|text|>text<|text|>next text of the same role<|end|>

with ``<|`` inside roles and texts written as ``<\\|`` (each backslash already there keeps its place and one is added), so that
reading back is exact. ``segments`` are the pieces of ``formatted`` in order with a loss flag: assistant texts are trained on.

Cases: a null text or role is empty. Turns of equal or null number stay, ordered by number (null first), role and text. A
null conversation id is a conversation of its own. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rippleset.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Turn numbers of one chunk.
CHUNK = 256


def escape(text: Column) -> Column:
    """Text in which the marks' first two characters never occur."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    """The text that was escaped."""
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _merged(turns: Column) -> Column:
    """Sorted turns as runs of one role."""
    none = F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)")

    def add(runs: Column, turn: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        alone = F.array(F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts")))
        longer = F.array(F.struct(turn["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts")))
        return F.when((F.size(runs) > 0) & (last["role"] == turn["role"]), F.concat(F.slice(runs, F.lit(1), F.size(runs) - 1), longer)).otherwise(F.concat(runs, alone))

    return F.aggregate(turns, none, add)


def format_conversations(df: DataFrame, loss_role: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_col``, ``formatted`` and ``segments array<struct<text,loss>>`` of every conversation."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    given = df.select(F.col(conv_col).alias("_conv"), F.floor(F.col(turn_col) / CHUNK).alias("_chunk"), turn.alias("_turn"))
    chunks = given.groupBy("_conv", "_chunk").agg(_merged(F.sort_array(F.collect_list("_turn"))).alias("runs"))
    runs = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_chunk", "runs"))), lambda c: c["runs"]))
    whole = chunks.groupBy("_conv").agg(runs.alias("runs"))

    def pieces(run: Column, i: Column) -> Column:
        goes_on = (i > 0) & (F.element_at(F.col("runs"), F.when(i > 0, i.cast("int")).otherwise(1))["role"] == run["role"])
        head = F.when(goes_on, F.lit(TEXT)).otherwise(F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(run["role"]), F.lit(TEXT)))
        loss = run["role"] == loss_role
        texts = F.transform(run["texts"], lambda text, k: F.array(
            F.struct(F.when(k == 0, head).otherwise(F.lit(TEXT)).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(text).alias("text"), loss.alias("loss"))))
        return F.flatten(texts)

    segments = F.concat(F.flatten(F.transform("runs", pieces)), F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss"))))
    out = whole.select(F.col("_conv").alias(conv_col), segments.alias("segments"))
    return out.select(conv_col, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """``array<struct<role,text>>`` of the turns in a formatted conversation, with escaped texts."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>|<\|end\|>"), lambda b: F.contains(b, F.lit(TEXT)))

    def turns(block: Column) -> Column:
        parts = F.split(block, r"<\|text\|>")
        return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda text: F.struct(parts[0].alias("role"), text.alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted and read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = r"\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marks).alias("text"))
    out = format_conversations(given.unionByName(planted)).withColumn("turns", read_back(F.col("formatted")))
    plain = F.transform("turns", lambda t: F.concat(unescape(t["role"]), F.lit("\n"), unescape(t["text"]), F.lit("\n")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    out = out.withColumn("loss", loss)
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(plain, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The same from the rows of ``conversations``; ``formatted_chars`` follows from the template's rule.
OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), runs AS (
  SELECT *, coalesce(lag(role) OVER w = role, false) AS goes_on FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), marked AS (
  SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 8
    + CASE WHEN goes_on THEN 0 ELSE 15 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) END AS chars
  FROM runs
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
