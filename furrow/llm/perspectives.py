"""Multi-party chat: one rendering of a dialogue for every participant.

For each speaker of a conversation, that speaker becomes the assistant and all others become named users; narrators
(system messages) stay what they are and are never a perspective. A rendered dialogue is its messages in order; each
is a row with the text, where it starts in the dialogue, and the characters to learn from (``mask_start:mask_end``):
what the assistant of this perspective says and its end mark; an
empty range for the others. Concatenating ``rendered`` by ``position`` gives the
dialogue. All work is DataFrame expressions.

A conversation of any length is worked on in chunks of turns: running sums are taken inside the chunks, and the chunks'
totals are added up apart, so a conversation with a third of all rows is many groups.

Defined cases: null and empty speakers are one participant named ``unknown``; null texts are empty; null turns come
first, and ties go by speaker and text; repeated rows are repeated messages; a null conversation id is a conversation.
A conversation of narrators only has no rows. Characters other than letters, digits, ``_`` and ``-`` become ``_`` in
names. ``<|`` inside a text becomes ``< |``, so that a text cannot hold marks. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..joins import match

BEGIN, END = "<|im_start|>", "<|im_end|>\n"
CHUNK = 1024


def _name(speaker: Column) -> Column:
    return F.when(speaker.isNull() | (F.trim(speaker) == ""), "unknown").otherwise(
        F.regexp_replace(F.trim(speaker), "[^A-Za-z0-9_-]", "_")
    )


def rotate(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
    narrators: tuple[str, ...] = ("system",), chunk: int = CHUNK,
) -> DataFrame:
    """Rows (conv_id, perspective, position, turn, chat_role, name, rendered, start, mask_start, mask_end)."""
    said = messages.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.floor(F.col(turn) / chunk).alias("_chunk"),
        _name(F.col(speaker)).alias("name"),
        F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<\|", "< |").alias("_text"),
    )
    narrated = F.col("name").isin(*narrators) if narrators else F.lit(False)
    participants = said.where(~narrated).select("conv_id", F.col("name").alias("perspective")).distinct()
    chat_role = F.when(narrated, "system").when(F.col("name") == F.col("perspective"), "assistant").otherwise("user")
    head = F.concat(
        F.lit(BEGIN), F.col("chat_role"), F.when(F.col("chat_role") == "user", F.concat(F.lit(" name="), F.col("name"))).otherwise(""), F.lit("\n")
    )
    rows = (
        match(said, participants, ["conv_id"])
        .withColumn("chat_role", chat_role)
        .withColumn("_head", head)
        .withColumn("rendered", F.concat("_head", "_text", F.lit(END)))
        .withColumn("_size", F.char_length("rendered").cast("long"))
    )
    keys = ["conv_id", "perspective"]
    inside = Window.partitionBy(*keys, "_chunk").orderBy(F.col("turn").asc_nulls_first(), "name", "_text")
    chunks = Window.partitionBy(*keys).orderBy(F.col("_chunk").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    before = (
        rows.groupBy(*keys, "_chunk")
        .agg(F.count("*").alias("_count"), F.sum("_size").alias("_sum"))
        .select(
            *keys, "_chunk",
            F.coalesce(F.sum("_count").over(chunks), F.lit(0)).alias("_count"),
            F.coalesce(F.sum("_sum").over(chunks), F.lit(0)).alias("_sum"),
        )
    )
    placed = rows.withColumn("_place", F.row_number().over(inside)).withColumn(
        "_past", F.coalesce(F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    learned = F.col("chat_role") == "assistant"
    start = F.col("_sum") + F.col("_past")
    return match(placed, before, [*keys, "_chunk"]).select(
        "conv_id", "perspective",
        (F.col("_count") + F.col("_place")).alias("position"),
        "turn", "chat_role", "name", "rendered",
        start.alias("start"),
        F.when(learned, start + F.char_length("_head")).otherwise(start).alias("mask_start"),
        F.when(learned, start + F.col("_size") - 1).otherwise(start).alias("mask_end"),
    )


def sql(table: str = "conversations") -> str:
    """The same rows in DuckDB."""
    return f"""
WITH said AS (
  SELECT conv_id, turn,
    CASE WHEN role IS NULL OR trim(role) = '' THEN 'unknown' ELSE regexp_replace(trim(role), '[^A-Za-z0-9_-]', '_', 'g') END AS name,
    replace(coalesce(text, ''), '<|', '< |') AS body
  FROM {table}),
parts AS (SELECT DISTINCT conv_id AS pc, name AS perspective FROM said WHERE name <> 'system'),
roles AS (
  SELECT conv_id, perspective, turn, name, body,
    CASE WHEN name = 'system' THEN 'system' WHEN name = perspective THEN 'assistant' ELSE 'user' END AS chat_role
  FROM said JOIN parts ON conv_id IS NOT DISTINCT FROM pc),
heads AS (
  SELECT *, '{BEGIN}' || chat_role || CASE WHEN chat_role = 'user' THEN ' name=' || name ELSE '' END || chr(10) AS head FROM roles),
texts AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS rendered FROM heads),
placed AS (
  SELECT *, row_number() OVER w AS position,
    (sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(rendered))::BIGINT AS start
  FROM texts WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, name, body))
SELECT conv_id, perspective, position, turn, chat_role, name, rendered, start,
  CASE WHEN chat_role = 'assistant' THEN start + length(head) ELSE start END AS mask_start,
  CASE WHEN chat_role = 'assistant' THEN start + length(rendered) - 1 ELSE start END AS mask_end
FROM placed"""
