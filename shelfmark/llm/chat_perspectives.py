"""Chat formatting: the same dialogue from every participant's side.

For each participant of a conversation the dialogue is rendered with that speaker as ``assistant``; all other
speakers become ``user`` with their own name, system turns stay ``system``. Only the
assistant's words carry a training mask. Rows are messages, so a conversation of any length is
spread over tasks and never gathered in one; the rendering of a conversation is its rows' ``rendered`` in the order
(turn, speaker, content). Built-in functions only.

Defined cases: a null conversation, turn or role is kept as its own value (a null role is the speaker ``unknown``);
a null text is empty; repeated rows stay repeated; equal turns are ordered by speaker
and content; marks of the format within a text or a name are broken by a space, so that no text can close its turn or open another, and a name stays in one line; a conversation with system turns only has no participants and gives no rows; an empty table gives none.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def harmless(c: Column) -> Column:
    """Text without the start of a mark."""
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def rotate(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """One row per participant and message: role, name and content as that participant's model sees them.

    ``mask_start`` and ``mask_end`` are the code points of ``rendered`` to train on (the assistant's words and the
    closing mark), equal where nothing is trained.
    """
    m = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("content"),
    )
    # One row per conversation and speaker: few, and counted on each task before they are shuffled.
    cast = m.where(F.col("speaker") != system).select(F.col("conv_id").alias("c"), F.col("speaker").alias("participant")).distinct()
    seen = m.join(cast, m["conv_id"].eqNullSafe(cast["c"])).drop("c")
    own = F.col("speaker") == F.col("participant")
    role = F.when(F.col("speaker") == system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    called = F.translate(harmless(F.col("name")), "\r\n", "  ")
    head = F.concat(F.lit(OPEN), F.col("role"), F.when(F.col("name").isNotNull(), F.concat(F.lit(" name="), called)).otherwise(F.lit("")), F.lit("\n"))
    seen = seen.withColumn("head", head).withColumn("rendered", F.concat("head", harmless(F.col("content")), F.lit(CLOSE)))
    end = F.length("rendered") - 1  # the line feed after the mark is not trained
    return seen.select(
        "conv_id", "participant", "turn", "role", "name", "content", "rendered",
        F.when(F.col("role") == "assistant", F.length("head")).otherwise(end).cast("long").alias("mask_start"), end.cast("long").alias("mask_end"),
        (F.col("role") == "assistant").alias("trained"),
    )


def op8_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH m AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS content FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS participant FROM m WHERE speaker <> 'system'),
s AS (SELECT m.conv_id, p.participant, m.turn, m.content,
        CASE WHEN m.speaker = 'system' THEN 'system' WHEN m.speaker = p.participant THEN 'assistant' ELSE 'user' END AS role,
        CASE WHEN m.speaker <> 'system' AND m.speaker <> p.participant THEN m.speaker END AS name
      FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, replace(content, '<|', '< |') AS body, '<|im_start|>' || role || CASE WHEN name IS NOT NULL THEN ' name=' || translate(replace(name, '<|', '< |'), chr(13) || chr(10), '  ') ELSE '' END || chr(10) AS head FROM s)
SELECT conv_id, participant, turn, role, name, content, head || body || '<|im_end|>' || chr(10) AS rendered,
  CASE WHEN role = 'assistant' THEN length(head) ELSE length(head) + length(body) + 10 END::BIGINT AS mask_start,
  (length(head) + length(body) + 10)::BIGINT AS mask_end, role = 'assistant' AS trained
FROM h
"""
