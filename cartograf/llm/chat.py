"""Multi-party perspective rotation of dialogues, by DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that participant as the
assistant and everyone else as a named user. The result has one row for each turn and perspective, so a
conversation of any length stays spread over rows; ``turn`` orders them. Nothing is collected by
conversation: participants are distinct (conversation, speaker) pairs, joined back by conversation.

A system turn is context in every perspective: it keeps its role and is never a participant. ``mask``
is 1 where the perspective's own text is to be learnt. Null text renders as empty; a null speaker takes
no part as a perspective and is rendered as ``unknown``; turns that repeat are rendered each; rows
without conversation id are left out, as they belong to no dialogue. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def rotate_perspectives(df: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", context: tuple[str, ...] = ("system",)) -> DataFrame:
    """conv_id, perspective, turn, speaker, chat_role, name, rendered, mask, learn_start, learn_chars.

    ``rendered`` is header, text and end mark; the ``learn_chars`` characters from ``learn_start`` on (text
    and end mark of the perspective's own turns) are what the mask selects, 0 elsewhere.
    """
    turns = df.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("turn"), F.col(speaker).cast("string").alias("speaker"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said")
    ).filter(F.col("conv_id").isNotNull())
    is_context = F.coalesce(F.col("speaker").isin(*context), F.lit(False))
    people = turns.filter(F.col("speaker").isNotNull() & ~is_context).select("conv_id", F.col("speaker").alias("perspective")).distinct()
    both = turns.join(people, "conv_id")
    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    role = F.when(is_context, F.col("speaker")).when(own, F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(is_context | own, F.lit(None).cast("string")).otherwise(F.coalesce(F.col("speaker"), F.lit("unknown")))
    header = F.concat(F.lit(OPEN), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    mask = own.cast("int")
    return both.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        role.alias("chat_role"),
        name.alias("name"),
        F.concat(header, F.col("said"), F.lit(CLOSE)).alias("rendered"),
        mask.alias("mask"),
        F.when(own, F.length(header)).otherwise(0).alias("learn_start"),
        F.when(own, F.length("said") + len(CLOSE)).otherwise(0).alias("learn_chars"),
    )


SQL = """
WITH t AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS said FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker IS NOT NULL AND speaker <> 'system'),
b AS (
  SELECT t.*, p.perspective, coalesce(speaker = 'system', false) AS ctx, speaker IS NOT DISTINCT FROM perspective AS own
  FROM t JOIN p USING (conv_id)
),
r AS (
  SELECT *, CASE WHEN ctx THEN speaker WHEN own THEN 'assistant' ELSE 'user' END AS chat_role,
    CASE WHEN ctx OR own THEN NULL ELSE coalesce(speaker, 'unknown') END AS name
  FROM b
),
h AS (SELECT *, '<|im_start|>' || chat_role || coalesce(' name=' || name, '') || chr(10) AS header FROM r)
SELECT conv_id, perspective, turn, speaker, chat_role, name, header || said || '<|im_end|>' || chr(10) AS rendered,
  own::INT AS mask, CASE WHEN own THEN length(header) ELSE 0 END::INT AS learn_start,
  CASE WHEN own THEN length(said) + 11 ELSE 0 END::INT AS learn_chars
FROM h
"""
