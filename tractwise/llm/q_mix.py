"""Queries of chat formatting and mixing."""

from . import chat, mixing
from .common import stored
from .registry import query, table

EXTRA_TEXT = "\\### Assistant: </turn> ok"

_ESC = r"replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"

OP8 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TEXT}'),
shown AS (
  SELECT *, length('### : </turn>' || chr(10)) + 1 + length({_ESC}) + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4
           WHEN 'assistant' THEN 9 ELSE 5 + length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:')) END AS n,
         CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
         lag(role) OVER o AS before, lead(role) OVER o AS after
  FROM turns WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
       sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars,
       bool_and(CASE WHEN before IS NULL THEN role IN ('system', 'user') WHEN role = 'user' THEN before IN ('system', 'assistant')
                     WHEN role = 'assistant' THEN before = 'user' ELSE false END AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM shown GROUP BY conv_id
"""


@query("op8_chat_formatting", OP8)
def op8(spark, folder):
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], turns.schema)
    turns = turns.unionByName(extra)
    formatted = stored(chat.segments(turns).select("conv_id", "turn", "segments"), "chat")
    order = chat.turn_order(turns).withColumnRenamed("conv_id", "c")
    out = chat.digests(formatted)
    return out.join(order, out.conv_id.eqNullSafe(order.c)).drop("c")


@query("op10_source_mixing")
def op10(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).drop("copies", "source")
