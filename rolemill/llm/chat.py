"""Multi-party perspective rotation of dialogues.

For every participant of a conversation, meaning every role but ``system``, the whole
dialogue is rendered once with that participant as assistant and all others as users
under their names; the system's turns stay as they are. Only the assistant's words
and their end mark are to be learned from.

A rendering comes in parts of ``PART_TURNS`` turn numbers, so that a conversation of
any length stays out of one task. ``start`` is where a part begins in the rendering;
``masks`` are the character spans to learn, from the part's own beginning.

Turns follow their number, then role and text; equal rows are repeated turns. A null
number comes first (in a part of its own, -1), a null role is the participant
``unknown``, a null text is empty, and null conversations are one conversation of
their own. A conversation with system turns alone has no rendering.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 64
SYSTEM = "system"


def rotate(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, speaker, part, n_turns, start, text, masks) of every perspective."""
    said = turns.select(
        F.col(conversation).alias("conv_id"), F.col(turn).alias("_turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("_role"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.coalesce(F.floor(F.col(turn) / part_turns), F.lit(-1)).cast("long").alias("part"))
    roles = said.where(F.col("_role") != SYSTEM).select(
        "conv_id", F.col("_role").alias("speaker")).distinct()
    parts = said.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct(
        F.coalesce("_turn", F.lit(-(1 << 62))).alias("turn"), F.col("_role").alias("role"),
        F.col("_text").alias("text")))).alias("_said"))
    both = parts.join(roles, parts["conv_id"].eqNullSafe(roles["conv_id"])).drop(
        roles["conv_id"])
    own = lambda x: x["role"] == F.col("speaker")
    head = lambda x: F.when(own(x), F.lit("<|assistant|>\n")).when(
        x["role"] == SYSTEM, F.lit("<|system|>\n")).otherwise(
        F.concat(F.lit("<|user name="), x["role"], F.lit("|>\n")))
    body = lambda x: F.concat(x["text"], F.lit("<|end|>\n"))
    pieces = F.transform("_said", lambda x: F.struct(
        head(x).alias("head"), body(x).alias("body"), own(x).alias("learn")))
    walked = F.aggregate(
        "_pieces", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(
            "array<struct<from:bigint,to:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"])).alias("at"),
            F.when(x["learn"], F.concat(acc["spans"], F.array(F.struct(
                (acc["at"] + F.length(x["head"])).alias("from"),
                (acc["at"] + F.length(x["head"]) + F.length(x["body"]) - 1).alias("to")))))
            .otherwise(acc["spans"]).alias("spans")))
    done = (both.withColumn("_pieces", pieces).select(
        "conv_id", "speaker", "part", F.size("_said").cast("long").alias("n_turns"),
        F.array_join(F.transform("_pieces", lambda x: F.concat(x["head"], x["body"])), "")
        .alias("text"), walked["spans"].alias("masks")))
    before = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    return done.withColumn("start", F.coalesce(
        F.sum(F.length("text")).over(before), F.lit(0)).cast("long"))


SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS body,
         coalesce(turn // 64, -1) AS part FROM conversations),
who AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> 'system'),
view AS (
  SELECT s.conv_id, w.speaker, s.part, s.turn, s.role, s.body, s.role = w.speaker AS learn,
         CASE WHEN s.role = w.speaker THEN '<|assistant|>' || chr(10)
              WHEN s.role = 'system' THEN '<|system|>' || chr(10)
              ELSE '<|user name=' || s.role || '|>' || chr(10) END AS head
  FROM said s JOIN who w ON s.conv_id IS NOT DISTINCT FROM w.conv_id),
walked AS (
  SELECT *, length(head) + length(body) + 8 AS n, row_number() OVER o AS k,
         sum(length(head) + length(body) + 8) OVER o AS upto
  FROM view WINDOW o AS (PARTITION BY conv_id, speaker, part ORDER BY turn, role, body
                         ROWS UNBOUNDED PRECEDING)),
parts AS (
  SELECT conv_id, speaker, part, count(*) AS n_turns,
         string_agg(head || body || '<|end|>' || chr(10), '' ORDER BY k) AS text,
         coalesce(string_agg((upto - n + length(head))::BIGINT || '-' || (upto - 1)::BIGINT, ','
                  ORDER BY k) FILTER (learn), '') AS masks
  FROM walked GROUP BY ALL)
SELECT conv_id, speaker, part, n_turns, masks, text,
       coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
FROM parts
"""
