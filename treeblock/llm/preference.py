"""Preference formatting: the turns that chosen and rejected conversations share, once, then each one's completion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

HEAD, MIDDLE, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
#: Marks within a text get one backslash more, so that none is taken for a mark and all can be taken back.
MARK, ESCAPED = r"<\|(\\*)im_(start|end)\|>", r"<|\\$1im_$2|>"


def formatted(turns: DataFrame) -> DataFrame:
    """Rendered turns of preference pairs, the prompt once and the completions side by side.

    turns: pair_id, chosen boolean (else, or null, of the rejected conversation), turn, role, text. Returns a row for each
    place of a pair that either conversation has: pair_id, part (prompt, completion), turn, nth (0 but for further rows
    with the same turn), prompt, chosen, rejected (rendered turns) and, of chosen and rejected, chosen_start, chosen_end,
    rejected_start, rejected_end. The longest common prefix of turns, equal in role and text, is the prompt and has no
    completion; from the first difference on, each conversation's turn is a completion, null where it has none there. A
    pair's strings are their column's values joined in the order of (turn, nth), nulls left out. Trained on are, in
    completions' turns of an assistant, the characters from start to end, its text and end mark; else both are null.

    Marks inside roles and texts are escaped by a backslash. Null turns come first, rows with equal turn are ordered by role
    and text, null roles and texts render as empty and equal each other only. Where a conversation is missing, the other
    one has no prompt. Rows of a null pair_id are one pair. Turns meet by (pair, turn), so that no conversation, however
    long, is gathered into one row or task; other columns are left out, and an empty table gives an empty result.
    """
    same = W.partitionBy("pair_id", "chosen", "turn").orderBy("role", "text")
    rows = turns.select("pair_id", F.coalesce("chosen", F.lit(False)).alias("chosen"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("nth", (F.row_number().over(same) - 1).cast("long"))
    one = F.struct("role", "text")
    # both sides of a place in one row
    sides = rows.groupBy("pair_id", "turn", "nth").agg(F.max(F.when(F.col("chosen"), one)).alias("c"), F.max(F.when(~F.col("chosen"), one)).alias("r"))
    place = F.struct(F.col("turn").isNotNull(), "turn", "nth")
    sides = sides.withColumn("place", place).withColumn("equal", F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c").eqNullSafe(F.col("r")))
    first = sides.where(~F.col("equal")).groupBy(F.col("pair_id").alias("p")).agg(F.min("place").alias("first"))
    out = sides.join(first, F.col("pair_id").eqNullSafe(F.col("p")), "left")
    prompt = F.col("first").isNull() | (F.col("place") < F.col("first"))

    def plain(x):
        return F.regexp_replace(F.coalesce(x, F.lit("")), MARK, ESCAPED)

    def rendered(side):
        return F.when(F.col(side).isNotNull(), F.concat(F.lit(HEAD), plain(F.col(side)["role"]), F.lit(MIDDLE), plain(F.col(side)["text"]), F.lit(TAIL)))

    columns = [F.when(prompt, rendered("c")).alias("prompt")]
    for name, side in (("chosen", "c"), ("rejected", "r")):
        loss = ~prompt & (F.col(side)["role"] == "assistant")
        start = F.lit(len(HEAD) + len("assistant") + len(MIDDLE)).cast("long")
        columns += [
            F.when(~prompt, rendered(side)).alias(name),
            F.when(loss, start).alias(f"{name}_start"),
            F.when(loss, start + F.char_length(plain(F.col(side)["text"])) + len(TAIL)).cast("long").alias(f"{name}_end"),
        ]
    return out.select("pair_id", F.when(prompt, "prompt").otherwise("completion").alias("part"), "turn", "nth", *columns)


def pairs_of(conversations: DataFrame) -> DataFrame:
    """Turns of pairs made of a table of conversations: 2k is chosen, 2k + 1 rejected. Rows of a null conv_id are one
    pair's rejected conversation; repeated rows stay, other columns are left out, an empty table stays empty."""
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    return conversations.select(pair.alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")


ORACLE = r"""
WITH t AS (SELECT CAST(floor(conv_id / 2) AS BIGINT) AS pair_id, coalesce(conv_id % 2 = 0, false) AS chosen, turn, role, text FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY pair_id, chosen, turn ORDER BY role NULLS FIRST, text NULLS FIRST) - 1 AS nth, coalesce(turn, -9223372036854775808) AS k,
  regexp_replace(coalesce(role, ''), '<\|(\\*)im_(start|end)\|>', '<|\\\1im_\2|>', 'g') AS r, regexp_replace(coalesce(text, ''), '<\|(\\*)im_(start|end)\|>', '<|\\\1im_\2|>', 'g') AS x FROM t),
g AS (SELECT *, '<|im_start|>' || r || chr(10) || x || '<|im_end|>' || chr(10) AS segment, CASE WHEN role = 'assistant' THEN 22 END AS s, CASE WHEN role = 'assistant' THEN 33 + length(x) END AS e FROM n),
c AS (SELECT * FROM g WHERE chosen), r AS (SELECT * FROM g WHERE NOT chosen),
j AS (SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k, coalesce(c.turn, r.turn) AS turn, coalesce(c.nth, r.nth) AS nth,
  c.segment AS cg, r.segment AS rg, c.s AS cs, c.e AS ce, r.s AS rs, r.e AS re,
  c.k IS NULL OR r.k IS NULL OR c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text AS other
  FROM c FULL JOIN r ON c.pair_id IS NOT DISTINCT FROM r.pair_id AND c.k = r.k AND c.nth = r.nth),
p AS (SELECT *, coalesce(bool_or(other) OVER (PARTITION BY pair_id ORDER BY k, nth), false) AS done FROM j)
SELECT pair_id, CASE WHEN done THEN 'completion' ELSE 'prompt' END AS part, turn, nth, CASE WHEN NOT done THEN cg END AS prompt,
  CASE WHEN done THEN cg END AS chosen, CAST(CASE WHEN done THEN cs END AS BIGINT) AS chosen_start, CAST(CASE WHEN done THEN ce END AS BIGINT) AS chosen_end,
  CASE WHEN done THEN rg END AS rejected, CAST(CASE WHEN done THEN rs END AS BIGINT) AS rejected_start, CAST(CASE WHEN done THEN re END AS BIGINT) AS rejected_end
FROM p
"""
