"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

A pair's longest common turn prefix is its prompt, rendered once; what follows on either side is a completion whose
assistant turns are trained on. Everything is done by turns, so no conversation has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rendering of a turn.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "<|end|>\n"
TRAINED = "assistant"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("")), F.lit(BETWEEN), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def preferences(turns: DataFrame, pair: Column, chosen: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, part, turn, role, rendered, trained): a row for each turn of each prompt and completion.

    pair: the number of a conversation's pair, from its row; chosen: whether it is the chosen one. part is "prompt"
    (once for both sides), "chosen" or "rejected"; trained is true for assistant turns of completions. A prompt is the
    run of turns, from the first turn number of either side, that have equal number, role and text on both sides; null
    role or text equals only null. A side that lacks a turn number ends the prompt. Two equal conversations give a
    prompt only; a conversation without partner gives a completion only. Of several rows with one conversation and turn
    number, the least (role, text) counts, so repeated rows change nothing. Rows with a null pair, chosen or turn
    belong to no pair and are left out. An empty table gives no rows; other columns are not read.
    """
    rows = turns.select(pair.cast("long").alias("pair_id"), chosen.alias("chosen"), F.col(turn_col).alias("turn"), F.struct(F.col(role_col).alias("role"), F.col(text_col).alias("text")).alias("said"))
    rows = rows.where("pair_id is not null and chosen is not null and turn is not null")
    # one shuffle brings both sides of a turn together; minima are taken before it
    sides = rows.groupBy("pair_id", "turn").agg(F.min(F.when(F.col("chosen"), F.col("said"))).alias("a"), F.min(F.when(~F.col("chosen"), F.col("said"))).alias("b"))
    differ = F.col("a").isNull() | F.col("b").isNull() | ~F.col("a").eqNullSafe(F.col("b"))
    cut = sides.where(differ).groupBy("pair_id").agg(F.min("turn").alias("cut"))
    placed = sides.join(cut, "pair_id", "left")
    prompt = F.col("cut").isNull() | (F.col("turn") < F.col("cut"))
    entry = lambda part, said: F.struct(F.lit(part).alias("part"), said.alias("said"))
    parts = F.when(prompt, F.array(entry("prompt", F.col("a")))).otherwise(F.filter(F.array(entry("chosen", F.col("a")), entry("rejected", F.col("b"))), lambda p: p["said"].isNotNull()))
    out = placed.select("pair_id", "turn", F.explode(parts).alias("p"))
    said = F.col("p.said")
    trained = (F.col("p.part") != "prompt") & F.coalesce(said["role"] == TRAINED, F.lit(False))
    return out.select("pair_id", F.col("p.part").alias("part"), "turn", said["role"].alias("role"), rendered(said["role"], said["text"]).alias("rendered"), trained.alias("trained"))


def paired(parts: DataFrame) -> DataFrame:
    """(pair_id, prompt, chosen, rejected, chosen_mask, rejected_mask): a row for each pair of preferences(), sides that lack being empty.

    A mask holds the ranges (start, end exclusive, in code points of its completion) that are trained on. The turns of
    one pair come together here, so a pair has to fit in a row; preferences() itself has no such bound.
    """
    turns = parts.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part", "rendered", "trained"))).alias("s"))
    own = lambda part: F.filter("s", lambda x: x["part"] == part)
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")

    def step(state, x):
        end = state["at"] + F.length(x["rendered"])
        span = F.array(F.struct(state["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(x["trained"], F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    mask = lambda part: F.aggregate(own(part), F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    text = lambda part: F.array_join(F.transform(own(part), lambda x: x["rendered"]), "")
    return turns.select("pair_id", *(text(p).alias(p) for p in ("prompt", "chosen", "rejected")), *(mask(p).alias(f"{p}_mask") for p in ("chosen", "rejected")))


#: The registered query's pairs: conversations 2k (chosen) and 2k + 1 (rejected).
SQL = r"""
WITH r AS (SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS k FROM r),
s AS (SELECT * FROM o WHERE k = 1),
j AS (SELECT pair_id, turn, a.side IS NOT NULL AS has_a, b.side IS NOT NULL AS has_b, a.role AS a_role, a.text AS a_text, b.role AS b_role, b.text AS b_text
      FROM (SELECT * FROM s WHERE side = 0) a FULL JOIN (SELECT * FROM s WHERE side = 1) b USING (pair_id, turn)),
c AS (SELECT pair_id, min(turn) AS cut FROM j WHERE NOT (has_a AND has_b AND a_role IS NOT DISTINCT FROM b_role AND a_text IS NOT DISTINCT FROM b_text) GROUP BY 1),
p AS (SELECT j.*, cut IS NULL OR turn < cut AS common FROM j LEFT JOIN c USING (pair_id)),
u AS (SELECT pair_id, 'prompt' AS part, turn, a_role AS role, a_text AS text FROM p WHERE common
      UNION ALL SELECT pair_id, 'chosen', turn, a_role, a_text FROM p WHERE NOT common AND has_a
      UNION ALL SELECT pair_id, 'rejected', turn, b_role, b_text FROM p WHERE NOT common AND has_b)
SELECT pair_id, part, turn, role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND coalesce(role = 'assistant', false) AS trained
FROM u
"""
