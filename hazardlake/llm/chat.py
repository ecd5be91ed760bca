"""Preference pairs for training: one prompt, two masked completions.

Rows are turns, and stay turns: a pair is a set of rendered segments in order, of which no part
is gathered in one place, so a conversation of any length can be written out. Everything is a
DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.session import cut_lineage

START, END = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    """A turn as text; the marks of the format inside a role or a text are taken apart."""
    def clean(part: Column) -> Column:
        for mark in (START, END):
            part = F.replace(part, F.lit(mark), F.lit(mark[0] + " " + mark[1:]))
        return part

    return F.concat(F.lit(START), clean(role), F.lit("\n"), clean(text), F.lit(END + "\n"))


def preference_segments(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """(pair_id, part, turn, role, segment, learn, copies) of rows (pair_id, side, turn, role, text).

    ``side`` is 'chosen' or 'rejected'. The prompt is the longest run of turns, from the first
    on, in which both sides hold the same messages; each of its segments comes once, as part
    'prompt'. The turns after it are the completions, parts 'chosen' and 'rejected'. ``learn``
    is the loss mask: true for segments of ``learned_role`` in a completion.

    Turns are compared by number. A null role is 'user', a null text empty, a null turn comes
    after all others and always belongs to a completion. Messages that a side repeats at one
    turn are one row with ``copies``. Rows with a null pair or another side, and pairs of which
    a side is missing, are left out. Equal sides are all prompt. An empty table gives no rows;
    other columns are not looked at.
    """
    rows = (turns.filter("pair_id is not null and side in ('chosen', 'rejected')")
            .select("pair_id", "side", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("user")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text")))
    chosen = F.sum(F.when(F.col("side") == "chosen", 1).otherwise(0))
    rejected = F.sum(F.when(F.col("side") == "rejected", 1).otherwise(0))
    messages = rows.groupBy("pair_id", "turn", "role", "text").agg(chosen.alias("c"), rejected.alias("r"))
    differs = (F.col("c") != F.col("r")) & F.col("turn").isNotNull()
    pairs = (messages.groupBy("pair_id").agg(
        F.sum("c").alias("all_c"), F.sum("r").alias("all_r"), F.min(F.when(differs, F.col("turn"))).alias("split"))
        .filter("all_c > 0 and all_r > 0").select("pair_id", "split"))
    same = F.col("turn").isNotNull() & (F.col("split").isNull() | (F.col("turn") < F.col("split")))
    parts = F.when(same, F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("copies")))).otherwise(F.filter(
        F.array(F.struct(F.lit("chosen").alias("part"), F.col("c").alias("copies")),
                F.struct(F.lit("rejected").alias("part"), F.col("r").alias("copies"))), lambda p: p["copies"] > 0))
    out = messages.join(pairs, "pair_id").withColumn("p", F.explode(parts))
    return out.select("pair_id", F.col("p.part").alias("part"), "turn", "role",
                      rendered(F.col("role"), F.col("text")).alias("segment"),
                      ((F.col("p.part") != "prompt") & (F.col("role") == learned_role)).alias("learn"),
                      F.col("p.copies").alias("copies"))


def following(ids: DataFrame, levels: int = 3) -> DataFrame:
    """(x, after) of rows (x, first): ``first`` of the next greater x; the least follows the greatest.

    The upper bits of x cut the order into groups of at most 65,536 rows; the last row of a
    group is followed by the first one of the next group, which the same step finds one level up.
    """
    if levels == 0:
        order = Window.partitionBy(F.lit(0)).orderBy("x")
        return ids.select("x", F.coalesce(F.lead("first").over(order), F.first("first").over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    up = F.shiftright("x", 16)
    parents = following(ids.groupBy(up.alias("x")).agg(F.min("first").alias("first")), levels - 1)
    inside = ids.select("x", up.alias("up"), F.lead("first").over(Window.partitionBy(up).orderBy("x")).alias("inside"))
    return (inside.join(parents.select(F.col("x").alias("up"), "after"), "up")
            .select("x", F.coalesce("inside", "after").alias("after")))


def other_answers(conversations: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """Conversations as pairs (pair_id, side, turn, role, text): the own last answer or another one's.

    Chosen are the turns of a conversation up to its last message of ``learned_role``; rejected
    are the same turns before that, then the last answer of the conversation with the next
    greater id that has one (the least id follows the greatest). So both sides share what came
    before the answer. ``pair_id`` is the conv_id. Of several answers at the last turn the
    least text is handed on. A null role is 'user', a null text empty. Rows after the last
    answer, rows with a null turn or id, and conversations without an answer are left out. A
    lone conversation gets its own answer back, so it is all prompt.
    """
    rows = (conversations.filter("conv_id is not null and turn is not null")
            .select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"),
                    F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    answered = F.col("role") == learned_role
    ends = cut_lineage(rows.filter(answered).groupBy("pair_id").agg(F.max("turn").alias("last")), "answers")
    own = rows.join(ends, "pair_id").filter("turn <= last")
    answers = own.filter(answered & (F.col("turn") == F.col("last"))).groupBy("pair_id").agg(F.min("text").alias("text"))
    after = following(ends.select(F.col("pair_id").alias("x"), F.col("pair_id").alias("first")))
    swapped = (ends.join(after.withColumnRenamed("x", "pair_id"), "pair_id")
               .join(answers.withColumnRenamed("pair_id", "after"), "after")
               .select("pair_id", F.lit("rejected").alias("side"), F.col("last").alias("turn"), F.lit(learned_role).alias("role"), "text"))
    sides = F.when(F.col("turn") < F.col("last"), F.array(F.lit("chosen"), F.lit("rejected"))).otherwise(F.array(F.lit("chosen")))
    return own.select("pair_id", F.explode(sides).alias("side"), "turn", "role", "text").unionByName(swapped)


SQL = """
WITH said AS (
  SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
ends AS (SELECT conv_id, max(turn) AS last FROM said WHERE role = 'assistant' GROUP BY conv_id),
answers AS (
  SELECT conv_id, last, min(text) AS text FROM said JOIN ends USING (conv_id)
  WHERE turn = last AND role = 'assistant' GROUP BY ALL),
given AS (
  SELECT conv_id, last, coalesce(lead(text) OVER (ORDER BY conv_id), first_value(text) OVER (ORDER BY conv_id)) AS text
  FROM answers),
rows AS (
  SELECT conv_id AS pair_id, 1 AS c, turn, role, text FROM said JOIN ends USING (conv_id) WHERE turn <= last
  UNION ALL SELECT conv_id, 0, turn, role, text FROM said JOIN ends USING (conv_id) WHERE turn < last
  UNION ALL SELECT conv_id, 0, last, 'assistant', text FROM given),
messages AS (
  SELECT pair_id, turn, role, text, sum(c) AS c, sum(1 - c) AS r FROM rows GROUP BY ALL),
pairs AS (
  SELECT pair_id, min(CASE WHEN c <> r THEN turn END) AS split FROM messages
  GROUP BY pair_id HAVING sum(c) > 0 AND sum(r) > 0),
sides AS (
  SELECT m.*, split IS NULL OR turn < split AS same FROM messages m JOIN pairs USING (pair_id)),
parts AS (
  SELECT *, 'prompt' AS part, c AS copies FROM sides WHERE same
  UNION ALL SELECT *, 'chosen', c FROM sides WHERE NOT same AND c > 0
  UNION ALL SELECT *, 'rejected', r FROM sides WHERE NOT same AND r > 0)
SELECT pair_id, part, turn, role,
       '<|im_start|>' || replace(replace(role, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || chr(10)
         || replace(replace(text, '<|im_start|>', '< |im_start|>'), '<|im_end|>', '< |im_end|>') || '<|im_end|>' || chr(10) AS segment,
       part <> 'prompt' AND role = 'assistant' AS learn, CAST(copies AS BIGINT) AS copies
FROM parts
"""
