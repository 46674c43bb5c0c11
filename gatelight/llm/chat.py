"""Preference formatting of chosen and rejected conversations; DataFrame functions only.

The longest common prefix of turns is rendered once as the prompt, the rest of each side as its
completion, with character spans of the assistant's words for the loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.llm import common as C

TRAINED_ROLE = "assistant"


def render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _turn(turn_col: str, role_col: str, text_col: str) -> Column:
    return F.struct(F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def conversations_of(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): one row for each conversation, its turns in order.

    Turns with a null conversation are left out; null roles and texts count as empty; turns of one
    number follow by role and text, null numbers first; repeated turns stay. A conversation is one
    row, and has to fit into one. Other columns aren't read.
    """
    base = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), _turn(turn_col, role_col, text_col).alias("t"))
    return base.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))


def adjacent_pairs(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(pair_id, chosen, rejected): turns of conversation 2k as chosen against those of 2k + 1 as rejected,
    where both are there, by one exchange of the turns. Cases as for `conversations_of`."""
    conv = F.col(conv_col).cast("long")
    base = turns.where(F.col(conv_col).isNotNull()).select(F.shiftright(conv, 1).alias("pair_id"), (conv.bitwiseAND(1) == 0).alias("even"), _turn(turn_col, role_col, text_col).alias("t"))
    side = lambda which: F.array_sort(F.collect_list(F.when(which, F.col("t"))))
    both = base.groupBy("pair_id").agg(side(F.col("even")).alias("chosen"), side(~F.col("even")).alias("rejected"))
    return both.where((F.size("chosen") > 0) & (F.size("rejected") > 0))


def spans(turns: Column) -> Column:
    """array<struct<start, end>>: characters of the rendering that are text of TRAINED_ROLE."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"])
        own = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            (end + 8).cast("long").alias("at"),
            F.when((t["role"] == TRAINED_ROLE) & (F.length(t["text"]) > 0), F.concat(acc["out"], own)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(turns, zero, step, lambda acc: acc["out"])


def join_sides(pairs: DataFrame, conversations: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): `pairs` (pair_id, chosen_id, rejected_id) with the turns of
    `conversations` (as by `conversations_of`); pairs of which a side is missing are left out."""
    side = lambda name: conversations.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(name))
    own = pairs.select("pair_id", "chosen_id", "rejected_id")
    return own.join(side("chosen"), "chosen_id").join(side("rejected"), "rejected_id").select("pair_id", "chosen", "rejected")


def format_preferences(both: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask).

    `both` has pair_id and the turns of both sides, as by `adjacent_pairs` or `join_sides`; further
    columns aren't read. Turns are the same if role and text are. If one conversation begins with the other, or both
    are the same, a completion is empty, with no span. An empty table gives no rows.
    """
    plain = lambda c: F.transform(c, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = both.select("pair_id", plain("chosen").alias("chosen"), plain("rejected").alias("rejected"))
    differ = F.transform(F.arrays_zip("chosen", "rejected"), lambda z: ~(z["chosen"].eqNullSafe(z["rejected"])))
    first = F.array_position(differ, F.lit(True)).cast("int")
    both = both.withColumn("n", F.when(first > 0, first - 1).otherwise(F.size("chosen")))
    text = lambda c: F.array_join(F.transform(c, render), "")
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    return both.select(
        "pair_id", F.col("n").cast("long").alias("n_common"), text(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        text(rest("chosen")).alias("chosen"), text(rest("rejected")).alias("rejected"), spans(rest("chosen")).alias("chosen_mask"), spans(rest("rejected")).alias("rejected_mask"),
    )


def op3_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of adjacent conversations; masks as text, "start-end" joined by commas."""
    out = format_preferences(adjacent_pairs(C.table(spark, sf_dir, "conversations")))
    flat = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumns({c: flat(c) for c in ("chosen_mask", "rejected_mask")})


_SIDE_SQL = """
  SELECT pair_id, coalesce(string_agg(body, '' ORDER BY i), '') AS txt,
    coalesce(string_agg(CASE WHEN role = 'assistant' AND length(text) > 0 THEN (off + length(role) + 5)::VARCHAR || '-' || (off + length(role) + 5 + length(text))::VARCHAR END, ',' ORDER BY i), '') AS mask
  FROM (SELECT *, coalesce(sum(length(body)) OVER (PARTITION BY pair_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off
        FROM (SELECT n.pair_id, i, role, text, body FROM n JOIN t ON t.conv_id = n.{side} AND t.i > n.n_common))
  GROUP BY pair_id"""
OP3_SQL = f"""
WITH t AS (
  SELECT conv_id, role, text, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, count(*) AS k FROM t GROUP BY conv_id),
p AS (SELECT a.conv_id // 2 AS pair_id, a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.k AS ka, b.k AS kb
      FROM c a JOIN c b ON b.conv_id = a.conv_id + 1 WHERE a.conv_id % 2 = 0),
same AS (SELECT p.pair_id, max(x.i) AS last_same, min(CASE WHEN x.role <> y.role OR x.text <> y.text THEN x.i END) AS first_diff
         FROM p JOIN t x ON x.conv_id = p.chosen_id JOIN t y ON y.conv_id = p.rejected_id AND y.i = x.i GROUP BY p.pair_id),
n AS (SELECT p.*, coalesce(first_diff - 1, least(ka, kb)) AS n_common FROM p JOIN same USING (pair_id)),
pr AS (SELECT n.pair_id, string_agg(body, '' ORDER BY i) AS txt FROM n JOIN t ON t.conv_id = n.chosen_id AND t.i <= n.n_common GROUP BY n.pair_id),
ch AS ({_SIDE_SQL.format(side="chosen_id")}),
rj AS ({_SIDE_SQL.format(side="rejected_id")})
SELECT n.pair_id, n.n_common::BIGINT AS n_common, coalesce(pr.txt, '') AS prompt, coalesce(ch.txt, '') AS chosen, coalesce(rj.txt, '') AS rejected,
  coalesce(ch.mask, '') AS chosen_mask, coalesce(rj.mask, '') AS rejected_mask
FROM n LEFT JOIN pr USING (pair_id) LEFT JOIN ch USING (pair_id) LEFT JOIN rj USING (pair_id)
"""
