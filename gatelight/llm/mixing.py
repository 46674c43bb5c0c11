"""Mixing of sources to target weights by capped water-filling; DataFrame functions only.

A source's share of the total is by its weight. Sources whose share is more than their size times the most
epochs are clamped there, and what they can't take is dealt among the others by weight, until no source is
above. A source that is to stand e times is taken whole floor(e) times; for the rest, its documents are put
in a seeded order by their ids, and taken once more until the share is reached. The document group at which
it is reached is taken in part, each document by its first words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelight.llm import common as C

#: Groups in the seeded order of a source's documents; a source of any size is as many rows.
CELLS = 4096
#: Tasks that a source's documents are dealt to where they meet what was found for the source.
SALTS = 64
SEED = 12


def n_words(text: str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(C.WORD_PATTERN)), F.lit(0)).cast("long")


def cell_of(id_col: str, seed: int) -> Column:
    """The document's group: the first three digits of the md5 of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 3), 16, 10).cast("int")


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` with place: 0 for the least source by code points, and so on, null last.

    Rows are sorted over all tasks and written; a task's first place is the number of rows in the tasks before.
    """
    ordered = C.materialize(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    task = F.shiftright("at", 33)
    counts = ordered.groupBy(task.alias("task")).agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the sort
    begins = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("begin"))
    out = ordered.withColumn("task", task).join(begins, "task").withColumn("place", F.col("begin") + F.col("at") % F.lit(1 << 33))
    return out.drop("task", "begin", "at")


def water_levels(sources: DataFrame, max_epochs: int) -> DataFrame:
    """`sources` (source, source_size, weight) with target, the sum of which is that of the sizes.

    A round clamps what stands over the level of the one before, and the level only rises; rounds are sums
    over the table of sources, of which the driver gets three numbers. A source of weight 0 gets nothing; where
    the others can't take all, they are all clamped. Sizes and weights are integers.
    """
    cap = F.col("source_size") * max_epochs
    left, shares = None, None
    while True:
        # clamped: its cap is under its share at the level left / shares
        big = lambda c: c.cast("decimal(38,0)")  # noqa: E731  a long times a long
        clamped = F.lit(False) if left is None else big(cap) * F.lit(shares).cast("decimal(19,0)") < big(F.col("weight")) * F.lit(left).cast("decimal(19,0)")
        total, taken, free = sources.agg(F.sum("source_size"), F.sum(F.when(clamped, cap)), F.sum(F.when(~clamped, F.col("weight")))).first()
        now = ((total or 0) - (taken or 0), free or 0)
        if now == (left, shares) or not now[1]:
            break
        left, shares = now
    if left is None:  # no source, or none with a weight
        return sources.withColumn("target", F.lit(0.0))
    share = F.lit(left).cast("double") * F.col("weight") / F.lit(shares).cast("double")
    return sources.withColumn("target", F.when(clamped, cap.cast("double")).otherwise(share))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` with size, source_size, target, whole and taken.

    size counts the text's words (0 for null); source_size and target are those of the document's source: the
    sources in the order of code points, null last, have `weights` in turn, share out the sum of all sizes by
    them, and get `max_epochs` times their size at most (see `water_levels`). The mix has `whole` copies of
    the document and then its first taken - whole * size words. Sums of `taken` differ from the target by less
    than one word for each document of one group of CELLS. Rows of one id are in one group and share its fate; nothing
    depends on the order or the layout of the rows. Rows stay one to one; columns of these names are
    replaced, others kept. An empty table gives no rows.
    """
    names = ["size", "source_size", "target", "whole", "taken"]
    base = C.replace_columns(docs, names).withColumn("size", n_words(f"`{text_col}`"))
    keyed = base.select(F.col(f"`{source_col}`").cast("string").alias("source"), cell_of(f"`{id_col}`", seed).alias("cell"), "size")
    cells = C.materialize(keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")))
    sizes = cells.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = C.materialize(numbered(sizes).withColumn("weight", turn.cast("long")).drop("place"))
    levels = water_levels(sources, max_epochs)
    # whole copies, and words wanted beyond them
    size, wanted = F.col("source_size"), F.floor(F.col("target") + F.lit(0.5))
    levels = levels.withColumn("whole", F.when(size > 0, F.floor(wanted / size)).otherwise(0)).withColumn("more", wanted - F.col("whole") * size)
    # the group at which a source's running sum reaches what is wanted
    upto = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    run = cells.withColumn("upto", upto).select(F.col("source").alias("c_source"), "cell", "cell_size", "upto")
    reached = run.join(levels.select("source", "more"), F.col("source").eqNullSafe(F.col("c_source"))).where("more > 0 AND upto >= more")
    edge = F.min(F.struct("cell", "cell_size", (F.col("more") - F.col("upto") + F.col("cell_size")).alias("need"))).alias("edge")
    edges = reached.groupBy("source").agg(edge).select(F.col("source").alias("e_source"), "edge")
    plan = levels.join(edges, F.col("source").eqNullSafe(F.col("e_source")), "left")
    plan = plan.select(F.col("source").alias("__gl_source"), "source_size", "target", F.col("whole").cast("long").alias("whole"), F.col("edge").alias("__gl_edge"))
    plan = plan.withColumn("__gl_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col("__gl_source")) & (F.col("__gl_cell") % SALTS == F.col("__gl_salt"))
    out = base.withColumn("__gl_cell", cell_of(f"`{id_col}`", seed)).join(plan, same)
    edge, cell = F.col("__gl_edge"), F.col("__gl_cell")
    part = F.floor(F.col("size").cast("decimal(19,0)") * edge["need"].cast("decimal(19,0)") / edge["cell_size"].cast("decimal(19,0)"))
    once_more = F.when(edge.isNull() | (cell > edge["cell"]), F.lit(0)).when(cell < edge["cell"], F.col("size")).otherwise(part.cast("long"))
    return out.withColumn("taken", (F.col("whole") * F.col("size") + once_more).cast("long")).drop("__gl_cell", "__gl_salt", "__gl_source", "__gl_edge")


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mix` of `documents`: weights 1, 2, 3 in turn, three epochs at most."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 3) AS INTEGER) AS cell,
    coalesce(len([w FOR w IN string_split_regex(text, '[\x20\x09-\x0D]+') IF w <> '']), 0) AS size FROM documents),
cells AS (SELECT source, cell, CAST(sum(size) AS BIGINT) AS cell_size FROM sized GROUP BY ALL),
sources AS (SELECT source, CAST(sum(cell_size) AS BIGINT) AS size FROM cells GROUP BY source),
weighed AS (SELECT source, size, (row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1) % 3 + 1 AS w FROM sources),
-- in the order of cap by weight, the first k sources are clamped: the least k whose next one isn't over the level
turned AS (SELECT *, row_number() OVER (ORDER BY size / w, source) AS k FROM weighed),
levels AS (
  SELECT *, CAST(sum(size) OVER () - 3 * coalesce(sum(size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS rest,
    CAST(sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) AS shares FROM turned),
stop AS (SELECT k, rest, shares FROM levels WHERE 3 * size * shares >= rest * w ORDER BY k LIMIT 1),
targets AS (
  SELECT l.source, l.size, CASE WHEN s.k IS NULL OR l.k < s.k THEN CAST(3 * l.size AS DOUBLE)
    ELSE CAST(s.rest AS DOUBLE) * l.w / CAST(s.shares AS DOUBLE) END AS target FROM levels l LEFT JOIN stop s ON true),
whole AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // size ELSE 0 END AS whole FROM targets),
more AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - whole * size AS more FROM whole),
run AS (SELECT source, cell, cell_size, sum(cell_size) OVER (PARTITION BY source ORDER BY cell) AS upto FROM cells),
edges AS (
  SELECT run.source, min(struct_pack(c := cell, s := cell_size, need := more - upto + cell_size)) AS e
  FROM run JOIN more ON run.source IS NOT DISTINCT FROM more.source WHERE more > 0 AND upto >= more GROUP BY run.source)
SELECT doc_id, CAST(sized.size AS BIGINT) AS size, more.size AS source_size, target,
  CAST(whole * sized.size + CASE WHEN e IS NULL OR cell > e.c THEN 0 WHEN cell < e.c THEN sized.size
    ELSE CAST(sized.size AS HUGEINT) * e.need // e.s END AS BIGINT) AS taken
FROM sized JOIN more ON sized.source IS NOT DISTINCT FROM more.source
LEFT JOIN edges ON sized.source IS NOT DISTINCT FROM edges.source
"""
