"""Sliding windows over samples and islands of energy, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(n: Column, win: int, hop: int, least: int) -> Column:
    """array<struct<start, end>> over n samples: windows every hop; a last one reaches the end.

    Up to one window's length gives one window of all; nothing, or null, gives none.
    """
    n = n.cast("int")
    count = F.ceil((n - win) / hop).cast("int")  # windows that begin before the last full one is reached
    starts = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: i * hop)
    made = F.transform(F.filter(starts, lambda s: s + least <= n), lambda s: F.struct(s.alias("start"), F.least(s + win, n).alias("end")))
    tail = F.struct(F.greatest(n - win, F.lit(0)).alias("start"), n.alias("end"))
    last = F.try_element_at(made, F.lit(-1))
    with_tail = F.when((last["end"] < n) & (n - last["start"] >= least), F.concat(made, F.array(tail))).otherwise(made)
    one = F.array(F.struct(F.lit(0).alias("start"), n.alias("end")))
    return F.when(n <= 0, F.slice(one, 1, 0)).when(n <= win, one).otherwise(with_tail)


def islands(frames: DataFrame, key: str, at: str, active: str, gap: int) -> DataFrame:
    """(key, first, last, frames): runs of active rows of a key whose steps in `at` are gap at most."""
    on = frames.where(F.col(active))
    w = Window.partitionBy(key).orderBy(at)
    begins = F.when(F.col(at) - F.lag(at).over(w) <= gap, 0).otherwise(1)
    numbered = on.withColumn("__gl_new", begins).withColumn("__gl_run", F.sum("__gl_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "__gl_run").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("frames")).drop("__gl_run")
