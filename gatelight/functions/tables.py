"""Table functions for SQL and DataFrames.

`gl_windows(n, win, hop, least)` follows each row in a LATERAL join, as `operators.windows.sliding` does in an expression.
`gl_islands(gap => 3, row => TABLE(rows) PARTITION BY key ORDER BY at)` passes over a key's rows in their order with a constant state,
where `operators.windows.islands` needs two window passes and a group by.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import Row


class _Windows:
    """Windows over n samples, every `hop`; a last one reaches the end, and none is shorter than `least`."""

    def eval(self, n: int, win: int, hop: int, least: int) -> Iterator[tuple[int, int]]:
        if not n or n <= 0:
            return
        if n <= win:
            yield 0, n
            return
        start = end = None
        for at in range(0, max(0, -(-(n - win) // hop)) * hop + 1, hop):
            if at + least <= n:
                start, end = at, min(at + win, n)
                yield start, end
        if end is not None and end < n and n - start >= least:
            yield n - win, n


class _Islands:
    """Runs of a key's rows whose steps are `gap` at most; rows are (key, at), by at."""

    def __init__(self):
        self.key = self.first = self.last = None
        self.frames = 0

    def eval(self, row: Row, gap: int) -> Iterator[tuple]:
        key, at = row[0], row[1]
        if self.frames and at - self.last > gap:
            yield self.key, self.first, self.last, self.frames
            self.frames = 0
        if not self.frames:
            self.key, self.first = key, at
        self.last, self.frames = at, self.frames + 1

    def terminate(self) -> Iterator[tuple]:
        if self.frames:
            yield self.key, self.first, self.last, self.frames


def windows():
    return F.udtf(_Windows, returnType="start int, end int")


def islands(key_type: str = "long"):
    return F.udtf(_Islands, returnType=f"key {key_type}, first long, last long, frames long")


def register(spark: SparkSession, key_type: str = "long") -> None:
    """Makes gl_windows and gl_islands known to the session's SQL."""
    spark.udtf.register("gl_windows", windows())
    spark.udtf.register("gl_islands", islands(key_type))


def islands_of(rows: DataFrame, key: str, at: str, gap: int) -> DataFrame:
    """(key, first, last, frames) of `rows`, whose null places are left out; a null key is a key.

    A key's rows pass through one task, one by one: nothing of them is kept but the open island.
    """
    base = rows.where(F.col(at).isNotNull()).select(key, F.col(at).cast("long").alias(at))
    function = islands(base.schema[key].dataType.simpleString())
    return function(base.asTable().partitionBy(key).orderBy(at), F.lit(gap)).withColumnRenamed("key", key)


def windows_of(rows: DataFrame, n: Column, keep: list[str], win: int, hop: int, least: int) -> DataFrame:
    """(*keep, start, end): the windows of each row of n samples; rows of none have none."""
    spark = rows.sparkSession
    spark.udtf.register("gl_windows", windows())
    base = rows.select(*keep, n.cast("int").alias("__gl_n"))
    names = ", ".join(f"r.`{c}`" for c in keep)
    return spark.sql(f"SELECT {names}, w.start, w.end FROM {{rows}} r, LATERAL gl_windows(r.__gl_n, {int(win)}, {int(hop)}, {int(least)}) w", rows=base)
