"""Places in an order, without a whole group in one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_statistics(df: DataFrame, keys: list[str], value: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """For each group the values at given places of the sorted order, by a function of the count n.

    Values are counted first, so a group is as many rows as it has different values (a million of 6 digits
    between 0 and 1), not as it has members. Nulls are left out; a group without values has no row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__gl_c"))
    whole = Window.partitionBy(*keys)
    upto = F.sum("__gl_c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("__gl_n", F.sum("__gl_c").over(whole)).withColumn("__gl_upto", upto)
    return counts.groupBy(*keys).agg(*[F.min(F.when(F.col("__gl_upto") > at(F.col("__gl_n")), F.col(value))).alias(name) for name, at in picks.items()])


def nearest_at(p: float) -> Callable[[Column], Column]:
    return lambda n: F.bround(F.lit(p) * (n - 1))


def floor_at(p: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(F.lit(p) * (n - 1))


def upper_middle(n: Column) -> Column:
    return F.floor(n / 2)


def percentiles(df: DataFrame, keys: list[str], value: str, picks: dict[str, float]) -> DataFrame:
    """(*keys, *picks): for each group the values at shares of the sorted order, between two places in proportion.

    Values are counted first, as in `order_statistics`; nulls are left out, and a group without values has no row.
    """
    below = {f"__gl_lo_{n}": floor_at(p) for n, p in picks.items()}
    above = {f"__gl_hi_{n}": (lambda n_, p=p: F.ceil(F.lit(p) * (n_ - 1))) for n, p in picks.items()}
    got = order_statistics(df, keys, value, {**below, **above})
    size = df.where(F.col(value).isNotNull()).groupBy(*[F.col(k).alias(f"__gl_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("__gl_size"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__gl_k{i}"))
    lerp = lambda n, p: F.col(f"__gl_lo_{n}") + (F.col(f"__gl_hi_{n}") - F.col(f"__gl_lo_{n}")) * (F.lit(p) * (F.col("__gl_size") - 1) - F.floor(F.lit(p) * (F.col("__gl_size") - 1)))
    return got.join(size, on).select(*keys, *[lerp(n, p).alias(n) for n, p in picks.items()])


def hashed(uid: Column, seed: int) -> Column:
    return F.md5(F.concat(uid.cast("string"), F.lit(f"|{seed}")))


def ranked(df: DataFrame, keys: list[str], uid: str, seed: int | None = None, name: str = "turn", total: str = "__gl_total") -> DataFrame:
    """Row numbers by md5 of the uid within each group, and the group's size, without a group in one task.

    Rows are numbered within bins of the md5's first four digits; counts of the bins, 65,536 for each group,
    give the number a bin begins with.
    """
    md5 = hashed(F.col(uid), seed) if seed is not None else F.md5(F.col(uid).cast("string"))
    binned = df.withColumn("__gl_md5", md5).withColumn("__gl_bin", F.substring("__gl_md5", 1, 4))
    counts = binned.groupBy(*keys, "__gl_bin").agg(F.count("*").alias("__gl_c"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    begin = F.sum("__gl_c").over(whole.orderBy("__gl_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__gl_c")
    counts = counts.withColumn("__gl_begin", begin).withColumn(total, F.sum("__gl_c").over(whole)).drop("__gl_c")
    own = F.row_number().over(Window.partitionBy(*keys, "__gl_bin").orderBy("__gl_md5", uid))
    out = binned.withColumn("__gl_own", own).join(counts, [*keys, "__gl_bin"])
    return out.withColumn(name, F.col("__gl_own") + F.col("__gl_begin")).drop("__gl_own", "__gl_begin", "__gl_bin", "__gl_md5")


def numbered(df: DataFrame, id_col: str, tie: str, name: str = "pos", width: int = 1 << 16) -> DataFrame:
    """Row numbers from 0 by (id, tie), null ids last. Ids are numbered in ranges of `width`, and counts of the
    ranges give the number a range begins with; rows without id are one range."""
    binned = df.withColumn("__gl_bin", F.coalesce(F.floor(F.col(id_col) / width), F.lit((1 << 62))))
    counts = binned.groupBy("__gl_bin").agg(F.count("*").alias("__gl_c"))
    whole = Window.partitionBy(F.lit(0)).orderBy("__gl_bin").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.select("__gl_bin", (F.sum("__gl_c").over(whole) - F.col("__gl_c")).alias("__gl_begin"))
    own = F.row_number().over(Window.partitionBy("__gl_bin").orderBy(id_col, tie))
    return binned.withColumn("__gl_own", own).join(counts, "__gl_bin").withColumn(name, (F.col("__gl_own") - 1 + F.col("__gl_begin")).cast("long")).drop("__gl_own", "__gl_begin", "__gl_bin")
