"""Joins by key, keep-last, resume, packing and submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.operators.ranks import numbered


def keep_last(df: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row of the greatest ordinal of each key."""
    row = F.max_by(F.struct(*[F.col(c) for c in df.columns]), F.col(ordinal))
    return df.groupBy(*[F.col(k).alias(f"__gl_{i}") for i, k in enumerate(keys)]).agg(row.alias("r")).select("r.*")


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], fine: list[str] | None = None) -> DataFrame:
    """Tasks without a finished record; `fine` are the statuses that count as finished."""
    if fine is not None:
        done = done.where(F.col("status").isin(fine))
    return tasks.join(done.select(*keys).distinct(), keys, "left_anti")


def stale(done: DataFrame, current: DataFrame, key: str, compare: list[str]) -> DataFrame:
    """Records whose compared columns are no longer those of the current rows, nulls being equal."""
    now = current.select(F.col(key), *[F.col(c).alias(f"__gl_{c}") for c in compare])
    differs = None
    for c in compare:
        d = ~F.col(c).eqNullSafe(F.col(f"__gl_{c}"))
        differs = d if differs is None else differs | d
    return done.join(now, key).where(differs).select(*[done[c] for c in done.columns])


def row_id(id_col: Column, uid: Column) -> Column:
    return F.coalesce(id_col.try_cast("long"), F.regexp_substr(uid, F.lit(r"(?<=_)\d+$")).try_cast("long"))


def label_of(label: Column, split: Column) -> Column:
    """present or absent; undecidable rows raise."""
    low, side = F.lower(F.trim(label)), F.lower(F.trim(split))
    return (
        F.when(low.isin("present", "pos", "positive", "1", "true"), "present").when(low.isin("absent", "neg", "negative", "0", "false"), "absent")
        .when(side == "pos", "present").when(side == "neg", "absent").otherwise(F.raise_error(F.lit("no label")))
    )


def submission(rows: DataFrame) -> DataFrame:
    """(pos, id, content, cer): positives by id (null last) and uid, numbered; rejected ones empty with cer 1."""
    out = rows.where("split = 'pos'").select(
        "id", "uid", F.when(F.col("reject"), "").otherwise(F.coalesce("content", F.lit(""))).alias("content"),
        F.when(F.col("reject"), 1.0).otherwise(F.coalesce("cer", F.lit(1.0))).alias("cer"),
    )
    return numbered(out, "id", "uid").select("pos", "id", "content", "cer")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)
