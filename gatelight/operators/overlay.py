"""Joins of scores, recognition records and transcripts, and what the overlay reads off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

USABLE = ["ok", "empty_hyp"]


def usable(status: Column, cer: Column) -> Column:
    """Recognition rows that count: finished, with a CER."""
    return status.isin(*USABLE) & cer.isNotNull()


def source_key(uid: Column, row_id: Column) -> Column:
    """The key of an overlay source: its uid, or pos_<id> where it has none."""
    return F.coalesce(uid, F.concat(F.lit("pos_"), row_id.cast("string")))


def joined(records: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """Every record with its score; a record without one raises when the rows are read."""
    hit = scores.withColumn("__gl_hit", F.lit(True))
    out = records.join(hit, key, "left")
    missing = F.raise_error(F.concat(F.lit("no score for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return out.withColumn(key, F.when(F.col("__gl_hit"), F.col(key)).otherwise(missing.cast(records.schema[key].dataType))).drop("__gl_hit")


def first_true(*values: Column) -> Column:
    """The first value that is neither null nor zero, else the last."""
    return F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])


def with_alternative(base: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`base` with its columns replaced by those of `other` where the row is positive and the latter not null."""
    alt = other.select(key, *[F.col(c).alias(f"__gl_{c}") for c in columns])
    out = base.join(alt, key, "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("split") == "pos", F.coalesce(f"__gl_{c}", c)).otherwise(F.col(c)))
    return out.select(*base.columns)


def pending_cer(rejected: Column, *texts: Column) -> Column:
    """1 for rejected rows, else the first text that is a number, else null: not known yet."""
    return F.when(rejected, F.lit(1.0)).otherwise(F.coalesce(*[t.try_cast("double") for t in texts]))


def lift_counts(before: Column, after: Column, present: Column) -> list[Column]:
    """What an overlay changes: rows newly rejected by side, rows newly accepted, accepted negatives left."""
    extra, flip = ~before & after, before & ~after
    return [
        F.count_if(extra).alias("n_extra_reject"), F.count_if(extra & present).alias("n_extra_pos"), F.count_if(extra & ~present).alias("n_extra_neg"),
        F.count_if(flip).alias("n_flip"), F.count_if(flip & present).alias("n_need_recognition"), F.count_if(~after & ~present).alias("n_accepted_neg"),
    ]


def with_predictions(backup: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, content, label, cer) of each entry of a backup result (id, label), as the decisions of `rows` have it.

    `rows` are positives with id, reject, content and cer, of one id the one of the least content. Rejected ones are
    empty with a CER of 1, as are entries without a row, and so counts a CER that isn't known.
    """
    one = rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.min(F.struct("content", "reject", "cer")).alias("__gl_r"))
    kept = ~F.coalesce(F.col("__gl_r.reject"), F.lit(True))
    return backup.join(one, "id", "left").select(
        "id", F.when(kept, F.coalesce("__gl_r.content", F.lit(""))).otherwise("").alias("content"), "label", F.when(kept, F.coalesce("__gl_r.cer", F.lit(1.0))).otherwise(1.0).alias("cer"),
    )
