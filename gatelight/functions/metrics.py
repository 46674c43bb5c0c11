"""Aggregates as lists of columns, for groupBy().agg(*...) or agg(*...)."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(n: Column, d: Column, empty: float | None) -> Column:
    """n / d, and `empty` where d is 0."""
    out = F.try_divide(n.cast("double"), d.cast("double"))
    return out if empty is None else F.coalesce(out, F.lit(empty))


def contest(rr: Column, error: Column) -> Column:
    return 0.5 * rr + 0.5 * (1 - error)


def contest_metrics(present: Column, reject: Column, cer: Column) -> list[Column]:
    """Rejected negatives, rejected positives, CER with 1 for rejects and unknowns, and their score.

    Without negatives rr is 0; without positives frr and cer are 1.
    """
    n_pos, n_neg = F.count_if(present), F.count_if(~present)
    fr, rj = F.count_if(present & reject), F.count_if(~present & reject)
    rr, frr = rate(rj, n_neg, 0.0), rate(fr, n_pos, 1.0)
    total = F.coalesce(F.avg(F.when(present, F.when(reject, 1.0).otherwise(F.coalesce(cer, F.lit(1.0))))), F.lit(1.0))
    accepted = F.avg(F.when(present & ~reject, F.coalesce(cer, F.lit(1.0))))
    return [
        n_pos.alias("n_pos"), n_neg.alias("n_neg"), fr.alias("n_fr"), rj.alias("n_rej_neg"), F.round(rr, 6).alias("rr"), F.round(frr, 6).alias("frr"),
        F.round(total, 6).alias("cer"), F.round(accepted, 6).alias("cer_accept"), F.round(contest(rr, total), 6).alias("contest"),
    ]


def confusion(present: Column, accept: Column) -> list[Column]:
    tp, fp = F.count_if(present & accept), F.count_if(~present & accept)
    fn, tn = F.count_if(present & ~accept), F.count_if(~present & ~accept)
    far, frr = rate(fp, fp + tn, 0.0), rate(fn, tp + fn, 0.0)
    return [tp.alias("tp"), fp.alias("fp"), tn.alias("tn"), fn.alias("fn"), F.round(1 - far, 6).alias("rr"), F.round(frr, 6).alias("frr"), F.round(far, 6).alias("far"), F.round(contest(1 - far, frr), 6).alias("contest")]


def binary(truth: Column, said: Column) -> list[Column]:
    tp, fp, fn = F.count_if(truth & said), F.count_if(~truth & said), F.count_if(truth & ~said)
    p, r = rate(tp, tp + fp, 0.0), rate(tp, tp + fn, 0.0)
    return [F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(rate(F.count_if(truth == said), F.count("*"), 0.0), 6).alias("accuracy"), F.round(rate(2 * tp, 2 * tp + fp + fn, 0.0), 6).alias("f1")]


BUCKETS = ["=0", "(0,.25)", "[.25,.5)", "[.5,1)", "=1"]


def cer_bucket(c: Column) -> Column:
    return F.when(c <= 0, BUCKETS[0]).when(c < 0.25, BUCKETS[1]).when(c < 0.5, BUCKETS[2]).when(c < 1, BUCKETS[3]).otherwise(BUCKETS[4])


def cer_block(c: Column) -> list[Column]:
    """The moments and rates of a CER; its quantiles come from `ranks.order_statistics`."""
    return [
        F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.stddev_pop(c), 6).alias("std"),
        F.round(rate(F.count_if(c == 0), F.count(c), 0.0), 6).alias("exact_rate"), F.round(rate(F.count_if(c >= 1), F.count(c), 0.0), 6).alias("full_rate"),
    ]
