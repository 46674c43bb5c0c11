"""Summaries of recognition, regions, cells and rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.functions import metrics as M
from gatelight.operators import calibrate as K
from gatelight.operators.ranks import floor_at, hashed, nearest_at, order_statistics, ranked, upper_middle


def recognition_summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """Totals, means over all, accepted and exact rows, and quantiles of the CER, by group."""
    c = F.col("cer")
    first = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count(c).alias("n_known"), F.round(F.avg(c), 6).alias("mean_known"), F.round(F.avg(F.coalesce(c, F.lit(1.0))), 6).alias("mean_all"),
        F.round(F.avg(F.when(~F.col("reject"), c)), 6).alias("mean_accepted"), F.count_if(c == 0).alias("n_exact"), F.count_if(c >= 1).alias("n_full"),
    )
    stats = order_statistics(rows, by, "cer", {"p50": nearest_at(0.5), "p90": nearest_at(0.9), "p95": nearest_at(0.95)})
    return first.join(stats, by, "left")


def per_utterance(rows: DataFrame, key: list[str], arm: str, stream: str, cer: str) -> DataFrame:
    """One row for each utterance and arm: least and greatest CER, streams, the best one (ties: least name)."""
    best = F.min_by(F.col(stream), F.struct(F.col(cer), F.col(stream)))
    return rows.groupBy(*key, arm).agg(F.min(cer).alias("least"), F.max(cer).alias("most"), F.count("*").alias("n_streams"), best.alias("best"))


def region(present: Column, reject: Column) -> Column:
    return F.when(present & ~reject, "TP").when(present, "FR").when(~reject, "FA").otherwise("TN")


def region_stats(rows: DataFrame, length: Column, at_least: int) -> DataFrame:
    """By region: size, moments of the text length, share of long texts."""
    rows = rows.withColumn("__gl_len", length)
    return rows.groupBy(region(F.col("present"), F.col("reject")).alias("region")).agg(
        F.count("*").alias("n"), F.round(F.avg("__gl_len"), 6).alias("mean_len"), F.round(F.stddev_pop("__gl_len"), 6).alias("std_len"), F.max("__gl_len").cast("long").alias("max_len"),
        F.round(M.rate(F.count_if(F.col("__gl_len") >= at_least), F.count("*"), 0.0), 6).alias("long_rate"),
    )


def first_match(rows: DataFrame, key: list[str], priority: Column, order: Column) -> DataFrame:
    """The row of the least priority of each key, the first one in order among equals; null priorities don't match."""
    row = F.min_by(F.struct(*[F.col(c) for c in rows.columns if c not in key]), F.struct(priority, order))
    return rows.where(priority.isNotNull()).groupBy(*key).agg(row.alias("r")).select(*key, "r.*")


def best_two(rows: DataFrame, key: list[str], score: str, order: str) -> DataFrame:
    """Best and second-best score of each key with their places; equal scores in their order."""
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(order).alias("o")))), 1, 2)
    got = rows.groupBy(*key).agg(top.alias("t"))  # windows of one waveform, a bounded group
    nth = lambda i: F.try_element_at("t", F.lit(i))
    return got.select(*key, (-nth(1)["s"]).alias("best"), nth(1)["o"].alias("best_at"), (-nth(2)["s"]).alias("second"), nth(2)["o"].alias("second_at"))


def speaker_cap(rows: DataFrame, speaker: str, uid: str, per_speaker: int, most: int, seed: int) -> DataFrame:
    """At most per_speaker rows of each speaker and `most` in all, by md5 order."""
    capped = ranked(rows, [speaker], uid, seed, "__gl_turn").where(F.col("__gl_turn") <= per_speaker).select(*rows.columns)
    return capped.orderBy(hashed(F.col(uid), seed), uid).limit(most)


def cohort_sample(rows: DataFrame, speaker: str, uid: str, size: int, seed: int, mode: str = "auto", per_speaker: int = 2) -> DataFrame:
    """A cohort by md5 order: flat, with a cap for each speaker, or flat where there are three speakers or fewer."""
    if mode == "auto":
        mode = "flat" if rows.select(speaker).distinct().limit(4).count() <= 3 else "per_spk"
    return rows.orderBy(hashed(F.col(uid), seed), uid).limit(size) if mode == "flat" else speaker_cap(rows, speaker, uid, per_speaker, size, seed)


def most_common(rows: DataFrame, value: str, ordinal: str, n: int) -> DataFrame:
    """The n most frequent values, equally frequent ones as first seen."""
    return rows.groupBy(value).agg(F.count("*").alias("n"), F.min(ordinal).alias("first")).orderBy(F.desc("n"), "first").limit(n)


def every(curve: DataFrame, order: str, step: int) -> DataFrame:
    """Rows 1, 1 + step, ... of a curve. A curve is bounded by its 6-digit scores."""
    return curve.withColumn("__gl_i", F.row_number().over(Window.orderBy(order))).where(F.col("__gl_i") % step == 1 % step).drop("__gl_i")


def calibration(rows: DataFrame, sweep: Callable[[DataFrame, list[str]], DataFrame], min_pos: int, min_neg: int) -> DataFrame:
    """A row for `all` and for each language with enough positives and negatives: support, mean scores by
    class, and what the injected `sweep` (rows, keys) chooses; other languages fall back to `all`."""
    both = rows.withColumn("scope", F.lit("all")).unionByName(rows.withColumn("scope", F.col("lang")))
    p, s = F.col("present"), F.col("score")
    support = both.groupBy("scope").agg(
        F.count_if(p).alias("n_pos"), F.count_if(~p).alias("n_neg"), F.round(F.avg(F.when(p, s)), 6).alias("mean_present"), F.round(F.avg(F.when(~p, s)), 6).alias("mean_absent"),
        F.min(s).alias("least"), F.max(s).alias("most"),
    ).where((F.col("n_pos") >= min_pos) & (F.col("n_neg") >= min_neg))
    return support.join(sweep(both.join(support.select("scope"), "scope", "left_semi"), ["scope"]), "scope")


def viable(grid: DataFrame, base: DataFrame, least_gain: float, most_frr: float) -> DataFrame:
    """Rules of a grid that gain enough contest and lose little, against the one row of `base` (contest, frr)."""
    b = base.select(F.col("contest").alias("__gl_c"), F.col("frr").alias("__gl_f"))
    out = grid.crossJoin(F.broadcast(b))  # one row
    out = out.withColumn("gain", F.round(F.col("contest") - F.col("__gl_c"), 9)).withColumn("extra_frr", F.round(F.col("frr") - F.col("__gl_f"), 9)).drop("__gl_c", "__gl_f")
    return out.where((F.col("gain") >= least_gain) & (F.col("extra_frr") <= most_frr))


def choose(grid: DataFrame, ties: list[Column]) -> DataFrame:
    return grid.orderBy(F.desc("contest"), "frr", *ties).limit(1)


def score_matrix(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Calibrated contest of each cell of (encoder, arm): rows have keys, present and score."""
    return K.select_contest(K.curve(cells, keys), keys)


def grouped_quantiles(rows: DataFrame, key: str, value: str, picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(key, is_all, *picks): values at places of the sorted order for each key and, with is_all, for all rows.

    Values are counted once, under both groupings; a grouping is as many rows as it has different values. A null
    key is a key. Groups without values have no row.
    """
    sets = rows.where(F.col(value).isNotNull()).groupingSets([[F.col(key), F.col(value)], [F.col(value)]], F.col(key), F.col(value))
    counts = sets.agg(F.count("*").alias("__gl_c"), F.grouping(key).cast("boolean").alias("is_all"))
    whole = Window.partitionBy("is_all", key)
    upto = F.sum("__gl_c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("__gl_n", F.sum("__gl_c").over(whole)).withColumn("__gl_upto", upto)
    return counts.groupBy(key, "is_all").agg(*[F.min(F.when(F.col("__gl_upto") > at(F.col("__gl_n")), F.col(value))).alias(name) for name, at in picks.items()])


def run_report(rows: DataFrame, split: str = "split") -> DataFrame:
    """One row for each split and one for all (is_all) of rows with present, decision, score, cer and latency_ms.

    Decisions are counted by name. A rejected positive has a CER of 1; one that is accepted but has none yet is pending, and
    while any is, cer and contest are null. Rates of nothing are null, but without negatives rr counts as 0 in
    contest, and without positives cer is 0. Latencies: mean, the upper middle one, and the one at 95 %.
    An empty table gives no rows.
    """
    p, d = F.col("present"), F.col("decision")
    n, n_pos, n_neg = F.count("*"), F.count_if(p), F.count_if(~p)
    value = F.when(d == "reject", 1.0).otherwise(F.col("cer"))
    pending = F.count_if(p & value.isNull())
    cer = F.when(pending == 0, F.coalesce(F.avg(F.when(p, value)), F.lit(0.0)))
    rr = M.rate(F.count_if(~p & (d == "reject")), n_neg, None)
    names = ("accept", "accept_no_tse", "reject", "stream_error", "pipeline_error")
    error = F.count_if(d.isin("stream_error", "pipeline_error"))
    six = lambda c, name: F.round(c, 6).alias(name)
    got = rows.groupingSets([[F.col(split)], []], F.col(split)).agg(
        F.grouping(split).cast("boolean").alias("is_all"), n.alias("n"), n_pos.alias("n_present"), n_neg.alias("n_absent"), *[F.count_if(d == x).alias(f"n_{x}") for x in names],
        six(M.rate(F.count_if(d == "accept"), n, None), "accept_rate"), six(M.rate(F.count_if(d == "reject"), n, None), "reject_rate"), six(M.rate(error, n, None), "error_rate"),
        six(F.avg("score"), "mean_score"), six(M.rate(F.count_if(p & (d == "reject")), n_pos, None), "frr"), six(M.rate(F.count_if(~p & (d == "accept")), n_neg, None), "far"), six(rr, "rr"),
        pending.alias("pending"), six(cer, "cer"), six(M.contest(F.coalesce(rr, F.lit(0.0)), cer), "contest"), six(F.avg("latency_ms"), "latency_mean"),
    )
    ranks = grouped_quantiles(rows.select(split, "latency_ms"), split, "latency_ms", {"latency_p50": upper_middle, "latency_p95": floor_at(0.95)})
    ranks = ranks.select(F.col(split).alias("__gl_split"), F.col("is_all").alias("__gl_all"), "latency_p50", "latency_p95")
    same = F.col(split).eqNullSafe(F.col("__gl_split")) & (F.col("is_all") == F.col("__gl_all"))
    return got.join(ranks, same, "left").drop("__gl_split", "__gl_all")


def region_report(rows: DataFrame, lengths: tuple[int, ...] = (12, 14, 16, 18)) -> DataFrame:
    """By region of rows with present, reject, tl, primary and task: length moments and places, shares of long texts and of classes."""
    rows = rows.withColumn("region", region(F.col("present"), F.col("reject")))
    share = lambda cond, name: F.round(M.rate(F.count_if(cond), F.count("*"), 0.0), 6).alias(name)
    kind = F.col("primary")
    got = rows.groupBy("region").agg(
        F.count("*").alias("n"), F.round(F.avg("tl"), 6).alias("len_mean"), share(F.col("task"), "task_rate"), *[share(F.col("tl") >= n, f"len_ge{n}") for n in lengths],
        share(kind.isin("闲聊/背景", "其他", "设备播报", "空转写"), "chat_or_other"), share(kind == "设备播报", "tts"),
    )
    return got.join(order_statistics(rows, ["region"], "tl", {"len_p50": upper_middle, "len_p90": nearest_at(0.9)}), "region", "left")


def length_precision(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(len, n_fa_hit, n_tp_hit, prec_as_neg, fa_recall): how well a length tells absent from present among accepted rows."""
    ok, p = ~F.col("reject"), F.col("present")
    hits = [F.struct(F.lit(n).alias("len"), F.count_if(ok & ~p & (F.col("tl") >= n)).alias("n_fa_hit"), F.count_if(ok & p & (F.col("tl") >= n)).alias("n_tp_hit")) for n in lengths]
    got = rows.agg(F.count_if(ok & ~p).alias("n_fa"), F.array(*hits).alias("h")).select("n_fa", F.explode("h").alias("h")).select("n_fa", "h.*")
    a, b = F.col("n_fa_hit"), F.col("n_tp_hit")
    return got.select("len", a, b, F.round(M.rate(a, a + b, None), 6).alias("prec_as_neg"), F.round(M.rate(a, F.col("n_fa"), None), 6).alias("fa_recall"))
