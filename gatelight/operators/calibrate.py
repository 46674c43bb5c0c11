"""Threshold calibration: curves by running sums, selections, holdouts, fusion sweeps.

A curve takes one pass: scores are counted by value, candidates are put between them, and running
sums give the errors at each candidate. The ordered pass is over distinct 6-digit scores and
candidates, of which there are a bounded number, not over the trials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelight.functions import metrics as M
from gatelight.operators.ranks import ranked


def candidates(trials: DataFrame, keys: list[str], grid: tuple[float, float, float] = (-0.5, 1.5, 0.01), ranged: bool = False) -> DataFrame:
    """The scores and a fixed grid as thresholds, for each group; ranged adds 200 even steps over the group's
    scores, of 0.0001 at least. Among equally good thresholds the highest is chosen, so more of them matter."""
    lo, hi, step = grid
    n = round((hi - lo) / step)
    steps = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.round(F.lit(lo) + i * step, 6))
    groups = trials.select(*keys).distinct() if keys else trials.sparkSession.range(1).select()
    fixed = groups.select(*keys, F.explode(steps).alias("thr"))
    found = trials.select(*keys, F.col("score").alias("thr")).union(fixed)
    if ranged:
        ends = trials.groupBy(*keys).agg(F.min("score").alias("lo"), F.max("score").alias("hi")).where("lo IS NOT NULL")
        step = F.greatest((F.col("hi") - F.col("lo")) / 200, F.lit(1e-4))
        n = F.floor((F.col("hi") - F.col("lo") + 1e-12) / step)
        found = found.union(ends.select(*keys, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), n), lambda i: F.round(F.col("lo") + i * step, 6)))))
    return found.distinct()


def curve(trials: DataFrame, keys: list[str] | None = None, grid=(-0.5, 1.5, 0.01), ranged: bool = False) -> DataFrame:
    """(*keys, thr, frr, far, rr, contest): trials has score (6 digits) and present; score >= thr accepts."""
    keys = keys or []
    counts = trials.groupBy(*keys, "score").agg(F.count_if("present").alias("p"), F.count_if(~F.col("present")).alias("q"))
    thr = candidates(trials, keys, grid, ranged)
    marks = counts.select(*keys, F.col("score").alias("x"), "p", "q", F.lit(None).cast("double").alias("thr"))
    marks = marks.union(thr.select(*keys, F.col("thr").alias("x"), F.lit(0).cast("long"), F.lit(0).cast("long"), "thr"))
    below = Window.partitionBy(*keys).orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys)
    at = Window.partitionBy(*keys, "x")
    out = marks.select(
        *keys, "thr", (F.sum("p").over(below) - F.sum("p").over(at)).alias("fr"), (F.sum("q").over(below) - F.sum("q").over(at)).alias("rj"),
        F.sum("p").over(whole).alias("n_p"), F.sum("q").over(whole).alias("n_q"),
    ).where("thr is not null")
    frr, rr = M.rate(F.col("fr"), F.col("n_p"), 0.0), M.rate(F.col("rj"), F.col("n_q"), 1.0)
    return out.select(*keys, "thr", F.round(frr, 9).alias("frr"), F.round(1 - rr, 9).alias("far"), F.round(rr, 9).alias("rr"), F.round(M.contest(rr, frr), 9).alias("contest"))


def _first(c: DataFrame, keys: list[str], order: Column) -> DataFrame:
    row = F.struct("thr", "frr", "far", "rr", "contest")
    return c.groupBy(*keys).agg(F.max_by(row, order).alias("r")).select(*keys, "r.*")


def select_contest(c: DataFrame, keys: list[str] | None = None, highest: bool = True) -> DataFrame:
    """Best contest; of equals the highest (or lowest) threshold."""
    return _first(c, keys or [], F.struct("contest", F.col("thr") if highest else -F.col("thr")))


def select_frr(c: DataFrame, target: float, keys: list[str] | None = None) -> DataFrame:
    """Least FAR with frr <= target, then the highest threshold; if none, least frr."""
    ok = F.col("frr") <= target
    return _first(c, keys or [], F.struct(ok, F.when(ok, -F.col("far")).otherwise(-F.col("frr")), "thr"))


def select_eer(c: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _first(c, keys or [], F.struct(-F.abs(F.col("frr") - F.col("far")), -F.col("thr")))


def holdout(df: DataFrame, strata: list[str], frac: float, seed: int = 42, id_col: str = "uid", floors: tuple[int, int] | None = None) -> DataFrame:
    """`df` with held_out: in each stratum the first round(frac * n) rows by md5 of id and seed.

    With floors (positives, negatives) a stratum keeps at least that many rows for calibration, by its `present`.
    """
    out = ranked(df, strata, id_col, seed)
    quota = F.floor(F.col("__gl_total") * frac + 0.5)
    if floors:
        quota = F.least(quota, F.greatest(F.lit(0), F.col("__gl_total") - F.when(F.col("present"), floors[0]).otherwise(floors[1])))
    return out.withColumn("held_out", F.col("turn") <= quota).drop("turn", "__gl_total")


def stratified_limit(df: DataFrame, n: int, stratum: str = "label", id_col: str = "uid") -> DataFrame:
    """About n rows, by share of the strata, one at least of each; `turn` interleaves them."""
    counted = ranked(df, [stratum], id_col).crossJoin(F.broadcast(df.agg(F.count("*").alias("__gl_n"))))  # one row
    quota = F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("__gl_total") / F.col("__gl_n") + 0.5))
    return counted.where(F.col("turn") <= quota).withColumn("turn", F.col("turn").cast("int")).drop("__gl_n", "__gl_total")


def grid_of(spark, lo: float, hi: float, n: int, name: str) -> DataFrame:
    """n evenly spaced thresholds."""
    return spark.range(n).select(F.round(F.lit(lo) + F.col("id") * ((hi - lo) / (n - 1)), 6).alias(name))


def fuse_two(trials: DataFrame, n: int = 41, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """(mode, tp, ts, rr, frr, contest) of all threshold pairs for accepting if s1 >= tp or / and s2 >= ts.

    Scores are counted in the cells between thresholds; two running sums over the cells, n + 1 by
    n + 1 whatever the number of trials, give every pair.
    """
    spark, step = trials.sparkSession, (hi - lo) / (n - 1)
    a, b = grid_of(spark, lo, hi, n, "tp"), grid_of(spark, lo, hi, n, "ts")
    rank = lambda s: F.greatest(F.lit(0), F.least(F.lit(n), F.floor((F.col(s) - lo) / step + 1e-9) + 1)).cast("int")  # noqa: E731  thresholds <= s
    cells = trials.groupBy(rank("s1").alias("i"), rank("s2").alias("j")).agg(F.count_if("present").alias("p"), F.count_if(~F.col("present")).alias("q"))
    full = spark.range(n + 1).select(F.col("id").cast("int").alias("i")).crossJoin(F.broadcast(spark.range(n + 1).select(F.col("id").cast("int").alias("j"))))
    full = full.join(cells, ["i", "j"], "left").na.fill(0)
    by_row = Window.partitionBy("i").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_col = Window.partitionBy("j").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = full.withColumns({c: F.sum(c).over(by_row) for c in "pq"}).withColumns({c: F.sum(c).over(by_col) for c in "pq"})
    tot = trials.agg(F.count_if("present").alias("np"), F.count_if(~F.col("present")).alias("nq"))
    # P(i, j): trials with both scores under the thresholds of rank i + 1 and j + 1; margins from the last row and column
    either = low.where((F.col("i") < n) & (F.col("j") < n))
    row = low.where(F.col("j") == n).select("i", F.col("p").alias("pi"), F.col("q").alias("qi"))
    col = low.where(F.col("i") == n).select("j", F.col("p").alias("pj"), F.col("q").alias("qj"))
    all_ = either.join(F.broadcast(row), "i").join(F.broadcast(col), "j").crossJoin(F.broadcast(tot))
    modes = F.explode(F.array(
        F.struct(F.lit("or").alias("mode"), F.col("p").alias("fr"), F.col("q").alias("rj")),
        F.struct(F.lit("and").alias("mode"), (F.col("pi") + F.col("pj") - F.col("p")).alias("fr"), (F.col("qi") + F.col("qj") - F.col("q")).alias("rj")),
    ))
    out = all_.select("i", "j", "np", "nq", modes.alias("m")).select("i", "j", "np", "nq", "m.*")
    rr, frr = M.rate(F.col("rj"), F.col("nq"), 1.0), M.rate(F.col("fr"), F.col("np"), 0.0)
    thr = lambda c: F.round(F.lit(lo) + F.col(c) * step, 6)
    return out.select("mode", thr("i").alias("tp"), thr("j").alias("ts"), F.round(rr, 9).alias("rr"), F.round(frr, 9).alias("frr"), F.round(M.contest(rr, frr), 9).alias("contest"))


def gray_rescue(trials: DataFrame, margins: list[float], thresholds: list[float], seconds: list[float]) -> DataFrame:
    """(tp, m, ts, rr, frr, contest): accept if s1 >= tp, or s1 >= tp - m and s2 >= ts."""
    spark = trials.sparkSession
    rules = spark.range(1).select(F.explode(F.array(*map(F.lit, thresholds))).alias("tp"))
    rules = rules.select("tp", F.explode(F.array(*map(F.lit, margins))).alias("m")).select("tp", "m", F.explode(F.array(*map(F.lit, seconds))).alias("ts"))
    accept = (F.col("s1") >= F.col("tp")) | ((F.col("s1") >= F.col("tp") - F.col("m")) & (F.col("s2") >= F.col("ts")))
    return sweep(trials, rules, ["tp", "m", "ts"], ~accept)


def sweep(rows: DataFrame, rules: DataFrame, params: list[str], reject: Column, weight: str | None = None) -> DataFrame:
    """Metrics of each rule of a short list; rules are broadcast to the rows, counts pre-aggregated.

    With `weight`, a row stands for that many.
    """
    w, p = F.col(weight) if weight else F.lit(1).cast("long"), F.col("present")
    n = lambda which: F.coalesce(F.sum(F.when(which, w)), F.lit(0))
    got = rows.crossJoin(F.broadcast(rules)).groupBy(*params).agg(n(p).alias("np"), n(~p).alias("nq"), n(p & reject).alias("fr"), n(~p & reject).alias("rj"))
    rr, frr = M.rate(F.col("rj"), F.col("nq"), 1.0), M.rate(F.col("fr"), F.col("np"), 0.0)
    return got.select(*params, F.round(rr, 9).alias("rr"), F.round(frr, 9).alias("frr"), F.round(M.contest(rr, frr), 9).alias("contest"))


def weighted(trials: DataFrame, alphas: list[float]) -> DataFrame:
    """Best threshold for each weight of a * s1 + (1 - a) * s2; equals: highest."""
    each = trials.select("present", "s1", "s2", F.explode(F.array(*map(F.lit, alphas))).alias("a"))
    each = each.withColumn("score", F.round(F.col("a") * F.col("s1") + (1 - F.col("a")) * F.col("s2"), 4))
    return select_contest(curve(each, ["a"]), ["a"])


def holdout_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, thr, n_present, n_absent, rr, frr, contest): the threshold chosen on the rows not held out, judged on those that are."""
    best = select_contest(curve(rows.where(~F.col("held_out")), keys), keys).select(*keys, F.col("thr").alias("__gl_thr"))
    p, low = F.col("present"), F.col("score") < F.col("__gl_thr")
    got = rows.where("held_out").join(F.broadcast(best), keys).groupBy(*keys, F.col("__gl_thr").alias("thr")).agg(
        F.count_if(p).alias("n_present"), F.count_if(~p).alias("n_absent"), F.count_if(p & low).alias("fr"), F.count_if(~p & low).alias("rj"),
    )
    rr, frr = M.rate(F.col("rj"), F.col("n_absent"), 1.0), M.rate(F.col("fr"), F.col("n_present"), 0.0)
    return got.select(*keys, "thr", "n_present", "n_absent", F.round(rr, 9).alias("rr"), F.round(frr, 9).alias("frr"), F.round(M.contest(rr, frr), 9).alias("contest"))


def rule_list(rows: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(name, *keys, rr, frr, contest) of named reject conditions, all counted in one pass without multiplying rows."""
    p = F.col("present")
    hits = [F.struct(F.lit(n).alias("name"), F.count_if(p & c).alias("fr"), F.count_if(~p & c).alias("rj")) for n, c in rules.items()]
    got = rows.groupBy(*keys).agg(F.count_if(p).alias("np"), F.count_if(~p).alias("nq"), F.array(*hits).alias("r"))
    got = got.select(*keys, "np", "nq", F.explode("r").alias("r")).select(*keys, "np", "nq", "r.*")
    rr, frr = M.rate(F.col("rj"), F.col("nq"), 1.0), M.rate(F.col("fr"), F.col("np"), 0.0)
    return got.select("name", *keys, F.round(rr, 9).alias("rr"), F.round(frr, 9).alias("frr"), F.round(M.contest(rr, frr), 9).alias("contest"))
