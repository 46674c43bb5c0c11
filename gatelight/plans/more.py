"""Further registered queries: overlay joins, summaries, cohorts, matrices, rule search, calibration document."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelight.functions import metrics as M
from gatelight.operators import analysis as A
from gatelight.operators import calibrate as K
from gatelight.operators import cube as B
from gatelight.operators import overlay as V
from gatelight.operators import relational as J
from gatelight.operators import rules as R
from gatelight.plans import views as D
from gatelight.plans.queries import P, RATES, T, _curve_sql, gray_axes, in_gray, over_whole_texts, query, veto_axis

#: Recognition records: the text of the document with the vector's number.
REC = "rec AS (SELECT doc_id AS vec_id, coalesce(length(text), 0)::INT AS tl, coalesce(regexp_matches(text, '[0-9]'), false) AS digits, lang AS text_lang, source FROM documents)"


def _rec(spark, d):
    text = F.col("text")
    return D.read(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.coalesce(F.length(text), F.lit(0)).alias("tl"), F.coalesce(text.rlike("[0-9]"), F.lit(False)).alias("digits"), F.col("lang").alias("text_lang"), "source")


def _known(spark, d):
    """Trials whose vector has a record, and the records."""
    rec = _rec(spark, d)
    return D.trials(spark, d).join(rec.select("vec_id"), "vec_id", "left_semi"), rec


# ---- overlay ----
@query(f"""{T}, {REC} SELECT uid, tl, reject, reject OR (score - thr BETWEEN 0 AND 0.1 AND tl >= 500 AND NOT digits) AS text_reject, s2 < score - 0.12::DOUBLE AND score - thr BETWEEN 0 AND 0.1 AND NOT reject AS veto
 FROM trials JOIN rec USING (vec_id)""")
def overlay_joined(spark, d):
    t, rec = _known(spark, d)
    both = V.joined(t, rec, "vec_id")
    extra = R.upper_gray(F.col("score"), F.col("thr"), F.lit(0.1)) & (F.col("tl") >= 500) & ~F.col("digits")
    veto = (F.col("s2") < F.col("score") - 0.12) & R.upper_gray(F.col("score"), F.col("thr"), F.lit(0.1)) & ~F.col("reject")
    return both.select("uid", "tl", "reject", (F.col("reject") | extra).alias("text_reject"), veto.alias("veto"))


@query(f"""{T}, {REC}, sims AS (SELECT uid, CASE WHEN vec_id % 5 = 0 THEN 0 WHEN vec_id % 7 = 0 THEN NULL ELSE s1 END AS sim FROM trials WHERE vec_id % 3 > 0)
 SELECT t.uid, tl, coalesce(nullif(sim, 0), nullif(s2, 0), score) AS score FROM trials t LEFT JOIN rec USING (vec_id) LEFT JOIN sims USING (uid)""")
def overlay_sources(spark, d):
    t = D.trials(spark, d)
    v = F.col("vec_id")
    sims = t.where(v % 3 > 0).select("uid", F.when(v % 5 == 0, 0.0).when(v % 7 == 0, None).otherwise(F.col("s1")).alias("sim"))
    both = t.join(_rec(spark, d), "vec_id", "left").join(sims, "uid", "left")
    return both.select("uid", "tl", V.first_true(F.col("sim"), F.col("s2"), F.col("score")).alias("score"))


@query(f"{T}, {REC} SELECT t.uid, t.reject, r.tl, coalesce(quality, -1)::INT AS quality FROM trials t LEFT JOIN rec r ON r.vec_id = t.vec_id AND r.digits LEFT JOIN labels l ON l.doc_id = t.vec_id WHERE t.split = 'neg'")
def neg_transcripts(spark, d):
    t = D.trials(spark, d).where("split = 'neg'").select("uid", "vec_id", "reject")
    meta = D.read(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    out = t.join(_rec(spark, d).where("digits").select("vec_id", "tl"), "vec_id", "left").join(meta, "vec_id", "left")
    return out.select("uid", "reject", "tl", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"))


@query(f"{T}, alt AS (SELECT uid, CASE WHEN vec_id % 4 > 0 THEN round(abs(s1), 6) END AS cer FROM trials WHERE vec_id % 2 = 0) SELECT t.uid, t.split, CASE WHEN t.split = 'pos' THEN coalesce(a.cer, t.cer) ELSE t.cer END AS cer FROM trials t LEFT JOIN alt a USING (uid)")
def overlay_substitution(spark, d):
    t = D.trials(spark, d).select("uid", "split", "cer", "vec_id", "s1")
    alt = t.where("vec_id % 2 = 0").select("uid", F.when(F.col("vec_id") % 4 > 0, F.round(F.abs("s1"), 6)).alias("cer"))
    return V.with_alternative(t.select("uid", "split", "cer"), alt, "uid", ["cer"])


@query("SELECT coalesce(CASE WHEN doc_id % 2 = 0 THEN source || '_' || doc_id END, 'pos_' || doc_id) AS key FROM documents")
def overlay_keys(spark, d):
    uid = F.when(F.col("doc_id") % 2 == 0, F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string")))
    return D.read(spark, d, "documents").select(V.source_key(uid, F.col("doc_id")).alias("key"))


_AFTER = "(reject OR score - thr BETWEEN 0 AND 0.1 AND s2 < score - 0.12::DOUBLE) AND NOT (reject AND thr - score BETWEEN 0 AND 0.05 AND s2 > 0.1)"


@query(f"{T}, a AS (SELECT present, reject AS b, {_AFTER} AS a FROM trials) SELECT count_if(NOT b AND a) AS n_extra_reject, count_if(NOT b AND a AND present) AS n_extra_pos, count_if(NOT b AND a AND NOT present) AS n_extra_neg, count_if(b AND NOT a) AS n_flip, count_if(b AND NOT a AND present) AS n_need_recognition, count_if(NOT a AND NOT present) AS n_accepted_neg FROM a")
def lift_counts(spark, d):
    t = D.trials(spark, d)
    s, thr, s2 = F.col("score"), F.col("thr"), F.col("s2")
    after = (F.col("reject") | (R.upper_gray(s, thr, F.lit(0.1)) & (s2 < s - 0.12))) & ~(F.col("reject") & (thr - s).between(0, 0.05) & (s2 > 0.1))
    return t.agg(*V.lift_counts(F.col("reject"), after, F.col("present")))


@query(f"{T} SELECT uid, CASE WHEN reject THEN 1.0::DOUBLE ELSE coalesce(TRY_CAST(CASE WHEN vec_id % 3 = 0 THEN 'x' WHEN vec_id % 3 = 1 THEN s2::VARCHAR END AS DOUBLE), cer) END AS cer FROM trials WHERE present")
def pending_cer(spark, d):
    t = D.trials(spark, d).where("present")
    first = F.when(F.col("vec_id") % 3 == 0, "x").when(F.col("vec_id") % 3 == 1, F.col("s2").cast("string"))
    return t.select("uid", V.pending_cer(F.col("reject"), first, F.col("cer").cast("string")).alias("cer"))


# ---- summaries ----
@query(f"""{T} SELECT lang, count(*) AS n, count(cer) AS n_known, round(avg(cer), 6) AS mean_known, round(avg(coalesce(cer, 1.0::DOUBLE)), 6) AS mean_all, round(avg(cer) FILTER (NOT reject), 6) AS mean_accepted,
 count_if(cer = 0) AS n_exact, count_if(cer >= 1) AS n_full, {", ".join(f"(list_sort(list(cer) FILTER (cer IS NOT NULL)))[round_even({q} * (count(cer) - 1), 0)::INT + 1] AS p{int(q * 100)}" for q in (0.5, 0.9, 0.95))} FROM trials WHERE present GROUP BY lang""")
def recognition_summary(spark, d):
    return A.recognition_summary(D.trials(spark, d).where("present"), ["lang"])


@query(f"{P}, u AS (SELECT conv_id, arm, min(cer) AS least, max(cer) AS most, count(*) AS n_streams, arg_min(stream, (cer, stream)) AS best FROM pairs GROUP BY ALL) SELECT arm, best, count(*) AS n, round(avg(least), 6) AS mean_least, round(avg(most), 6) AS mean_most, max(n_streams) AS most_streams FROM u GROUP BY arm, best")
def arm_stats(spark, d, pairs=D.pairs):
    u = A.per_utterance(pairs(spark, d), ["conv_id"], "arm", "stream", "cer")
    return u.groupBy("arm", "best").agg(F.count("*").alias("n"), F.round(F.avg("least"), 6).alias("mean_least"), F.round(F.avg("most"), 6).alias("mean_most"), F.max("n_streams").alias("most_streams"))


@query(f"{P}, u AS (SELECT conv_id, bool_or(arm = 'no_sep' AND length(hyp) > 0) AS mix_speaks, bool_or(arm <> 'no_sep' AND length(hyp) > 0) AS sep_speaks FROM pairs GROUP BY conv_id) SELECT count(*) AS n, count_if(mix_speaks) AS n_mix, count_if(NOT mix_speaks AND sep_speaks) AS n_only_sep, round(count_if(NOT mix_speaks AND sep_speaks)::DOUBLE / count(*), 6) AS rate FROM u")
def neg_utterances(spark, d, pairs=D.pairs):
    speaks = F.length("hyp") > 0
    u = pairs(spark, d).groupBy("conv_id").agg(F.bool_or((F.col("arm") == "no_sep") & speaks).alias("mix"), F.bool_or((F.col("arm") != "no_sep") & speaks).alias("sep"))
    only = F.count_if(~F.col("mix") & F.col("sep"))
    return u.agg(F.count("*").alias("n"), F.count_if("mix").alias("n_mix"), only.alias("n_only_sep"), F.round(M.rate(only, F.count("*"), 0.0), 6).alias("rate"))


@query(f"{T}, {REC} SELECT CASE WHEN present AND NOT reject THEN 'TP' WHEN present THEN 'FR' WHEN NOT reject THEN 'FA' ELSE 'TN' END AS region, count(*) AS n, round(avg(tl), 6) AS mean_len, round(stddev_pop(tl), 6) AS std_len, max(tl)::BIGINT AS max_len, round(count_if(tl >= 500)::DOUBLE / count(*), 6) AS long_rate FROM trials JOIN rec USING (vec_id) GROUP BY 1")
def region_stats(spark, d):
    t, rec = _known(spark, d)
    return A.region_stats(V.joined(t, rec, "vec_id"), F.col("tl"), 500)


_CLASS = "CASE WHEN text IS NULL OR text = '' THEN 'empty' WHEN regexp_matches(text, '[?]') THEN 'question' WHEN regexp_matches(text, '[0-9]') THEN 'number' WHEN length(text) < 200 THEN 'short' ELSE 'long' END"


@query(f"WITH c AS (SELECT doc_id, source, {_CLASS} AS a, CASE WHEN contains(coalesce(text, ''), '!') THEN 'shout' ELSE {_CLASS} END AS b FROM documents) SELECT a, count(*) AS n, count_if(a = b) AS n_same, round(avg((a = b)::INT), 6) AS agreement, count_if(l.doc_id IS NULL) AS n_unlabelled FROM c LEFT JOIN labels l USING (doc_id) GROUP BY a")
def class_agreement(spark, d):
    t = F.col("text")
    a = F.when(t.isNull() | (t == ""), "empty").when(t.rlike("[?]"), "question").when(t.rlike("[0-9]"), "number").when(F.length(t) < 200, "short").otherwise("long")
    docs = D.read(spark, d, "documents").select("doc_id", a.alias("a"), F.when(F.coalesce(F.contains(t, F.lit("!")), F.lit(False)), "shout").otherwise(a).alias("b"))
    got = docs.join(D.read(spark, d, "labels").select("doc_id", F.lit(True).alias("hit")), "doc_id", "left")
    same = F.col("a") == F.col("b")
    return got.groupBy("a").agg(F.count("*").alias("n"), F.count_if(same).alias("n_same"), F.round(F.avg(same.cast("int")), 6).alias("agreement"), F.count_if(F.col("hit").isNull()).alias("n_unlabelled"))


@query(f"{T} SELECT spk AS backend, count_if(present AND NOT reject) AS n_accepted_present, count_if(NOT reject AND vec_id % 11 = 0) AS n_stream_error, round(avg(score) FILTER (present), 6) AS mean_present, round(avg(score) FILTER (NOT present), 6) AS mean_absent, round(max(score) - min(score), 6) AS span FROM trials GROUP BY spk")
def backend_ab(spark, d):
    p, s, ok = F.col("present"), F.col("score"), ~F.col("reject")
    return D.trials(spark, d).groupBy(F.col("spk").alias("backend")).agg(
        F.count_if(p & ok).alias("n_accepted_present"), F.count_if(ok & (F.col("vec_id") % 11 == 0)).alias("n_stream_error"),
        F.round(F.avg(F.when(p, s)), 6).alias("mean_present"), F.round(F.avg(F.when(~p, s)), 6).alias("mean_absent"), F.round(F.max(s) - F.min(s), 6).alias("span"),
    )


@query(f"{P} SELECT conv_id, arg_min(turn, (CASE arm WHEN 'no_sep' THEN 0 WHEN 'sep_once' THEN 1 END, turn)) AS turn, arg_min(cer, (CASE arm WHEN 'no_sep' THEN 0 WHEN 'sep_once' THEN 1 END, turn)) AS cer FROM pairs WHERE arm IN ('no_sep', 'sep_once') GROUP BY conv_id")
def first_match(spark, d, pairs=D.pairs):
    rank = F.when(F.col("arm") == "no_sep", 0).when(F.col("arm") == "sep_once", 1)
    return A.first_match(pairs(spark, d).select("conv_id", "arm", "turn", "cer"), ["conv_id"], rank, F.col("turn")).select("conv_id", "turn", "cer")


@query(f"{T}, w AS (SELECT vec_id, spk, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, spk) AS k FROM trials) SELECT vec_id, max(score) FILTER (k = 1) AS best, max(spk) FILTER (k = 1) AS best_at, max(score) FILTER (k = 2) AS second, max(spk) FILTER (k = 2) AS second_at FROM w GROUP BY vec_id")
def best_two(spark, d):
    return A.best_two(D.trials(spark, d), ["vec_id"], "score", "spk")


@query(f"""{T}, x AS (SELECT lang, score, cer, CASE WHEN vec_id % 2 = 0 THEN 'a' ELSE 'b' END AS kind, vec_id FROM trials) SELECT kind, count(*) AS n, min(vec_id) AS "first" FROM x GROUP BY kind ORDER BY n DESC, "first" LIMIT 2""")
def most_common(spark, d):
    x = D.trials(spark, d).select("vec_id", F.when(F.col("vec_id") % 2 == 0, "a").otherwise("b").alias("kind"))
    return A.most_common(x, "kind", "vec_id", 2)


@query(f"{P} SELECT conv_id, turn, round(length(hyp)::DOUBLE / nullif(length(ref), 0), 6) AS per_second FROM pairs")
def chars_per_second(spark, d, pairs=D.pairs):
    return pairs(spark, d).select("conv_id", "turn", F.round(F.try_divide(F.length("hyp").cast("double"), F.length("ref")), 6).alias("per_second"))


@query("SELECT lang, count(*) AS jobs, count(DISTINCT doc_id) AS utterances, count_if(NOT have) AS missing, arm FROM (SELECT doc_id, lang, arm, (doc_id + s) % 4 > 0 AS have FROM documents CROSS JOIN (VALUES ('no_sep', 0), ('sep_once', 1), ('sep_once', 2)) a(arm, s)) GROUP BY lang, arm")
def job_plan(spark, d):
    arms = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("s")) for a, s in (("no_sep", 0), ("sep_once", 1), ("sep_once", 2))])
    jobs = D.read(spark, d, "documents").select("doc_id", "lang", F.explode(arms).alias("a")).select("doc_id", "lang", "a.*").withColumn("have", (F.col("doc_id") + F.col("s")) % 4 > 0)
    # streams of an utterance are together, so its first one stands for it
    return jobs.groupBy("lang", "arm").agg(F.count("*").alias("jobs"), F.count_distinct("doc_id").alias("utterances"), F.count_if(~F.col("have")).alias("missing"))


# ---- cohorts ----
@query(f"{T} SELECT spk, uid FROM (SELECT *, row_number() OVER (PARTITION BY spk ORDER BY md5(uid || '|7'), uid) AS k FROM trials) WHERE k <= 5 ORDER BY md5(uid || '|7'), uid LIMIT 30")
def speaker_cap(spark, d):
    return A.speaker_cap(D.trials(spark, d), "spk", "uid", 5, 30, 7).select("spk", "uid")


@query(f"{T}, c AS (SELECT *, count(*) OVER () AS one, (SELECT count(DISTINCT spk) FROM trials) AS n_spk, row_number() OVER (PARTITION BY spk ORDER BY md5(uid || '|3'), uid) AS k FROM trials) SELECT uid FROM c WHERE n_spk <= 3 OR k <= 2 ORDER BY md5(uid || '|3'), uid LIMIT 16")
def cohort_sample(spark, d):
    return A.cohort_sample(D.trials(spark, d), "spk", "uid", 16, 3).select("uid")


# ---- matrices ----
_CELLS = "cells AS (SELECT encoder, arm, present, score FROM (SELECT present, vec_id, unnest([{'encoder': 'whole', 'score': score}, {'encoder': 'first', 'score': s1}, {'encoder': 'second', 'score': s2}], recursive := true), ['no_sep', 'sep_once', 'sep_multi'][(vec_id % 3 + 1)::INT] AS arm FROM trials))"


def _cells(spark, d):
    each = F.array(*[F.struct(F.lit(n).alias("encoder"), F.col(c).alias("score")) for n, c in (("whole", "score"), ("first", "s1"), ("second", "s2"))])
    arm = F.element_at(F.array(*map(F.lit, ("no_sep", "sep_once", "sep_multi"))), (F.col("vec_id") % 3 + 1).cast("int"))
    return D.trials(spark, d).select("present", "uid", arm.alias("arm"), F.explode(each).alias("e")).select("uid", "present", "arm", "e.*")


_MATRIX = f"{T}, {_CELLS}, {_curve_sql('encoder, arm', 'cells')}, best AS (SELECT * FROM curve QUALIFY row_number() OVER (PARTITION BY encoder, arm ORDER BY contest DESC, thr DESC) = 1)"


@query(f"{_MATRIX} SELECT * FROM best")
def score_matrix(spark, d):
    return A.score_matrix(_cells(spark, d), ["encoder", "arm"])


@query(f"{_MATRIX} SELECT encoder, arm, contest, frr FROM best ORDER BY contest DESC, frr, encoder, arm LIMIT 5")
def leaderboard(spark, d):
    cells = A.score_matrix(_cells(spark, d), ["encoder", "arm"])
    return J.top(cells.select("encoder", "arm", "contest", "frr"), [F.desc("contest"), F.asc("frr"), F.asc("encoder"), F.asc("arm")], 5)


@query(f"{T}, {_CELLS.replace('present, score FROM', 'present, uid, score FROM').replace('SELECT present, vec_id', 'SELECT present, uid, vec_id')} SELECT a.encoder AS a, b.encoder AS b, count(*) AS n, count_if(a.score > b.score) AS n_higher, round(corr(a.score, b.score), 6) AS r FROM cells a JOIN cells b USING (uid) WHERE a.encoder <> b.encoder GROUP BY ALL")
def encoder_pairs(spark, d):
    c = _cells(spark, d)
    a, b = c.select("uid", F.col("encoder").alias("a"), F.col("score").alias("x")), c.select("uid", F.col("encoder").alias("b"), F.col("score").alias("y"))
    got = a.join(b, "uid").where("a <> b")
    return got.groupBy("a", "b").agg(F.count("*").alias("n"), F.count_if(F.col("x") > F.col("y")).alias("n_higher"), F.round(F.corr("x", "y"), 6).alias("r"))


@query(f"{T} SELECT uid, round(s1 - s2, 6) AS delta, CASE WHEN s1 > -1 AND s1 >= s2 THEN 'spk1' WHEN s2 > -1 THEN 'spk2' ELSE 'mix' END AS route FROM trials")
def sep_route(spark, d):
    s1, s2 = F.col("s1"), F.col("s2")
    route = F.when((s1 > -1) & (s1 >= s2), "spk1").when(s2 > -1, "spk2").otherwise("mix")
    return D.trials(spark, d).select("uid", F.round(s1 - s2, 6).alias("delta"), route.alias("route"))


@query(f"{T} SELECT uid, CASE WHEN score >= s1 AND score >= s2 THEN 'score' WHEN s1 >= s2 THEN 's1' ELSE 's2' END AS arg, greatest(score, s1, s2) AS top FROM trials")
def map_argmax(spark, d):
    each = F.array(*[F.struct(F.col(c).alias("v"), F.lit(-i).alias("o"), F.lit(c).alias("k")) for i, c in enumerate(("score", "s1", "s2"))])
    return D.trials(spark, d).select("uid", F.array_max(each).alias("m")).select("uid", F.col("m.k").alias("arg"), F.col("m.v").alias("top"))


# ---- rule search ----
_GRID = "SELECT * FROM (VALUES (0.02::DOUBLE), (0.05), (0.1), (0.2)) g(gray) CROSS JOIN (VALUES (0.0::DOUBLE), (0.05), (0.12), (0.2)) m(margin) CROSS JOIN (VALUES (0), (100), (500)) l(len)"
_HIT = "reject OR (score - thr BETWEEN 0 AND gray AND s2 < score - margin AND tl >= len)"
_SEARCH = f"""{T}, {REC}, known AS (SELECT * FROM trials JOIN rec USING (vec_id)), rules AS ({_GRID}),
n AS (SELECT gray, margin, len, count_if(present) AS np, count_if(NOT present) AS nq, count_if(present AND ({_HIT})) AS fr, count_if(NOT present AND ({_HIT})) AS rj FROM known CROSS JOIN rules GROUP BY ALL),
grid AS (SELECT gray, margin, len, {RATES} FROM n),
b AS (SELECT {RATES} FROM (SELECT count_if(present) AS np, count_if(NOT present) AS nq, count_if(present AND reject) AS fr, count_if(NOT present AND reject) AS rj FROM known)),
viable AS (SELECT grid.*, round(grid.contest - b.contest, 9) AS gain, round(grid.frr - b.frr, 9) AS extra_frr FROM grid CROSS JOIN b WHERE round(grid.contest - b.contest, 9) >= 0.0 AND round(grid.frr - b.frr, 9) <= 0.05)"""


def _search(spark, d):
    t, rec = _known(spark, d)
    both = V.joined(t, rec, "vec_id").select("present", "reject", "score", "thr", "s2", "tl")
    grays, margins, lengths = (0.02, 0.05, 0.1, 0.2), (0.0, 0.05, 0.12, 0.2), (0, 100, 500)
    rules = spark.createDataFrame([(g, m, n) for g in grays for m in margins for n in lengths], "gray double, margin double, len int")
    axes = [*gray_axes(grays), veto_axis(margins), B.Axis("length", lengths, lambda c: F.col("tl") >= c)]
    hit = B.Box({**in_gray(), "margin": (F.col("margin"), None), "length": (F.col("len"), None)})
    grid = B.rule_metrics(both, axes, rules, ["gray", "margin", "len"], [B.Box(B.yes("below")), hit])
    base = B.rule_metrics(both, axes[:1], spark.createDataFrame([(0,)], "one int"), ["one"], [B.Box(B.yes("below"))])
    return A.viable(grid, base, 0.0, 0.05)


@query(f"{_SEARCH} SELECT * FROM viable")
def rule_search(spark, d):
    return _search(spark, d)


@query(f"{_SEARCH} SELECT * FROM viable ORDER BY contest DESC, frr, gray, margin, len LIMIT 1")
def rule_choice(spark, d):
    return A.choose(_search(spark, d), [F.asc("gray"), F.asc("margin"), F.asc("len")])


@query(f"{T}, {REC}, known AS (SELECT * FROM trials JOIN rec USING (vec_id)), r AS (SELECT delta, len, nontask, present, reject OR score < thr + delta OR (score - thr BETWEEN 0 AND 0.1 AND tl >= len AND (NOT nontask OR NOT digits)) AS x FROM known CROSS JOIN (VALUES (0.0::DOUBLE), (0.02)) a(delta) CROSS JOIN (VALUES (200), (800)) b(len) CROSS JOIN (VALUES (false), (true)) c(nontask)), n AS (SELECT delta, len, nontask, count_if(present) AS np, count_if(NOT present) AS nq, count_if(present AND x) AS fr, count_if(NOT present AND x) AS rj FROM r GROUP BY ALL) SELECT delta, len, nontask, {RATES} FROM n")
def stricter_overlay(spark, d):
    t, rec = _known(spark, d)
    deltas, lengths = (0.0, 0.02), (200, 800)
    rules = spark.createDataFrame([(a, b, c) for a in deltas for b in lengths for c in (False, True)], "delta double, len int, nontask boolean")
    shift = B.Axis("shift", deltas, lambda c: F.col("score") >= F.col("thr") + c)
    axes = [*gray_axes((0.1,)), shift, B.Axis("length", lengths, lambda c: F.col("tl") >= c), B.flag("digits", F.col("digits"))]
    # not below, nor by the shift, but long in the gray band; with nontask only without digits
    long = {**B.no("below"), **B.yes("up"), "gray": (None, F.lit(0.1)), "shift": (F.col("delta"), None), "length": (F.col("len"), None), "digits": (None, F.when(F.col("nontask"), 1))}
    boxes = [B.Box(B.yes("below")), B.Box({**B.no("below"), "shift": (None, F.col("delta"))}), B.Box(long)]
    return B.rule_metrics(V.joined(t, rec, "vec_id"), axes, rules, ["delta", "len", "nontask"], boxes)


# ---- calibration document ----
@query(f"""{T}, both_ AS (SELECT 'all' AS scope, * FROM trials UNION ALL SELECT lang AS scope, * FROM trials), support AS (SELECT scope, count_if(present) AS n_pos, count_if(NOT present) AS n_neg, round(avg(score) FILTER (present), 6) AS mean_present, round(avg(score) FILTER (NOT present), 6) AS mean_absent, min(score) AS least, max(score) AS most FROM both_ GROUP BY scope HAVING count_if(present) >= 5 AND count_if(NOT present) >= 3),
 {_curve_sql("scope", "both_")}, best AS (SELECT * FROM curve QUALIFY row_number() OVER (PARTITION BY scope ORDER BY contest DESC, thr DESC) = 1) SELECT * FROM support JOIN best USING (scope)""")
def calibration_document(spark, d):
    return A.calibration(D.trials(spark, d), lambda rows, keys: K.select_contest(K.curve(rows, keys), keys), 5, 3)


@query(f"{T}, {_curve_sql()} SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (ORDER BY thr) AS i FROM curve) WHERE i % 10 = 1")
def curve_every(spark, d):
    return A.every(K.curve(D.trials(spark, d)), "thr", 10)


@query(f"{T}, h AS (SELECT *, count(*) OVER (PARTITION BY present) AS n, row_number() OVER (PARTITION BY present ORDER BY md5(uid || '|42'), uid) AS k FROM trials) SELECT uid, k <= least(floor(n * 0.3::DOUBLE + 0.5::DOUBLE), greatest(0, n - CASE WHEN present THEN 10 ELSE 5 END)) AS held_out FROM h")
def holdout_floor(spark, d):
    return K.holdout(D.trials(spark, d), ["present"], 0.3, floors=(10, 5)).select("uid", "held_out")


over_whole_texts(arm_stats, neg_utterances, first_match, chars_per_second)
