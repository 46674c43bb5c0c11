"""Registered queries over joined tables: manifests, results, jobs, packing, holdouts, rule lists, streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatelight.functions import metrics as M
from gatelight.functions import text as X
from gatelight.functions import vector as V
from gatelight.operators import analysis as A
from gatelight.operators import calibrate as K
from gatelight.operators import manifest as N
from gatelight.operators import ranks as O
from gatelight.operators import relational as J
from gatelight.operators import rules as R
from gatelight.operators import scoring as S
from gatelight.operators import windows as W
from gatelight.plans import views as D
from gatelight.plans.more import REC, _known
from gatelight.plans.queries import COHORT, HELD, P, PIVOT, QUERIES, RATES, STREAMS, T, _curve_sql, _pivot, over_whole_texts, query


# ---- manifests ----
def _samples(spark, d):
    docs = D.read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    known = D.read(spark, d, "labels").select("doc_id", "toxic", F.lit(True).alias("hit"))
    side = F.when(F.col("toxic") == 1, "neg").otherwise("pos")
    return docs.join(known, "doc_id", "left").select(
        F.concat_ws("_", side, F.col("doc_id").cast("string")).alias("uid"), side.alias("split"), F.col("doc_id").alias("id"), F.concat(F.lit("enroll/"), F.col("doc_id").cast("string")).alias("enroll_wav"),
        F.coalesce("source", F.lit("")).alias("wake_text"), "lang", F.when(F.col("hit"), "index").otherwise("dataset").alias("enroll_source"),
        F.concat(F.lit("cmd/"), F.col("doc_id").cast("string")).alias("cmd_wav"), F.coalesce("text", F.lit("")).alias("cmd_text"), F.when(side == "pos", "present").otherwise("absent").alias("label"),
    )


_SAMPLES = """side AS (SELECT d.doc_id AS id, text, lang, source, l.doc_id IS NOT NULL AS hit, CASE WHEN toxic = 1 THEN 'neg' ELSE 'pos' END AS split FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(f"WITH {_SAMPLES} SELECT split || '_' || id AS uid, split, id, 'enroll/' || id AS enroll_path, coalesce(source, '') AS wake_text, lang, CASE WHEN hit THEN 'index' ELSE 'dataset' END AS enroll_source FROM side")
def enrol_manifest(spark, d):
    return N.projected(_samples(spark, d), N.ENROL_FIELDS)


@query(f"WITH {_SAMPLES} SELECT split || '_' || id AS uid, split, id, 'cmd/' || id AS cmd_path, coalesce(text, '') AS cmd_text, CASE WHEN split = 'pos' THEN 'present' ELSE 'absent' END AS label FROM side")
def command_manifest(spark, d):
    return N.projected(_samples(spark, d), N.COMMAND_FIELDS)


# ---- joins ----
@query("SELECT c_custkey, last.o_orderkey AS o_orderkey, coalesce(last.o_orderstatus, 'missing') AS status FROM customer LEFT JOIN (SELECT o_custkey, arg_max({'o_orderkey': o_orderkey, 'o_orderstatus': o_orderstatus}, o_orderkey) AS last FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey")
def samples_results(spark, d):
    results = D.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    both = N.with_results(D.read(spark, d, "customer").select("c_custkey"), results, "c_custkey", "o_orderkey")
    return both.select("c_custkey", "result.o_orderkey", F.coalesce("result.o_orderstatus", F.lit("missing")).alias("status"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' UNION SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def kept_uids(spark, d):
    o = D.read(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    back = D.read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return N.kept(o, "o_orderkey", back, o.where("o_orderpriority = '1-URGENT'")).select("o_orderkey", "o_totalprice")


@query(f"{T} SELECT uid, label, a.score AS first, b.s2 AS second FROM trials a JOIN (SELECT uid, s2 FROM trials) b USING (uid)")
def cell_join(spark, d):
    t = D.trials(spark, d)
    return N.same_label(t.select("uid", "label", F.col("score").alias("first")), t.select("uid", "label", F.col("s2").alias("second")), "uid", "label")


@query("SELECT l.doc_id, toxic, coalesce(nullif(d.lang, ''), 'zh') AS lang FROM labels l LEFT JOIN documents d USING (doc_id)")
def lang_map(spark, d):
    samples = D.read(spark, d, "documents").select("doc_id", "lang", F.col("doc_id").alias("ordinal"))
    return N.lang_of(D.read(spark, d, "labels").select("doc_id", "toxic"), samples, "doc_id")


_ARMS = {"F": ["1-URGENT", "2-HIGH"], "O": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "P": ["5-LOW"]}


@query(f"""WITH arms(arm, stream) AS (VALUES {', '.join(f"('{a}', '{s}')" for a, ss in _ARMS.items() for s in ss)}), jobs AS (SELECT c_custkey, arm, stream FROM customer CROSS JOIN arms)
 SELECT arm, count(*) AS jobs, count(DISTINCT j.c_custkey) AS utterances, count_if(o.o_custkey IS NULL) AS missing FROM jobs j LEFT JOIN (SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders) o ON o.o_custkey = j.c_custkey AND o_orderstatus = arm AND o_orderpriority = stream GROUP BY arm""")
def stream_jobs(spark, d):
    listing = D.read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("arm"), F.col("o_orderpriority").alias("stream"))
    jobs = N.stream_jobs(D.read(spark, d, "customer").select("c_custkey"), _ARMS, listing, "c_custkey")
    each = jobs.groupBy("arm", "c_custkey").agg(F.count("*").alias("n"), F.count_if(~F.col("found")).alias("m"))
    return each.groupBy("arm").agg(F.sum("n").alias("jobs"), F.count("*").alias("utterances"), F.sum("m").alias("missing"))


# ---- filters and packing ----
_NAME = "['mix', 'd1_spk1', 'd1_spk2'][(vec_id % 3 + 1)::INT]"


def _named(spark, d):
    name = F.element_at(F.array(F.lit("mix"), F.lit("d1_spk1"), F.lit("d1_spk2")), (F.col("vec_id") % 3 + 1).cast("int"))
    return D.read(spark, d, "embeddings").select("vec_id", F.expr("vec_id div 3").alias("uid"), name.alias("stream"), V.doubles(F.col("embedding")).alias("emb"))


@query(f"SELECT vec_id, {_NAME} AS stream FROM embeddings WHERE vec_id % 3 = 0 OR sqrt(list_inner_product(embedding[1:32]::DOUBLE[], embedding[1:32]::DOUBLE[]) / 32 + 1e-12) >= 0.125::DOUBLE")
def loud_streams(spark, d):
    s = _named(spark, d).withColumn("half", F.slice("emb", 1, 32))
    return N.loud_streams(s, "half", 0.125).select("vec_id", "stream")


_DECIDED = "rows AS (SELECT uid, split, lang, score, s2, thr, cer, CASE WHEN reject THEN 'reject_presence' ELSE 'accept' END AS decision, CASE WHEN reject THEN CASE WHEN present THEN 'low_score' ELSE 'speaker_absent' END END AS reason FROM trials)"


def _decided(spark, d):
    t, no = D.trials(spark, d), F.col("reject")
    return t.select("uid", "split", "lang", "score", "s2", "thr", "cer", F.when(no, "reject_presence").otherwise("accept").alias("decision"), F.when(no, F.when(F.col("present"), "low_score").otherwise("speaker_absent")).alias("reason"))


@query(f"{T}, {_DECIDED} SELECT uid, score FROM rows WHERE split = 'neg' AND decision = 'accept'")
def accepted_negatives(spark, d):
    return N.accepted_negatives(_decided(spark, d)).select("uid", "score")


@query(f"{T}, {_DECIDED} SELECT uid, reason FROM rows WHERE starts_with(decision, 'reject') AND reason <> 'speaker_absent' ORDER BY uid LIMIT 50")
def other_reasons(spark, d):
    return N.other_reasons(_decided(spark, d)).select("uid", "reason")


@query(f"{T}, {_DECIDED} SELECT uid, split, lang, CASE WHEN split = 'pos' AND decision <> 'accept' THEN 1.0::DOUBLE ELSE cer END AS cer, coalesce(nullif(score, 0), nullif(s2, 0), 0.0) AS score, thr, thr AS file_thr, '' AS hyp, CASE WHEN reason IS NULL THEN uid ELSE reason END AS label, decision <> 'accept' AS file_rej, coalesce(nullif(score, 0), nullif(s2, 0), 0.0) < thr AS base_rej, decision = 'accept' AS orig_accept FROM rows")
def packed_records(spark, d):
    return N.packed(_decided(spark, d).withColumnsRenamed({"score": "presence_score", "s2": "second_score", "reason": "cmd_text"}).withColumn("label", F.col("uid")))


# ---- recognition ----
def _feats(spark, d, pairs=D.pairs):
    p = pairs(spark, d).withColumn("wake", F.min("ref").over(Window.partitionBy("conv_id")))  # a conversation is one bounded group
    return p.select("conv_id", "turn", "cer", *[c.alias(n) for n, c in N.features(F.col("wake"), F.col("ref"), F.col("hyp")).items()])


def _lang_sql(t):
    c, n = f"regexp_matches({t}, '{X.CJK}')", f"regexp_matches({t}, '[A-Za-z]')"
    return f"CASE WHEN length({t}) = 0 THEN 'empty' WHEN NOT {c} AND NOT {n} THEN 'other' WHEN {c} AND {n} THEN 'mix' WHEN {c} THEN 'zh' ELSE 'en' END"


_has = lambda t, words: f"regexp_matches({t}, '{X.any_of(words)}')"
_FEATS = f"""{P}, w AS (SELECT *, min(ref) OVER (PARTITION BY conv_id) AS wake FROM pairs),
f0 AS (SELECT conv_id, turn, cer, hyp = '' AS "empty", length(hyp)::INT AS hyp_len, {_lang_sql('hyp')} AS hyp_lang, {_lang_sql('wake')} AS wake_lang, CASE WHEN ref = '' THEN 'na' ELSE {_lang_sql('ref')} END AS cmd_lang,
 length(hyp) >= 2 AND {_has('hyp', X.DEVICES + X.ACTS + X.SLOTS)} AS looks_command, {_has('hyp', X.DEVICES)} AS has_device, {_has('hyp', X.ACTS)} AS has_act, {_has('hyp', X.SLOTS)} AS has_slot, regexp_matches(hyp, '{X.DIGITS}') AS has_digit,
 wake <> '' AND hyp <> '' AND (contains(hyp, wake) OR contains(wake, hyp)) AS wake_in_hyp, wake <> '' AND hyp <> '' AND (hyp = wake OR replace(hyp, wake, '') = '' OR (contains(hyp, wake) AND length(hyp) <= length(wake) + 2)) AS wake_only FROM w),
f AS (SELECT *, cmd_lang IN ('zh', 'en') AND wake_lang IN ('zh', 'en') AND cmd_lang <> wake_lang AS wake_cmd_lang_mismatch, hyp_lang IN ('zh', 'en') AND wake_lang IN ('zh', 'en') AND hyp_lang <> wake_lang AS wake_hyp_lang_mismatch,
 cmd_lang IN ('zh', 'en') AND hyp_lang IN ('zh', 'en') AND cmd_lang <> hyp_lang AS cmd_hyp_lang_mismatch, hyp_lang = 'mix' AS code_switch_hyp FROM f0)"""


@query(f"{_FEATS} SELECT * EXCLUDE (cer) FROM f")
def text_features(spark, d, pairs=D.pairs):
    return _feats(spark, d, pairs).drop("cer")


_TESTS = {
    "all": "true", "wake_cmd_match": "NOT wake_cmd_lang_mismatch", "wake_cmd_mismatch": "wake_cmd_lang_mismatch", "hyp_cmd_lang_mismatch": "cmd_hyp_lang_mismatch", "hyp_has_wake": "wake_in_hyp", "code_switch_hyp": "code_switch_hyp",
    "cmd_zh": "cmd_lang = 'zh'", "cmd_en": "cmd_lang = 'en'", "wake_zh": "wake_lang = 'zh'", "wake_en": "wake_lang = 'en'", "len_le4": "hyp_len <= 4", "len_5_12": "hyp_len BETWEEN 5 AND 12", "len_ge13": "hyp_len >= 13",
    "looks_command": "looks_command", "not_command": "NOT looks_command",
}


@query(f"""{_FEATS}, b AS (SELECT cer, unnest([{', '.join(f"{{'bucket': '{k}', 'x': {x}}}" for k, x in _TESTS.items())}]) AS u FROM f)
 SELECT u.bucket AS bucket, count(*) AS n, round(avg(cer), 6) AS mean, list_sort(list(cer))[round_even(0.5 * (count(*) - 1), 0)::INT + 1] AS p50 FROM b WHERE u.x GROUP BY 1""")
def cer_by_feature(spark, d, pairs=D.pairs):
    names = F.array(*[F.when(c, F.lit(k)) for k, c in N.feature_buckets().items()])
    b = _feats(spark, d, pairs).select("cer", F.explode(F.array_compact(names)).alias("bucket"))
    return b.groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("cer"), 6).alias("mean")).join(O.order_statistics(b, ["bucket"], "cer", {"p50": O.nearest_at(0.5)}), "bucket")


@query(f"{P}, {PIVOT} SELECT conv_id, round(mix - best, 6) AS gain FROM u WHERE mix IS NOT NULL ORDER BY gain, conv_id LIMIT 15")
def top_hurts(spark, d, pairs=D.pairs):
    return J.top(_pivot(spark, d, pairs).where("mix is not null").select("conv_id", F.round(F.col("mix") - F.col("best"), 6).alias("gain")), [F.asc("gain"), F.asc("conv_id")], 15)


@query()
def substitution_counts(spark, d, pairs=D.whole_pairs):
    """The twenty most frequent replaced characters of aligned texts; equally frequent ones by character."""
    each = pairs(spark, d).where("ref <> hyp").select(F.explode(X.replaced("ref", "hyp")).alias("s")).select("s.*")
    return J.top(each.groupBy("ref", "hyp").agg(F.sum("n").alias("n")), [F.desc("n"), F.asc("ref"), F.asc("hyp")], 20)


@query(f"{P}, k AS (SELECT p.*, arg_max(d.lang, p.turn) FILTER (d.lang IS NOT NULL) OVER (PARTITION BY conv_id) AS lang FROM pairs p LEFT JOIN documents d ON d.doc_id = p.conv_id) SELECT lang, count(*) AS n, count(DISTINCT conv_id) AS utterances, round(avg(cer), 6) AS mean, round(avg(cer) FILTER (arm = 'no_sep'), 6) AS mean_mix, count_if(cer = 0) AS n_exact FROM k GROUP BY lang")
def lang_block(spark, d, pairs=D.pairs):
    langs = D.read(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), "lang")
    rows = pairs(spark, d).join(langs, "conv_id", "left")
    u = rows.groupBy("conv_id").agg(F.max_by("lang", F.when(F.col("lang").isNotNull(), F.col("turn"))).alias("lang"), F.count("*").alias("n"), F.sum("cer").alias("c"), F.sum(F.when(F.col("arm") == "no_sep", F.col("cer"))).alias("mc"), F.count_if(F.col("arm") == "no_sep").alias("mn"), F.count_if(F.col("cer") == 0).alias("x"))
    return u.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("utterances"), F.round(F.sum("c") / F.sum("n"), 6).alias("mean"), F.round(F.try_divide(F.sum("mc"), F.sum("mn")), 6).alias("mean_mix"), F.sum("x").alias("n_exact"))


@query(f"{T} SELECT split, count(*) AS n, count_if(present AND reject) AS n_false_reject, count_if(NOT present AND NOT reject) AS n_false_accept, round(coalesce(count_if(present = reject)::DOUBLE / nullif(count(*), 0), 0), 4) AS rate FROM trials GROUP BY split")
def failure_counts(spark, d):
    p, no = F.col("present"), F.col("reject")
    return D.trials(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.count_if(p & no).alias("n_false_reject"), F.count_if(~p & ~no).alias("n_false_accept"), F.round(M.rate(F.count_if(p == no), F.count("*"), 0.0), 4).alias("rate"))


# ---- holdout and rule lists ----
@query(f"""{T}, {HELD}, calib AS (SELECT lang, present, score FROM held WHERE NOT held_out), {_curve_sql('lang', 'calib')}, best AS (SELECT lang, thr FROM curve QUALIFY row_number() OVER (PARTITION BY lang ORDER BY contest DESC, thr DESC) = 1),
n AS (SELECT lang, best.thr AS thr, count_if(present) AS np, count_if(NOT present) AS nq, count_if(present AND score < best.thr) AS fr, count_if(NOT present AND score < best.thr) AS rj FROM held JOIN best USING (lang) WHERE held_out GROUP BY ALL)
 SELECT lang, thr, np AS n_present, nq AS n_absent, {RATES} FROM n""")
def holdout_by_lang(spark, d):
    return K.holdout_by(K.holdout(D.trials(spark, d), ["split", "lang"], 0.3), ["lang"])


#: Overlay rules by name: a gray band's width (null: any score) and the text condition under which a row is rejected too.
_TEXTS = {"len>=900": "tl >= 900", "len>=400": "tl >= 400", "web": "coalesce(source = 'web', false)", "nodigit": "NOT digits", "digit": "digits"}
_RULES = {
    "score_only": (None, "false"), **{f"gray{g}_{k}": (g, x) for g in (0.02, 0.05, 0.1) for k, x in _TEXTS.items()},
    "hard_web": (None, "coalesce(source = 'web', false)"), "hard_len>=2000": (None, "tl >= 2000"), "hard_len>=1200": (None, "tl >= 1200"),
}


_H = "held AS (SELECT *, row_number() OVER (PARTITION BY present, lang ORDER BY md5(uid || '|42'), uid) <= floor(count(*) OVER (PARTITION BY present, lang) * 0.3::DOUBLE + 0.5::DOUBLE) AS held_out FROM trials JOIN rec USING (vec_id))"


def _rule_text(width, text):
    return f"reject OR ({text})" if width is None else f"reject OR (abs(score - thr) <= {width}::DOUBLE AND {text})"


@query(f"""{T}, {REC}, {_H}, r AS (SELECT held_out, present, unnest([{", ".join(f"{{'name': '{k}', 'x': {_rule_text(*r)}}}" for k, r in _RULES.items())}]) AS u FROM held),
n AS (SELECT u.name AS name, held_out, count_if(present) AS np, count_if(NOT present) AS nq, count_if(present AND u.x) AS fr, count_if(NOT present AND u.x) AS rj FROM r GROUP BY 1, 2) SELECT name, held_out, {RATES} FROM n""")
def rule_list(spark, d):
    t, rec = _known(spark, d)
    rows = K.holdout(t.join(rec, "vec_id"), ["present", "lang"], 0.3)
    in_band = lambda g: F.lit(True) if g is None else R.gray_band(F.col("score"), F.col("thr"), g)
    return K.rule_list(rows, {k: F.col("reject") | (in_band(g) & F.expr(x)) for k, (g, x) in _RULES.items()}, ["held_out"])


# ---- streams ----
@query(f"""WITH {STREAMS}, {COHORT}, b AS (SELECT uid, max(score) AS score, arg_max(stream, score) AS best_stream FROM c GROUP BY uid), s2 AS (SELECT vec_id, vec_id // 3 AS uid, {_NAME} AS stream FROM embeddings)
 SELECT b.uid, best_stream, round((score - mu) / sigma, 6) AS z FROM b JOIN s2 ON s2.uid = b.uid AND s2.stream = best_stream JOIN st ON st.id = s2.vec_id""")
def znorm_winner(spark, d):
    s = _named(spark, d)
    best = S.presence(s.where("stream = 'mix'").select("uid", "emb"), s.where("stream <> 'mix'").select("uid", "stream", "emb"))
    st = S.cohort_stats(s.select(F.col("vec_id").alias("id"), "emb"), s.where("vec_id % 10 = 9").select("emb"))
    won = best.join(s.select("vec_id", "uid", F.col("stream").alias("best_stream")), ["uid", "best_stream"]).join(st.withColumnRenamed("id", "vec_id"), "vec_id")
    return won.select("uid", "best_stream", F.round(S.z_norm(F.round("score", 9), F.col("mu"), F.col("sigma")), 6).alias("z"))


_SIGN = "list_transform(embedding[1:4], lambda x: CASE WHEN x < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"


@query(f"""WITH s AS (SELECT vec_id // 3 AS uid, {_NAME} AS stream, {_SIGN} AS v FROM embeddings), e AS (SELECT uid - 1 AS uid, v FROM s WHERE stream = 'mix'),
c AS (SELECT s.uid, stream, list_inner_product(e.v, s.v) AS dot FROM s JOIN e ON e.uid = s.uid) SELECT uid, arg_min(stream, (-dot, stream <> 'mix', stream)) AS best_stream, max(dot)::INT AS matches FROM c GROUP BY uid""")
def presence_ties(spark, d):
    """Vectors of four signs, so that streams often tie: the mix wins, then the least name."""
    s = _named(spark, d).withColumn("emb", F.transform(F.slice("emb", 1, 4), lambda x: F.when(x < 0, -1.0).otherwise(1.0)))
    enrol = s.where("stream = 'mix'").select((F.col("uid") - 1).alias("uid"), "emb")
    return S.presence(enrol, s.select("uid", "stream", "emb")).select("uid", "best_stream", F.round(F.col("score") * 4).cast("int").alias("matches"))


_WINDOWS = """first AS (SELECT label, arg_min(embedding::DOUBLE[], vec_id) AS e, min(vec_id) AS enroll_id FROM embeddings GROUP BY label),
w AS (SELECT vec_id, i AS start, e[i + 1:i + 16] AS a, embedding[i + 1:i + 16]::DOUBLE[] AS b FROM (SELECT *, unnest(range(0, 49, 8)) AS i FROM embeddings JOIN first USING (label) WHERE vec_id <> enroll_id)),
ws AS (SELECT vec_id, start, round(list_inner_product(a, b) / ((sqrt(list_inner_product(a, a)) + 1e-8) * (sqrt(list_inner_product(b, b)) + 1e-8)), 6) AS score FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, start) AS k FROM ws), two AS (SELECT vec_id, max(score) FILTER (k = 1) AS best, max(start) FILTER (k = 1) AS best_at, max(score) FILTER (k = 2) AS second, max(start) FILTER (k = 2) AS second_at FROM k GROUP BY vec_id)"""


def _windows(spark, d):
    e = D.read(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    first = D.small(e.groupBy("label").agg(F.min_by("v", "vec_id").alias("e"), F.min("vec_id").alias("enroll_id")))
    spans = F.explode(W.sliding(F.size("v"), 16, 8, 8)).alias("w")
    cut = lambda c: F.slice(F.col(c), F.col("w.start").cast("int") + 1, (F.col("w.end") - F.col("w.start")).cast("int"))
    each = e.join(first, "label").where("vec_id <> enroll_id").select("vec_id", "e", "v", spans)
    each = each.select("vec_id", F.col("w.start").cast("long").alias("start"), F.round(V.cosine(cut("e"), cut("v")), 6).alias("score"))
    return A.best_two(each, ["vec_id"], "score", "start")


@query(f"WITH {_WINDOWS} SELECT * FROM two")
def window_scores(spark, d):
    return _windows(spark, d)


@query(f"WITH {_WINDOWS} SELECT vec_id, coalesce(best - 0.3::DOUBLE BETWEEN 0 AND 0.5 AND second < best - 0.12::DOUBLE, false) AS veto FROM two")
def window_veto(spark, d):
    return _windows(spark, d).select("vec_id", R.veto(F.col("best"), F.col("second"), F.lit(0.3), 0.5).alias("veto"))


_DEPTHS = "depths AS (SELECT present, unnest([{'depth': 0, 'score': s1}, {'depth': 1, 'score': greatest(s1, s2)}, {'depth': 2, 'score': greatest(s1, s2, score)}], recursive := true) FROM trials)"


@query(f"{T}, {_DEPTHS}, {_curve_sql('depth', 'depths')} SELECT * FROM curve QUALIFY row_number() OVER (PARTITION BY depth ORDER BY contest DESC, thr DESC) = 1")
def depth_compare(spark, d):
    best = [F.col("s1"), F.greatest("s1", "s2"), F.greatest("s1", "s2", "score")]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("depth"), c.alias("score")) for i, c in enumerate(best)]))
    return A.score_matrix(D.trials(spark, d).select("present", each.alias("e")).select("present", "e.*"), ["depth"])


over_whole_texts(text_features, cer_by_feature, top_hurts, lang_block)
