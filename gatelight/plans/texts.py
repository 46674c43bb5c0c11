"""Registered queries that run the text and rule builders over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gatelight.functions import text as X
from gatelight.functions import vector as V
from gatelight.operators import calibrate as K
from gatelight.operators import relational as J
from gatelight.operators import rules as R
from gatelight.plans import views as D
from gatelight.plans.batch import _H, _has, _lang_sql
from gatelight.plans.more import REC, _known
from gatelight.plans.queries import _NV, FIXTURE_SQL, P, RATES, T, fixture, over_whole_texts, query

#: Normalised texts of all documents in the place of the sentences of `views.SAYINGS`.
SAID = r"""said AS (SELECT doc_id AS k, lower(regexp_replace(regexp_replace(coalesce(text, ''), '[\s\x0B\x85\xA0]', '', 'g'),
 '[-，。！？、；："''「」『』（）【】《》…·—–.,!?;:`]', '', 'g')) AS t FROM documents)"""
_over_documents = lambda name: FIXTURE_SQL[name].replace(D.SAYINGS_SQL, SAID)


def _said(spark, d):
    return X.normalize(D.read(spark, d, "documents").select(F.col("doc_id").alias("k"), "text"), "text", "t", X.LING_PUNCT).select("k", "t")


def _marked(spark, d):
    """(k, m, n): what the patterns of classes, tags and genres can fit of every document, and the length of its text."""
    return _said(spark, d).select("k", X.marks(F.col("t")).alias("m"), F.length("t").alias("n"))


# ---- documents ----
@query(_over_documents("text_class"))
def document_classes(spark, d):
    return _marked(spark, d).select("k", X.classify(F.col("m"), F.col("n")).alias("c")).select("k", "c.primary", "c.len")


_FRAME = "(v >= 1 OR st OR mo)"
_ELLIPTIC = f"\"primary\" = '省略指令'"
_CLASS_TAGS = [
    ("设备播报", "tts"), ("信息询问", f"q OR (ends_with(t, '吗') AND NOT {_FRAME})"), ("复合命令", "v >= 2 OR (ln AND v + st::INT + mo::INT >= 2)"), ("状态调节", "st"), ("动作命令", "v >= 1"),
    ("模式/场景", "mo"), ("生活陈述/社交", "li"), ("带语气词", "pa"), ("带话语标记", "di"), ("省略指令", _ELLIPTIC),
]


def _frames_sql() -> str:
    """`document_classes` with all that a class is made from."""
    base = _over_documents("text_class")
    at = base.index(" SELECT k, CASE WHEN tts")
    flags = base[:at].replace(" AS ln FROM said)", f" AS ln, {_has('t', X.PARTICLES)} AS pa FROM said)")
    named = base[at:].replace(" SELECT k, CASE", ", c AS (SELECT *, CASE").replace(", n::INT AS len FROM f", " FROM f)")
    tags = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in _CLASS_TAGS)
    return f"""{flags}{named}
SELECT k, "primary", n::INT AS len, v::INT AS n_verb, array_to_string([x FOR x IN [{tags}] IF x IS NOT NULL], '+') AS tags, pa AS has_particle, {_FRAME} AS command_frame,
  "primary" IN ({', '.join(f'{c!r}' for c in X.TASK_CLASSES)}) AS task_oriented FROM c"""


@query(_frames_sql())
def document_frames(spark, d):
    """Class, tags, verbs, particles, command frame and task of every document."""
    c = _marked(spark, d).select("k", X.classify(F.col("m"), F.col("n")).alias("c")).select("k", "c.*")
    return c.withColumn("tags", F.array_join("tags", "+"))


@query(_over_documents("genre"))
def document_genres(spark, d):
    return _marked(spark, d).select("k", X.genre(F.col("m"), F.col("n")).alias("genre"))


@query(_over_documents("text_languages"))
def document_languages(spark, d):
    t = F.col("t")
    return _said(spark, d).select("k", X.text_lang(t).alias("text_lang"), X.manifest_lang(t).alias("manifest_lang"), X.threshold_lang(F.lit(None).cast("string"), t).alias("threshold_lang"), X.recognizer_lang(t).alias("recognizer_lang"))


_STATE = f"({_has('t', X.STATE_MARKS)} OR (regexp_matches(t, '{X.DIGITS}') AND {_has('t', X.V1_UNITS)}))"
_TAGS = [
    ("动作命令", _has("t", X.ACT_VERBS)), ("状态调节", _STATE), ("模式/场景", _has("t", ["模式", "场景"])), ("信息询问", _has("t", X.V1_QUESTIONS)), ("生活陈述/社交", f"regexp_matches(t, '{X.LIFE}')"),
    ("复合命令", f"({_NV} >= 2 OR ({_has('t', X.LINKS)} AND {_NV} >= 1))"), ("闲聊/背景", _has("t", X.DISCOURSE + X.PARTICLES)),
]
_CORE = "['动作命令', '状态调节', '模式/场景', '复合命令']"


def _tag_sql(said: str) -> str:
    each = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _TAGS)
    return f"WITH {said}, g AS (SELECT k, list_filter([{each}], lambda x: x IS NOT NULL) AS tags FROM said) SELECT k, array_to_string(tags, '+') AS tags, list_has_any(tags, {_CORE}) AND NOT list_contains(tags, '闲聊/背景') AS is_command, len(list_intersect(tags, {_CORE}))::INT AS n_core, len(list_filter(tags, lambda x: NOT list_contains({_CORE}, x)))::INT AS n_other FROM g"


def _tagged(said):
    core = F.array(*[F.lit(x) for x in ("动作命令", "状态调节", "模式/场景", "复合命令")])
    g = said.select("k", X.v1_tags(F.col("m"), F.col("n")).alias("g"))
    return g.select("k", F.array_join("g", "+").alias("tags"), X.v1_is_command(F.col("g")).alias("is_command"), F.size(F.array_intersect("g", core)).alias("n_core"), F.size(F.array_except("g", core)).alias("n_other"))


@query(_tag_sql(SAID))
def document_tags(spark, d):
    return _tagged(_marked(spark, d))


@fixture(_tag_sql(D.SAYINGS_SQL))
def text_tags(spark, d):
    return _tagged(D.sayings(spark).select("k", X.marks(F.col("t")).alias("m"), F.length("t").alias("n")))


VOCABULARY = list(dict.fromkeys(X.DEVICES + X.ACTS + X.SLOTS))


@query(f"WITH {SAID}, v(term) AS (VALUES {', '.join(f'({t!r})' for t in VOCABULARY)}) SELECT term, count_if(contains(t, term)) AS n FROM said CROSS JOIN v GROUP BY term")
def vocabulary_counts(spark, d):
    """Documents that hold each term of the vocabulary: all terms, overlapping ones too, in one pass that doesn't multiply rows."""
    hits = [F.struct(F.lit(t).alias("term"), F.count_if(F.contains("t", F.lit(t))).alias("n")) for t in VOCABULARY]
    return _said(spark, d).agg(F.array(*hits).alias("h")).select(F.explode("h").alias("h")).select("h.*")


# ---- pairs ----
_W = f"{P}, w AS (SELECT *, min(ref) OVER (PARTITION BY conv_id) AS wake, length(ref) / 12.0::DOUBLE AS sec FROM pairs)"
_IN = "(wake <> '' AND hyp <> '' AND (contains(hyp, wake) OR contains(wake, hyp)))"
_COMMAND = lambda t: f"(length({t}) >= 2 AND {_has(t, X.DEVICES + X.ACTS + X.SLOTS)})"


def _waked(spark, d, pairs):
    return pairs(spark, d).withColumn("wake", F.min("ref").over(Window.partitionBy("conv_id"))).withColumn("sec", F.length("ref") / 12.0)  # a conversation is one bounded group


@query(f"""{_W} SELECT conv_id, turn, CASE WHEN length(ref) <= 2 THEN ref || 'Q' ELSE ref[1] || 'X' || substr(ref, 3, length(ref) - 3) || 'Q' END AS fake, coalesce({_IN} OR (wake <> '' AND hyp <> '' AND least(1.0, round(levenshtein(wake, hyp)::DOUBLE / nullif(length(wake), 0), 6)) <= 0.3), false) AS wake_overlap,
 CASE WHEN sec <= 0 THEN length(hyp) <= 1 ELSE (sec >= 2.5 AND length(hyp) <= 2) OR (sec >= 3.5 AND length(hyp) < 6 AND length(hyp) / sec < 0.8) OR (length(hyp) >= 22 AND sec < 1.2) END AS mismatch,
 CASE WHEN cer > 0 THEN CASE WHEN hyp = '' THEN 'empty_hyp' WHEN {_lang_sql('ref')} IN ('zh', 'en') AND {_lang_sql('hyp')} IN ('zh', 'en') AND {_lang_sql('ref')} <> {_lang_sql('hyp')} THEN 'lang_wrong' WHEN {_IN} THEN 'wake_inserted' WHEN {_lang_sql('hyp')} = 'mix' THEN 'code_switch'
 WHEN {_COMMAND('hyp')} AND {_COMMAND('ref')} AND regexp_matches(ref, '{X.DIGITS}') AND ref <> hyp THEN 'slot_or_paraphrase' WHEN {_COMMAND('hyp')} AND {_COMMAND('ref')} THEN 'paraphrase_or_sub' ELSE 'unrelated_hyp' END END AS kind FROM w""")
def pair_rules(spark, d, pairs=D.pairs):
    ref, hyp, wake = F.col("ref"), F.col("hyp"), F.col("wake")
    return _waked(spark, d, pairs).select(
        "conv_id", "turn", X.fake_hypothesis(ref, "perturb").alias("fake"), F.coalesce(X.wake_overlap(wake, hyp), F.lit(False)).alias("wake_overlap"),
        X.duration_mismatch(hyp, F.col("sec")).alias("mismatch"), X.error_type(ref, hyp, wake, F.col("cer")).alias("kind"),
    )


# ---- vectors, labels, thresholds ----
@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / len(embedding) + 1e-12), 6) AS rms, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / pow(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8, 2), 6) AS unit_square FROM embeddings")
def vector_norms(spark, d):
    v = D.read(spark, d, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"))
    return v.withColumn("u", V.unit(F.col("v"))).select("vec_id", F.round(V.rms(F.col("v")), 6).alias("rms"), F.round(V.dot(F.col("u"), F.col("u")), 6).alias("unit_square"))


@query(f"{T} SELECT uid, label, CASE WHEN lang = 'zh' THEN 0.2::DOUBLE ELSE 0.31::DOUBLE END AS thr FROM trials")
def labels_thresholds(spark, d):
    t = D.trials(spark, d)
    said = F.when(F.col("lang") == "zh", F.concat(F.lit(" "), F.upper("label"))).when(F.col("present"), "1")
    by_lang = F.create_map(F.lit("zh"), F.lit(0.2), F.lit("default"), F.lit(0.31))
    return t.select("uid", J.label_of(said, F.col("split")).alias("label"), R.threshold_from_map(by_lang, F.col("lang"), F.lit(0.5)).alias("thr"))


_GRAY, _TASK = "abs(score - thr) <= 0.05::DOUBLE", "digits"
_RESCUE, _EXTRA = f"reject AND {_GRAY} AND {_TASK} AND tl < 500", f"NOT reject AND {_GRAY} AND (tl >= 500 OR NOT {_TASK})"
_TWO = {"none": "reject", "rescue": f"reject AND NOT ({_RESCUE})", "extra": f"reject OR ({_EXTRA})", "both": f"(reject AND NOT ({_RESCUE})) OR ({_EXTRA})"}


@query(f"""{T}, {REC}, {_H}, r AS (SELECT lang, present, unnest([{", ".join(f"{{'name': '{k}', 'x': {x}}}" for k, x in _TWO.items())}]) AS u FROM held),
n AS (SELECT u.name AS name, lang, count_if(present) AS np, count_if(NOT present) AS nq, count_if(present AND u.x) AS fr, count_if(NOT present AND u.x) AS rj FROM r GROUP BY 1, 2) SELECT name, lang, {RATES} FROM n""")
def two_way_fusion(spark, d):
    t, rec = _known(spark, d)
    gray = R.gray_band(F.col("score"), F.col("thr"), 0.05)
    how = {"none": (False, False), "rescue": (True, False), "extra": (False, True), "both": (True, True)}
    return K.rule_list(t.join(rec, "vec_id"), {k: R.two_way(F.col("reject"), gray, F.col("digits"), F.col("tl"), *x, 500) for k, x in how.items()}, ["lang"])


over_whole_texts(pair_rules)
