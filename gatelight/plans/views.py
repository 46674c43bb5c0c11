"""Views over the driver's tables that the registered queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelight.functions import text as X
from gatelight.functions import vector as V
from gatelight.operators import rules as R

#: Enrolments are one for each label; more than this aren't broadcast.
MAX_ENROL = 10_000


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def small(df: DataFrame, most: int = MAX_ENROL) -> DataFrame:
    """`df` marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def trials(spark: SparkSession, d: str) -> DataFrame:
    """Every vector against the first vector of every label."""
    e = read(spark, d, "embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))
    enrol = e.groupBy(F.col("label").alias("spk")).agg(F.min_by("v", "vec_id").alias("e"), F.min("vec_id").alias("enroll_id"))
    half = lambda c, i: F.slice(F.col(c), i, 32)
    both = e.crossJoin(small(enrol)).where("vec_id <> enroll_id")
    present = F.col("label") == F.col("spk")
    out = both.select(
        F.concat_ws("_", "spk", "vec_id").alias("uid"), "vec_id", "spk", present.alias("present"), F.when(present, "present").otherwise("absent").alias("label"),
        F.when(present, "pos").otherwise("neg").alias("split"), F.when(F.col("vec_id") % 2 == 0, "zh").otherwise("en").alias("lang"),
        F.round(V.dot(F.col("e"), F.col("v")), 6).alias("score"), F.round(V.dot(half("e", 1), half("v", 1)), 6).alias("s1"), F.round(V.dot(half("e", 33), half("v", 33)), 6).alias("s2"),
    )
    cer = F.when(F.col("vec_id") % 7 != 0, F.least(F.lit(1.0), F.abs(F.col("s2")) * 4))
    return out.withColumn("cer", F.round(cer, 6)).withColumn("thr", R.frozen_threshold(F.col("lang")) - 0.25).withColumn("reject", F.col("score") < F.col("thr"))


TRIALS = """enrol AS (SELECT label AS spk, arg_min(embedding::DOUBLE[], vec_id) AS e, min(vec_id) AS enroll_id FROM embeddings GROUP BY label),
scored AS (SELECT spk || '_' || vec_id AS uid, vec_id, spk, label = spk AS present, CASE WHEN label = spk THEN 'present' ELSE 'absent' END AS label,
  CASE WHEN label = spk THEN 'pos' ELSE 'neg' END AS split, CASE WHEN vec_id % 2 = 0 THEN 'zh' ELSE 'en' END AS lang,
  round(list_inner_product(e, embedding::DOUBLE[]), 6) AS score, round(list_inner_product(e[1:32], embedding[1:32]::DOUBLE[]), 6) AS s1,
  round(list_inner_product(e[33:64], embedding[33:64]::DOUBLE[]), 6) AS s2 FROM embeddings CROSS JOIN enrol WHERE vec_id <> enroll_id),
thrs AS (SELECT *, round(CASE WHEN vec_id % 7 <> 0 THEN least(1.0::DOUBLE, abs(s2) * 4) END, 6) AS cer, CASE WHEN lang = 'zh' THEN 0.29305::DOUBLE ELSE 0.357868::DOUBLE END - 0.25::DOUBLE AS thr FROM scored),
trials AS (SELECT *, score < thr AS reject FROM thrs)"""


def _turns(turns: DataFrame) -> DataFrame:
    """User turns (conv_id, turn, role, text) with the next turn's text as `next`, where there is one."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select("conv_id", "turn", "role", "text", F.lead("text").over(w).alias("next")).where("role = 'user' and next is not null")


def _compared(p: DataFrame) -> DataFrame:
    arm = F.element_at(F.array(F.lit("no_sep"), F.lit("sep_once"), F.lit("sep_multi")), ((F.col("turn") % 3) + 1).cast("int"))
    p = p.withColumn("distance", X.edit_distance("ref", "hyp"))
    return p.withColumn("cer", X.cer(F.col("ref"), F.col("hyp"), F.col("distance"))).withColumn("arm", arm).withColumn("stream", F.concat(F.lit("s"), (F.col("turn") % 2).cast("string")))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """User turns as reference, the next turn as hypothesis, ASCII only and normalised; arm by turn."""
    plain = lambda t: F.regexp_replace(F.coalesce(t, F.lit("")), r"[^\x21-\x7E]", "")
    ref, hyp = X.normalize_native(plain(F.col("text"))), X.normalize_native(plain(F.col("next")))
    return _compared(_turns(read(spark, d, "conversations")).select("conv_id", "turn", ref.alias("ref"), hyp.alias("hyp")))


def whole_pairs(spark: SparkSession, d: str) -> DataFrame:
    """`pairs` of the whole texts, NFKC and normalised; nothing but white space and punctuation goes."""
    said = X.normalize(read(spark, d, "conversations").select("conv_id", "turn", "role", "text"), "text", "t")  # each turn once, before it is paired
    p = _turns(said.withColumn("text", F.when(F.col("text").isNotNull(), F.col("t"))))
    return _compared(p.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("ref"), F.col("next").alias("hyp")))


_PLAIN = r"lower(regexp_replace(regexp_replace(coalesce({0}, ''), '[^\x21-\x7E]', '', 'g'), '[!-/:-@\[-`{{-~]', '', 'g'))"
PAIRS = f"""turns AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
texts AS (SELECT conv_id, turn, {_PLAIN.format("text")} AS ref, {_PLAIN.format("nxt")} AS hyp FROM turns WHERE role = 'user' AND nxt IS NOT NULL),
pairs AS (SELECT *, CASE WHEN length(ref) > 0 THEN least(1.0::DOUBLE, round(levenshtein(ref, hyp)::DOUBLE / length(ref), 6)) WHEN length(hyp) = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS cer,
  ['no_sep', 'sep_once', 'sep_multi'][(turn % 3 + 1)::INT] AS arm, 's' || (turn % 2) AS stream FROM texts)"""

_BARE = r"""lower(regexp_replace(regexp_replace(nfc_normalize(coalesce({0}, '')), '[\s\x0B\x85\xA0]', '', 'g'),
 '[!-/:-@\[-`{{-~，。！？、；：「」『』（）【】《》…·—–]', '', 'g'))"""
# a pair's own alphabet in single bytes, as DuckDB's levenshtein counts bytes
def _labelled(text: str, abc: str = "abc") -> str:
    return f"array_to_string([chr((33 + list_position({abc}, c))::INT) FOR c IN string_split({text}, '') IF c <> ''], '')"


#: `PAIRS` over the whole texts; the same as NFKC's where a text has no compatibility characters.
PAIRS_WHOLE = (
    PAIRS.replace(_PLAIN.format("text"), _BARE.format("text")).replace(_PLAIN.format("nxt"), _BARE.format("nxt"))
    .replace("pairs AS (SELECT *,", f"alphabets AS (SELECT *, list_distinct(string_split(ref || hyp, '')) AS abc FROM texts),\nlabelled AS (SELECT * EXCLUDE (abc), {_labelled('ref')} AS rl, {_labelled('hyp')} AS hl FROM alphabets),\npairs AS (SELECT *,")
    .replace("levenshtein(ref, hyp)", "levenshtein(rl, hl)").replace("AS stream FROM texts)", "AS stream FROM labelled)")
)


_BOTH = "list_distinct(string_split(wake || hyp, ''))"
_WAKE = f"(SELECT levenshtein({_labelled('wake')}, {_labelled('hyp')}) FROM (SELECT {_BOTH} AS abc))"


def whole_sql(sql: str) -> str:
    """A query over pairs as one over the pairs of whole texts."""
    return sql.replace(PAIRS, PAIRS_WHOLE).replace("levenshtein(ref, hyp)", "levenshtein(rl, hl)").replace("levenshtein(wake, hyp)", _WAKE)


# Sentences that exercise the text classes.
SAYINGS = [
    "打开空调", "请帮我打开客厅的灯", "把空调调到二十六度", "关于天气", "开冰箱门", "关下空调然后打开窗帘", "今天吃什么", "我回来了", "有点冷", "语音功能已关闭", "播放下一首歌", "影院模式",
    "防直吹", "就是那个我觉得不太好吧", "怪不得今天这么热因为外面太阳很大所以大家都不出门", "嗯", "", "turn on the light", "空调 light", "风速最低", "温度百分之三十", "12345", "再见", "亮度调高一点吧",
]


def sayings(spark: SparkSession) -> DataFrame:
    base = spark.createDataFrame(list(enumerate(SAYINGS)), "k long, raw string")
    return base.withColumn("t", X.normalize_native(F.col("raw"), X.LING_PUNCT))


SAYINGS_SQL = "sayings(k, raw) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{s}')" for i, s in enumerate(SAYINGS)) + "), said AS (SELECT k, lower(replace(raw, ' ', '')) AS t FROM sayings)"
