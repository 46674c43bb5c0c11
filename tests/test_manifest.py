"""Manifests, joins of samples and results, packing, rule lists: small cases and brute force."""

import random
import re
import tracemalloc
import unicodedata
from collections import Counter

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gatelight.functions import text as X
from gatelight.operators import calibrate as K
from gatelight.operators import manifest as N
from gatelight.plans import batch  # noqa: F401
from gatelight.plans import views as D
from gatelight.plans import texts  # noqa: F401
from gatelight.plans.queries import FIXTURE_SQL, FIXTURES, QUERIES

DATA = "/root/testdata/sf0.001"


def test_existing_splits_rows(spark):
    rows = spark.createDataFrame([("a", "e1", "c1"), ("b", "e2", "c9"), ("c", None, "c1")], "uid string, enroll string, cmd string")
    files = spark.createDataFrame([("e1",), ("e2",), ("c1",), ("c1",)], "path string")
    fine, gaps = N.existing(rows, files, ["enroll", "cmd"])
    assert [r.uid for r in fine.collect()] == ["a"]
    assert {r.uid: r.missing for r in gaps.collect()} == {"b": ["cmd"], "c": ["enroll"]}


def test_same_label_raises_on_a_difference(spark):
    a = spark.createDataFrame([("u", "present", 0.1)], "uid string, label string, s double")
    assert N.same_label(a, a.select("uid", "label", F.lit(2).alias("t")), "uid", "label").collect()[0].t == 2
    with pytest.raises(Exception, match="labels differ for u"):
        N.same_label(a, a.select("uid", F.lit("absent").alias("label")), "uid", "label").collect()


def test_packed_defaults(spark):
    rows = spark.createDataFrame(
        [("a", "pos", "zh", 0.0, 0.4, None, 0.3, "accept", 0.2, "", "h", None), ("b", "pos", "zh", 0.5, 0.4, 0.2, 0.3, "reject", 0.2, "x", "h", "c"), ("c", "neg", "en", None, None, None, None, None, None, None, None, None)],
        "uid string, split string, lang string, presence_score double, second_score double, presence_thr double, thr double, decision string, cer double, asr_text string, hyp string, cmd_text string",
    )
    got = {r.uid: r for r in N.packed(rows).collect()}
    assert (got["a"].score, got["a"].thr, got["a"].hyp, got["a"].cer, got["a"].orig_accept) == (0.4, 0.3, "h", 0.2, True)
    assert (got["b"].cer, got["b"].file_rej, got["b"].thr, got["b"].label) == (1.0, True, 0.2, "c")
    assert (got["c"].score, got["c"].thr, got["c"].hyp, got["c"].cer, got["c"].file_rej) == (0.0, 0.0, "", None, False)


def test_features_of_mixed_texts(spark):
    rows = spark.createDataFrame([("小爱", "打开空调", "turnontheac"), ("hi", "", "小爱打开灯"), ("小爱", "", "")], "w string, c string, h string")
    got = [r.asDict() for r in rows.select(*[c.alias(n) for n, c in N.features(F.col("w"), F.col("c"), F.col("h")).items()]).collect()]
    assert got[0]["cmd_hyp_lang_mismatch"] and got[0]["wake_hyp_lang_mismatch"] and not got[0]["wake_cmd_lang_mismatch"]
    assert got[1]["cmd_lang"] == "na" and got[1]["wake_hyp_lang_mismatch"] and got[1]["looks_command"] and got[1]["has_device"]
    assert got[2]["empty"] and not got[2]["wake_in_hyp"] and got[2]["hyp_lang"] == "empty"
    assert len(N.feature_buckets()) == 15


def test_rule_list_counts_each_rule(spark):
    rows = spark.createDataFrame([(True, 0.9), (True, 0.1), (False, 0.2), (False, 0.8)], "present boolean, score double").withColumn("k", F.lit(1))
    got = {r.name: r for r in K.rule_list(rows, {"half": F.col("score") < 0.5, "none": F.lit(False)}, ["k"]).collect()}
    assert (got["half"].rr, got["half"].frr, got["half"].contest) == (0.5, 0.5, 0.5) and (got["none"].rr, got["none"].frr) == (0.0, 0.0)


def test_recognition_input(spark):
    rows = spark.createDataFrame([(" MIX", "x.wav", "c.wav"), (None, "x.wav", "c.wav"), ("extracted", "", "c.wav")], "s string, x string, c string")
    assert [r.w for r in rows.select(N.recognition_input(F.col("s"), F.col("x"), F.col("c")).alias("w")).collect()] == ["c.wav", "x.wav", None]


def test_substitution_counts_by_brute_force(spark):
    counts = Counter()
    for r in D.whole_pairs(spark, DATA).where("cer > 0").select("ref", "hyp").collect():
        ref, hyp = X._align(r.ref, r.hyp)[4:]
        split = lambda s: [t for t in _tokens(s)]
        for a, b in zip(split(ref), split(hyp), strict=True):
            if a.startswith("〔") and b.startswith("〔"):
                counts[a.strip("〔〕"), b.strip("〔〕")] += 1
    want = sorted(counts.items(), key=lambda kv: (-kv[1], kv[0]))[:20]
    assert [((r.ref, r.hyp), r.n) for r in QUERIES["substitution_counts"](spark, DATA).collect()] == want


def _tokens(s):
    out, i = [], 0
    while i < len(s):
        n = s.index("〕", i) - i + 1 if s[i] == "〔" else 1
        out.append(s[i : i + n])
        i += n
    return out


@pytest.mark.parametrize("name", ["genre", "verb_count", "text_class", "text_languages", "text_tags"])
def test_text_rules_on_fixed_sentences(spark, name):
    """The rules that tables of other languages hardly touch, against SQL."""
    got = FIXTURES[name](spark, DATA)
    rows = duckdb.connect().execute(f"SELECT {', '.join(map('"{}"'.format, got.columns))} FROM ({FIXTURE_SQL[name]})").fetchall()
    assert len(rows) == 24 and sorted(map(tuple, got.collect())) == sorted(rows)


def test_alignment_of_long_texts_is_bounded(spark, monkeypatch):
    """Time and memory of bits, not of cells; a trace in small blocks is the same."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcde_é") for _ in range(n)) for n in (6000, 5900, 300, 190, 1, 0)]
    tracemalloc.start()
    s, d, i, n, left, right = X._align(texts[0], texts[1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6 and n == 6000 and d - i == 100 and len(_tokens(left)) == len(_tokens(right)) == n + i
    want = {(a, b): X._align(a, b) for a in texts[2:] for b in texts[2:]}
    monkeypatch.setattr(X, "TRACE_BYTES", 1)
    for (a, b), whole in want.items():
        assert X._align(a, b) == whole
        x = spark.sql("SELECT levenshtein(:a, :b) d", {"a": a, "b": b}).first().d
        assert whole[0] + whole[1] + whole[2] == x


def test_replaced_brackets_count(spark):
    rows = spark.createDataFrame([("〔a", "〕b"), ("aa", "bb"), (None, "x"), ("", "")], "ref string, hyp string")
    got = [{(x.ref, x.hyp): x.n for x in r.p} for r in rows.select(X.replaced("ref", "hyp").alias("p")).collect()]
    assert got == [{("〔", "〕"): 1, ("a", "b"): 1}, {("a", "b"): 2}, {}, {}]


def test_texts_reach_python_in_bounded_pieces():
    texts = ["x" * 400_000, None, "", "y" * 700_000, "z" * 3_000_000, "é"]
    got = list(X.pieces(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [x for part in got for x in part] == texts and max(len("".join(t or "" for t in part)) for part in got) <= 3_000_000 + X.PIECE_BYTES and len(got) > 2
    pairs = list(X.pieces(iter([(pa.array(texts), pa.array(texts[::-1]))])))
    assert [x for part in pairs for x in part] == list(zip(texts, texts[::-1]))


def test_settled_texts_stay_in_the_jvm(spark, tmp_path):
    """NFKC changes no text of SETTLED; other texts are changed as before, and only they reach Python."""
    settled = [c for c in map(chr, range(0x110000)) if re.match(f"[{X.SETTLED}]", c)]
    canonical = [d.split() for d in map(unicodedata.decomposition, map(chr, range(0x110000))) if d and not d.startswith("<")]
    parts = {d[1] for d in canonical if len(d) > 1}  # what may join with a character before it
    assert len(settled) > 20_000 and not any(unicodedata.combining(c) or unicodedata.normalize("NFKC", c) != c or f"{ord(c):04X}" in parts for c in settled if c > "\x7f")
    said = ["Élan, vital", "打开 空调。", "e\u0301a", "Ａｂ，c", "ﬁn…", "plain", "", None, "한글 \u1112\u1161"]
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(s):
        calls.add(len(s))
        return s.map(lambda x: unicodedata.normalize("NFKC", x))

    old, X.nfkc = X.nfkc, counted
    try:
        rows.write.parquet(f"{tmp_path}/documents.parquet")
        got = {r.doc_id: r.t for r in QUERIES["normalize_text"](spark, str(tmp_path)).collect()}
    finally:
        X.nfkc = old
    clean = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "") if not c.isspace() and c not in X.CER_PUNCT).lower()
    assert got == {i: clean(t) for i, t in enumerate(said)} and calls.value == 4


def test_pairs_measure_a_distance_once(spark):
    """By bits, in one place of the plan: the cells of long texts aren't visited, let alone twice."""
    for pairs in ("cer_pairs", "cer_pairs_whole", "cer_block_whole"):
        plan = QUERIES[pairs](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "levenshtein" not in plan and "edit_distance" in plan
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab空😀") for _ in range(rng.randrange(150))) for _ in range(60)] + ["", None]
    rows = spark.createDataFrame([(rng.choice(texts), rng.choice(texts)) for _ in range(400)], "a string, b string")
    assert rows.where(~X.edit_distance("a", "b").eqNullSafe(F.levenshtein("a", "b"))).count() == 0
