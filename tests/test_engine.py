"""The engine's queries against SQL, and golden cases."""

import os
import random
import unicodedata

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelight.functions import text as X
from gatelight.operators import calibrate as K
from gatelight.operators import models, relational, rules, scoring, signal, windows
from gatelight.plans import batch, more, texts  # noqa: F401
from gatelight.plans.queries import QUERIES, SQL
from gatelight.sources import records
from gatelight.streaming import events, state

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(D):
        c.sql(f"create view {f[:-8]} as select * from '{D}/{f}'")
    return c


def rounded(v):
    if isinstance(v, float):
        return f"{v:.8g}"
    return [rounded(x) for x in v] if isinstance(v, (list, tuple, np.ndarray)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_twin(spark, con, name):
    df, rel = QUERIES[name](spark, D), con.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert sorted(str([rounded(v) for v in r]) for r in df.select(*[f"`{c}`" for c in rel.columns]).collect()) == sorted(str([rounded(v) for v in r]) for r in rel.fetchall())


def test_alignment(spark):
    rng = random.Random(0)
    rows = [("".join(rng.choice("abc空") for _ in range(rng.randint(0, 9))), "".join(rng.choice("abc空") for _ in range(rng.randint(0, 9)))) for _ in range(80)]
    df = spark.createDataFrame(rows, "r string, h string").withColumn("a", X.align("r", "h")).withColumn("d", F.levenshtein("r", "h"))
    assert df.where("a.s + a.d + a.i <> d").count() == 0
    one = spark.createDataFrame([("abc", "axcq")], "r string, h string").select(X.align("r", "h").alias("a")).first().a
    assert (one.s, one.d, one.i, one.ref_aligned, one.hyp_aligned) == (1, 0, 1, "a〔b〕c_", "a〔x〕c〔q〕")


def test_alignment_golden():
    assert X._align("", "ab") == (0, 0, 2, 0, "__", "ab") and X._align("", "") == (0, 0, 0, 0, "", "")
    assert X._align("ab", "") == (0, 2, 0, 2, "〔a〕〔b〕", "__")
    assert X._align("打开空调", "打开了空") == (2, 0, 0, 4, "打开〔空〕〔调〕", "打开〔了〕〔空〕")  # diagonal first
    assert X._align("aab", "ab") == (0, 1, 0, 3, "〔a〕ab", "_ab")


def test_ranks_without_whole_groups(spark):
    from gatelight.operators import ranks

    rng = random.Random(2)
    rows = [(rng.choice("ab"), f"u{i}", rng.choice([None, 0.0, 0.25, 0.5, 1.0]), rng.choice([None, rng.randint(0, 200_000)])) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, uid string, c double, id long")
    got = {r.g: r for r in ranks.order_statistics(df, ["g"], "c", {"mid": ranks.upper_middle, "p90": ranks.nearest_at(0.9), "low": ranks.floor_at(0.1)}).collect()}
    for g in "ab":
        x = sorted(c for h, _, c, _ in rows if h == g and c is not None)
        n = len(x)
        assert (got[g].mid, got[g].p90, got[g].low) == (x[n // 2], x[round(0.9 * (n - 1))], x[int(0.1 * (n - 1))])
    turns = {r.uid: (r.turn, r["__gl_total"]) for r in ranks.ranked(df, ["g"], "uid", 5).collect()}
    import hashlib
    for g in "ab":
        own = sorted((hashlib.md5(f"{u}|5".encode()).hexdigest(), u) for h, u, _, _ in rows if h == g)
        assert [turns[u] for _, u in own] == [(i + 1, len(own)) for i in range(len(own))]
    pos = {r.uid: r.pos for r in ranks.numbered(df, "id", "uid", width=5000).collect()}
    assert [pos[u] for _, u, _, i in sorted(rows, key=lambda r: (r[3] is None, r[3] or 0, r[1]))] == list(range(500))


def test_missing_scores_raise(spark):
    from gatelight.operators import overlay

    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, t string"), spark.createDataFrame([(1, 0.5)], "k long, s double")
    with pytest.raises(Exception, match="no score for 2"):
        overlay.joined(a, b, "k").collect()
    assert overlay.joined(a.where("k = 1"), b, "k").count() == 1


def test_24_bit_wav():
    import io
    import wave

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(3)
        w.setframerate(16000)
        w.writeframes(b"".join(v.to_bytes(3, "little", signed=True) for v in (0, 1 << 22, -(1 << 22), (1 << 23) - 1, -(1 << 23))))
    assert np.allclose(records.decode_wav(out.getvalue()), [0, 0.5, -0.5, 1, -1], atol=1e-6)


def test_text_rules(spark):
    rows = spark.createDataFrame([("", 3.0), ("开", 4.0), ("打开空调", 1.5)], "h string, s double")
    assert [r[0] for r in rows.select(X.duration_mismatch(F.col("h"), F.col("s"))).collect()] == [True, True, False]
    t = spark.createDataFrame([("势必会挤压产业经济发展空间此时",), ("打开空调",)], "t string").withColumn("c", X.classify(F.col("t")))
    hit = rules.text_reject(F.lit(0.30), F.lit(0.29), F.col("c.len"), F.col("c.task_oriented"))
    assert [r[0] for r in t.select(hit).collect()] == [True, False]
    v = spark.range(1).select(rules.veto(F.lit(0.30), F.lit(0.10), F.lit(0.29)), rules.veto(F.lit(0.30), F.lit(0.28), F.lit(0.29)), rules.veto(F.lit(0.30), F.lit(None).cast("double"), F.lit(0.29)))
    assert tuple(v.first()) == (True, False, False)
    fake = spark.createDataFrame([("abcd",), ("ab",)], "r string")
    assert [r[0] for r in fake.select(X.fake_hypothesis(F.col("r"), "perturb")).collect()] == ["aXcQ", "abQ"]


def test_normalize_full_width(spark):
    df = X.normalize(spark.createDataFrame([("Ａ（ｂ）　，C",), (None,), (" é ",)], "t string"), "t", "n")
    assert sorted(r.n for r in df.collect()) == ["", "abc", "é"]


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return row[-1]


def test_pairs_of_whole_texts(spark, tmp_path):
    said = [("打开空调", "打开窗帘"), ("café é", "cafe e"), ("Ａｂ，c", "abc"), ("Turn on!", "turn off"), ("你好", ""), ("", "好"), (None, "é")]
    turns = [(k, i, role, t) for k, both in enumerate(said) for i, (role, t) in enumerate(zip(("user", "assistant"), both))]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, "zh"), (1, None)], "doc_id long, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    clean = lambda t: "".join(c for c in unicodedata.normalize("NFKC", t or "") if not c.isspace() and c not in X.CER_PUNCT).lower()
    want = {}
    for k, (a, b) in enumerate(said):
        a, b = clean(a), clean(b)
        want[k] = (_distance(a, b), min(1.0, round(_distance(a, b) / len(a), 6)) if a else float(bool(b)))
    assert {r.conv_id: (r.distance, r.cer) for r in QUERIES["cer_pairs_whole"](spark, str(tmp_path)).collect()} == want
    assert want[0] == (2, 0.5) and want[1][0] == 2 and want[2] == (0, 0.0)
    grams = {(r.n, r.gram): r.c for r in QUERIES["ngram_topk_whole"](spark, str(tmp_path)).collect()}
    assert grams[2, "打开"] == 1 and grams[3, "afé"] == 1
    for name in (n for n in QUERIES if n.endswith("_whole")):
        assert QUERIES[name](spark, str(tmp_path)).columns == QUERIES[name[:-6]](spark, str(tmp_path)).columns


@pytest.mark.parametrize("n", [0, 1, 5, 300, 20_500])
def test_cohorts_of_any_size(spark, n):
    rng = np.random.default_rng(n)
    c, e = rng.normal(3, 1, (n, 6)), rng.normal(0, 1, (4, 6))
    cohort = spark.createDataFrame([(x.tolist(),) for x in c] + [(None,)], "emb array<double>").repartition(3)
    probes = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "id long, emb array<double>")
    got = {r.id: (r.mu, r.sigma) for r in scoring.cohort_stats(probes, cohort).collect()}
    assert set(got) == set(range(4))
    for i, x in enumerate(e):
        if not n:
            assert got[i] == (None, 1e-4)
        else:
            s = c @ x
            assert np.allclose(got[i], (s.mean(), max(s.std(), 1e-4)), rtol=1e-10, atol=1e-12)


def test_threshold_ties(spark):
    t = spark.createDataFrame([(0.5, True), (0.1, False)], "score double, present boolean")
    c = K.curve(t)
    assert K.select_contest(c).first().thr == 0.5 and K.select_contest(c, highest=False).first().thr == 0.11
    assert K.curve(t.where("present")).where("rr <> 1").count() == 0


def test_fusion_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.5, rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(200)]
    got = K.fuse_two(spark.createDataFrame(rows, "present boolean, s1 double, s2 double"), 9).collect()
    assert len(got) == 162
    for r in got:
        acc = [(p, (a >= r.tp or b >= r.ts) if r.mode == "or" else (a >= r.tp and b >= r.ts)) for p, a, b in rows]
        assert r.frr == round(sum(p and not x for p, x in acc) / sum(p for p, _ in acc), 9)


def test_windows_and_signal(spark):
    w = spark.range(1).select(windows.sliding(F.lit(48000), 12800, 6400, 5600).alias("w")).first().w
    assert len(w) >= 5 and w[-1].end == 48000
    assert [tuple(x) for x in spark.range(1).select(windows.sliding(F.lit(100), 12800, 6400, 5600).alias("w")).first().w] == [(0, 100)]
    wav = np.zeros(48000, np.float32)
    wav[16000:24000] = 0.25
    df = spark.createDataFrame([(wav.tolist(),), (None,)], "wav array<float>")
    seg = df.select(signal.speech_segments()("wav").alias("s")).collect()
    assert seg[1].s is None and len(seg[0].s) == 1 and seg[0].s[0].start <= 16000 < 23000 < seg[0].s[0].end
    assert abs(max(df.select(signal.peak_normalize()("wav").alias("x")).first().x) - 0.95) < 1e-6
    low = df.select(signal.resample(16000, 8000)("wav").alias("x")).first().x
    assert len(low) == 24000


def test_wav_and_models(spark, tmp_path):
    (tmp_path / "SSB0001").mkdir()
    (tmp_path / "SSB0001" / "SSB00010002.wav").write_bytes(records.encode_wav(signal.two_tones(0.5)))
    got = records.read_wavs(spark, str(tmp_path))
    r = got.first()
    assert r.speaker == "SSB0001" and len(r.wav) == 8000
    streams = models.separate(got, models.FakeSeparator, "speaker", "wav", 2)
    assert [s.stream for s in streams.collect()] == ["mix", "d1_spk1", "d1_spk2", "d2_spk1_a", "d2_spk1_b", "d2_spk2_a", "d2_spk2_b"] == signal.stream_names(2)
    assert all(signal.valid(np.array(s.wav)) for s in streams.where("stream like 'd1%'").collect())
    assert len(got.select(models.embed(models.FakeEncoder)("wav").alias("e")).first().e) == 32
    asr = models.recognize(got.withColumn("language", F.lit("zh")).withColumn("context", F.lit("")), models.FakeRecognizer, "language", "context", "wav")
    assert asr.first().asr_text == "zh:8000"


def test_sources(spark, tmp_path):
    p = str(tmp_path / "x.jsonl")
    with open(p, "w") as f:
        f.write('{"uid": "a", "ok": true, "n": 1}\n\n{"uid": "a", "n": 2}\n{"uid": "", "n": 3}\n{"uid": "b", "ok": false, "n": 4}\n')
    rows = records.read_jsonl(spark, p, "uid string, ok boolean, n long")
    assert [(r.uid, r.n) for r in records.enrolment_index(rows, "n").collect()] == [("a", 2)]
    assert records.read_jsonl(spark, p + ".none", "uid string", missing_ok=True).count() == 0
    t = str(tmp_path / "t.json")
    with open(t, "w") as f:
        f.write('{"recommended": {"thr": 0.4}, "thr_by_lang": {"zh": 0.3}}')
    r = records.read_threshold(spark, t, 0.5).first()
    assert r.thr == 0.4 and r.thr_by_lang == {"zh": 0.3}
    assert records.read_threshold(spark, t + ".none", 0.5).first().thr == 0.5
    records.write_jsonl(rows, str(tmp_path / "out"), by=["uid"])
    assert spark.read.json(str(tmp_path / "out")).count() == 4
    back = spark.createDataFrame([("none",), ("route",), (None,)], "b string").select(models.backend(F.col("b")))
    assert [r[0] for r in back.collect()] == ["mix", "sep_route", "ps4"]


def test_resume(spark):
    done = spark.createDataFrame([("a", "ok", "x"), ("b", "asr_error", "x"), ("c", "ok", None)], "uid string, status string, tag string")
    tasks = spark.createDataFrame([("a", "y"), ("b", "x"), ("c", None), ("d", "x")], "uid string, tag string")
    assert sorted(r.uid for r in relational.pending(tasks, done, ["uid"], ["ok"]).collect()) == ["b", "d"]
    assert [r.uid for r in relational.stale(done, tasks, "uid", ["tag"]).collect()] == ["a"]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.read.parquet(f"{D}/events.parquet").repartition(3).write.parquet(src)
    target = str(tmp_path / "out")
    for _ in range(2):
        state.append_new(events.read_stream(spark, src), target, str(tmp_path / "cp"), ["event_id"], lambda df: df.select("event_id", "value")).start().awaitTermination()
    assert spark.read.parquet(target).count() == spark.read.parquet(src).count()
    q = events.windowed(events.read_stream(spark, src), "1 hour", late="40 days").writeStream.outputMode("complete").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    as_text = lambda df: sorted(map(str, df.withColumn("win_start", F.col("win_start").cast("string")).collect()))
    assert as_text(spark.table("tumbling")) == as_text(events.windowed(spark.read.parquet(src), "1 hour"))


def test_marks_keep_what_patterns_fit(spark):
    """Classes, tags and genres are the same by the marks of a text and its length as by the text."""
    rng = random.Random(7)
    words = [*X.ACT_VERBS, *X.STATE_MARKS, *X.V1_UNITS, *X.V1_QUESTIONS, *X.BROADCASTS, *X.DISCOURSE, *X.PARTICLES, *X.LINKS, *sum(X.GENRES.values(), []), "我要", "回家了", "有点热", "吃完了", "开", "关于", "灯", "天气", "a", "é", " ", "7", "٣", "𝟘", "😀", "模式", "色温"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 6))) for _ in range(600)] + ["打x开", "打 开", "关于打开", "x吗", "吗x", "开x窗", "x" * 40]
    t, m, n = F.col("t"), F.col("m"), F.length("t")
    df = spark.createDataFrame([(x,) for x in texts], "t string").withColumn("m", X.marks(t))
    for f in (X.classify, X.v1_tags, X.genre, X.verb_count):
        assert not df.where(~f(t).eqNullSafe(f(m, n))).count(), f.__name__
    assert df.where("t = 'xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx'").first()["m"] == " "
