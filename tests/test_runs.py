"""Settings, commands, run folders, and the signal and model operators behind them."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelight import commands
from gatelight.config import RunConfig
from gatelight.operators import models, signal
from gatelight.plans import views as D
from gatelight.sources import records, runs

DATA = "/root/testdata/sf0.001"


def test_config_from_env():
    c = RunConfig.from_env({"GATELIGHT_LIMIT": "64", "GATELIGHT_USE_SEP": "0", "GATELIGHT_PIPELINE": "sep_route", "GATELIGHT_HOLDOUT_FRAC": "0.3", "GATELIGHT_ASR_LANGUAGE": " "})
    assert (c.limit, c.use_sep, c.holdout_frac, c.asr_language) == (64, False, 0.3, "")
    r = c.resolved()
    assert r.use_sep and r.locked_thr and not r.enroll_vad
    assert not RunConfig(cmd_windows="slide").resolved().locked_thr and RunConfig(force_calib=True).resolved().enroll_vad
    for bad in ({"pipeline": "x"}, {"cmd_windows": "x"}, {"holdout_frac": 1.0}):
        with pytest.raises(ValueError):
            RunConfig(**bad)


def test_norm_modes_and_tags():
    assert [RunConfig(**k).norm for k in ({}, {"enroll_znorm": True}, {"test_cohort_dir": "x"}, {"cohort_dir": "a", "test_znorm": True}, {"asnorm": True})] == ["raw", "enroll_znorm", "test_znorm", "asnorm", "asnorm"]
    assert RunConfig().run_norm(None) == "raw" and RunConfig().run_norm("asnorm") == "asnorm" and RunConfig().run_norm("enroll_znorm") == "enroll_znorm"
    assert RunConfig(test_cohort_dir="x").run_norm("enroll_znorm") == "asnorm" and RunConfig(cohort_dir="x").run_norm(None) == "enroll_znorm"
    assert RunConfig(enroll_vad=False).calibration_dir() == "presence_calib_eres2netv2_sep1_ls_novad_raw"
    assert RunConfig(asr_language="Chinese", asr_hotwords=True, asr_retry_mismatch=True, wav_source="mix").decode_tag() == "vm-cer-v2|lang=Chinese|ctx=hotwords|retry=1|wav=mix"
    assert RunConfig(asr_guess_language=True).decode_tag() == "vm-cer-v2|lang=guess|ctx=none|retry=0|wav=extracted"


@pytest.fixture(scope="module")
def trials(spark):
    t = D.trials(spark, DATA).select("uid", "split", "lang", "score", F.col("s2").alias("second_score"), "cer", F.col("vec_id").alias("id"), F.col("uid").alias("asr_text"))
    return t.where("id < 100").cache()


def test_run_command(spark, trials):
    out = commands.run(RunConfig(force_calib=True, holdout_frac=0.3, veto_encoder=True).resolved(), {"trials": trials})
    n = trials.count()
    assert out["decisions"].count() == n and out["submission"].count() == trials.where("split = 'pos'").count()
    one = out["summary"].first()
    assert one.n_pos + one.n_neg == n and out["by_side"].count() == 2 and 0 <= one.contest <= 1
    assert out["decisions"].where("reject <> (reason is not null) or (score < thr and reason <> 'score')").count() == 0
    best = commands.run(RunConfig(force_calib=True, lang_split=False, extra_reject=False).resolved(), {"trials": trials.withColumn("cer", F.lit(0.0))})["summary"].first()
    fixed = commands.calibrate(RunConfig(), {"trials": trials})["by_contest"].first()
    assert abs(best.contest - fixed.contest) < 1e-6
    frozen = commands.run(RunConfig(skip_asr=True).resolved(), {"trials": trials})
    assert "submission" not in frozen and {r.thr for r in frozen["decisions"].select("thr").distinct().collect()} == {0.29305, 0.357868}


def test_other_commands(spark, trials):
    lift = {r.arm: r for r in commands.lift(RunConfig(force_calib=True).resolved(), {"trials": trials})["lift"].collect()}
    assert set(lift) == {"score", "text", "encoder", "window", "all"} and lift["score"].gain == 0 and lift["window"].extra_pos == 0
    rows = [("a", arm, present, (0.8 if present else 0.2) if arm == "no_sep" else 0.5) for arm in ("no_sep", "sep_once") for present in (True, False, False)]
    cells = spark.createDataFrame(rows, "encoder string, arm string, present boolean, score double")
    got = commands.encoders(RunConfig(), {"cells": cells, "trials": trials})
    assert [(r.arm, r.contest) for r in got["leaderboard"].collect()] == [("no_sep", 1.0), ("sep_once", 0.5)] and got["fusion"].count() == 2 * 41 * 41
    assert commands.presence(RunConfig(), {"cells": cells})["matrix"].count() == 2 and commands.depth(RunConfig(), {"cells": cells})["depth"].first().arm == "no_sep"
    assert commands.norms(RunConfig(), {"cells": cells})["norms"].count() == 2
    assert [r.pipeline for r in commands.compare(RunConfig(), {"p": trials, "q": trials})["pipelines"].collect()] == ["p", "q"]
    texts = spark.createDataFrame([("u", "zh", "打开,空调", "打开空条")], "uid string, lang string, ref string, asr_text string")
    assert commands.recognize(RunConfig(), {"texts": texts})["rows"].first().cer == 0.25
    streams = spark.createDataFrame([("u", "no_sep", "mix", 0.5), ("u", "sep_once", "d1_spk1", 0.2), ("u", "sep_once", "d1_spk2", 0.9)], "uid string, arm string, stream string, cer double")
    assert commands.probe(RunConfig(), {"streams": streams})["gains"].first().gain == 0.3
    assert commands.manifest(RunConfig(), {"samples": streams})["enrolment"].first().uid == "u"


def test_main(spark, trials, tmp_path, monkeypatch, capsys):
    trials.write.parquet(str(tmp_path / "t"))
    monkeypatch.setenv("GATELIGHT_LIMIT", "50")
    assert commands.main(["run", "--table", f"trials={tmp_path / 't'}", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o" / "run" / "decisions")).count() in range(48, 53)
    with pytest.raises(SystemExit):
        commands.main(["nothing", "--out", "x"])


def test_threshold_chain(spark, tmp_path):
    run, shared = tmp_path / "all" / "run", tmp_path / "shared"
    put = lambda root, thr: ((root / runs.THRESHOLD_FILE).parent.mkdir(parents=True), (root / runs.THRESHOLD_FILE).write_text(json.dumps({"presence_thr": thr})))
    found = lambda: runs.threshold_file(spark, None, str(run), str(shared), "/nowhere")
    assert found() == f"/nowhere/{runs.THRESHOLD_FILE}"
    for root in (shared, run.parent, run):
        put(root, 0.3)
        assert found() == f"{root}/{runs.THRESHOLD_FILE}"
    assert runs.threshold_file(spark, "mine", str(run), None, "") == "mine"
    assert runs.threshold(spark, None, found()).first().thr == 0.3 and runs.threshold(spark, 0.0, found()).first().thr == 0.0
    assert runs.threshold(spark, -1.0, "/nowhere/x.json").first().thr == 0.25


def test_streams_of_arms(spark):
    names = ["d1/pos/u1/mix", "d1/pos/u1/d1_spk1", "d1/pos/u1/peak", "d1/pos/u1/other", "d2/pos/u1/spk1_a", "d2/pos/u1/mix", "d2/pos/u1/peak"]
    files = spark.createDataFrame([(f"file:/r/{n}.wav",) for n in names] + [("c9.wav",)], "path string")
    got = lambda mix: sorted((r.arm, r.stream) for r in runs.stream_files(files, mix).collect())
    assert got(False) == [("no_sep", "mix"), ("sep_multi", "spk1_a"), ("sep_once", "d1_spk1")]
    assert got(True) == [("no_sep", "mix"), ("sep_multi", "mix"), ("sep_multi", "spk1_a"), ("sep_once", "d1_spk1"), ("sep_once", "mix")]
    samples = spark.createDataFrame([("pos", "u1", "c9.wav"), ("pos", "u2", "c9.wav"), ("neg", "u3", "gone.wav")], "split string, uid string, cmd_wav string")
    assert sorted((r.uid, r.path) for r in runs.with_fallback(runs.stream_files(files), samples, files).where("arm = 'no_sep'").collect()) == [("u1", "file:/r/d1/pos/u1/mix.wav"), ("u2", "c9.wav")]
    assert runs.listing(spark, "/nowhere/at/all").count() == 0


def test_cells_summaries_and_sources(spark, tmp_path):
    (tmp_path / "eres__sep__once").mkdir()
    (tmp_path / "eres__sep__once" / "scores.jsonl").write_text('{"uid": "u", "label": "present", "presence_score": 0.5}\n{"uid": "v", "label": "absent", "presence_score": 0.1}\n')
    assert sorted(tuple(r) for r in runs.read_cells(spark, str(tmp_path)).collect()) == [("eres", "sep__once", "u", 0.5, True), ("eres", "sep__once", "v", 0.1, False)]
    (tmp_path / "a" / "reports").mkdir(parents=True)
    (tmp_path / "a" / "reports" / "run_summary.json").write_text(json.dumps({"overall": {"n": 3, "rr": 0.4}, "splits": {"pos": {"frr": 0.1}}, "meta": {"pipeline": "mix"}}))
    got = {r.root: r for r in runs.run_summaries(spark, {"a": str(tmp_path / "a"), "b": str(tmp_path / "b")}).collect()}
    assert (got["a"].backend, got["a"].n, got["a"].rr, got["a"].frr, got["a"].thr) == ("mix", 3, 0.4, 0.1, None) and got["b"].n is None
    (tmp_path / "o.json").write_text('[{"id": 3}, {"id": 4, "uid": "x"}]')
    (tmp_path / "o.jsonl").write_text('{"id": 3}\n{"id": 4, "uid": "x"}\n')
    for name in ("o.json", "o.jsonl"):
        assert [r.key for r in runs.overlay_source(spark, str(tmp_path / name), "id long, uid string").orderBy("id").collect()] == ["pos_3", "x"]


def test_dump_and_guard(spark, tmp_path):
    tone = signal.two_tones(0.1)
    df = spark.createDataFrame([("u", "mix", tone.tolist()), ("u", "d1_spk1", [0.0] * 10)], "uid string, stream string, wav array<float>")
    meta = {r.stream: r for r in runs.dump_streams(df, str(tmp_path / "s")).collect()}
    assert meta["mix"].n == 1600 and abs(meta["mix"].rms - 0.4) < 0.01 and meta["d1_spk1"].rms == 1e-6
    back = spark.read.parquet(str(tmp_path / "s")).where("stream = 'mix'").first().content
    assert np.abs(records.decode_wav(back) - tone).max() < 1e-4
    assert spark.read.parquet(runs.snapshot(df, str(tmp_path), "m")).count() == 2
    one = spark.createDataFrame([(True,), (None,)], "v boolean")
    assert [r.compatible for r in runs.usable_threshold(one, F.col("v"), True).collect()] == [True, None]
    with pytest.raises(Exception, match="another enrolment setting"):
        runs.usable_threshold(one, F.col("v"), False).collect()


def test_resampling_keeps_tones():
    x = np.sin(2 * np.pi * 440 * np.arange(8000) / 16000).astype(np.float32)
    for method in signal.KERNELS:
        down = signal.resampled(x, 16000, 8000, method)
        want = np.sin(2 * np.pi * 440 * np.arange(4000) / 8000)
        assert len(down) == 4000 and np.abs(down - want)[200:-200].max() < 0.02, method
        high = np.sin(2 * np.pi * 6000 * np.arange(8000) / 16000).astype(np.float32)  # beyond the new range: gone, not folded
        assert np.abs(signal.resampled(high, 16000, 8000, method))[200:-200].max() < 0.05, method
    with pytest.raises(ValueError):
        signal.resample(16000, 8000, "x")


def test_cropped_speech(spark):
    quiet, tone = np.zeros(16000, np.float32), signal.two_tones(1.0)
    got = signal.cropped_speech(np.concatenate([quiet, tone, quiet]))
    assert got["cropped"] and got["begin"] == 16000 - 1600 and got["finish"] == 32000 + 1600 and len(got["wav"]) == got["out_n"] == 19200
    assert signal.cropped_speech(tone[:100])["reason"] == "too_short" and signal.cropped_speech(np.zeros(16000, np.float32))["reason"] == "flat_energy"
    assert signal.cropped_speech(signal.two_tones(6.0))["out_n"] == 64000
    df = spark.createDataFrame([(tone.tolist(),), (None,)], "w array<float>").select(signal.vad_struct()("w").alias("v"))
    assert [r.v.out_n if r.v is not None else None for r in df.collect()] == [16000, None]


def test_command_windows(spark):
    loud = np.concatenate([np.zeros(12800, np.float32), signal.two_tones(0.8)])
    df = spark.createDataFrame([(loud.tolist(),), ([0.0] * 25600,)], "w array<float>")
    got = [r.w for r in df.select(signal.audible(signal.command_windows(F.col("w")), F.col("w")).alias("w")).collect()]
    assert [(w.start, w.end) for w in got[0]] == [(6400, 19200), (12800, 25600)] and len(got[1]) == 3
    assert [(w.start, w.end) for w in df.select(signal.command_windows(F.col("w"), "off").alias("w")).first().w] == [(0, 25600)]


def test_log_mel_and_overlap_add():
    f = signal.log_mel(signal.two_tones(1.0))
    assert f.shape == (98, 80) and np.abs(f.mean(0)).max() < 1e-3 and signal.log_mel(np.zeros(10)).shape == (0, 80)
    tone = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    bank, power = signal.filter_bank(16000, 512, 80), np.abs(np.fft.rfft(tone[:400] * np.hamming(400), 512)) ** 2
    top = int(np.argmax(bank @ power))
    assert abs(np.argmax(bank[top]) * 16000 / 512 - 1000) < 60
    x = np.random.default_rng(0).normal(size=10000).astype(np.float32)
    assert np.abs(signal.overlap_add(x, lambda c: c * 2, 1000) - 2 * x)[1:].max() < 1e-3 and np.array_equal(signal.overlap_add(x[:900], lambda c: c, 1000), x[:900])


def test_encoders_and_isolators(spark):
    known = {"eres2netv2": models.FakeEncoder, "mine": models.FakeEncoder}
    assert models.encoder(" ERES", known) is models.FakeEncoder and models.encoder("mine", known) is models.FakeEncoder
    with pytest.raises(KeyError):
        models.encoder("camp++", known)
    calls = []

    def tight(x):
        calls.append(len(x))
        if len(x) > 300:
            raise MemoryError
        return x

    assert len(models.shortened(tight, np.zeros(1000))) == 250 and calls == [1000, 500, 250]
    with pytest.raises(MemoryError):
        models.shortened(tight, np.zeros(10**6))
    df = spark.createDataFrame([("u", signal.two_tones(0.1).tolist(), [0.1] * 100)], "uid string, mix array<float>, enrol array<float>")
    row = models.isolate(df, models.MixIsolator, "mix", "enrol").first()
    assert row.isolate_error is None and abs(max(map(abs, row.isolated)) - 0.95) < 1e-5

    class Split:
        def separate(self, w):
            return w * 0, w

    class Mean:
        def embed(self, wavs):
            return [np.array([np.abs(w).mean(), 1e-3]) for w in wavs]

    x = signal.two_tones(0.1)
    assert np.array_equal(models.RouteIsolator(Mean(), Split()).isolate(x, x), x)


def test_retry_of_unfit_texts(spark):
    class Answers:
        def transcribe(self, wavs, language, context):
            return ["打开客厅的空调和灯" if context == "home" and w[0] > 0 else "从混音里来的话语" if len(w) == 3 else "" for w in wavs]

    rows = [("fits", "打开客厅的空调", 2.0, [1.0], [0.0] * 3), ("again", "嗯", 3.0, [1.0], [0.0] * 3), ("mix", "嗯", 3.0, [-1.0], [0.0] * 3), ("nothing", "嗯", 3.0, [-1.0], None)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "uid string, asr_text string, sec double, wav array<float>, mix array<float>, language string, context string")
    got = {r.uid: (r.asr_pass, r.asr_text) for r in models.retry_mismatched(df, Answers, "wav", "mix", "sec", "home").collect()}
    assert got == {"fits": ("primary", "打开客厅的空调"), "again": ("retry_decode", "打开客厅的空调和灯"), "mix": ("retry_mix", "从混音里来的话语"), "nothing": ("primary", "嗯")}
