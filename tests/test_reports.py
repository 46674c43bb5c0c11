"""Run summaries against plain Python."""

import random

import numpy as np
from pyspark.sql import functions as F

from gatelight.functions import text as X
from gatelight.operators import analysis, overlay, ranks

SCHEMA = "split string, present boolean, score double, cer double, latency_ms double, decision string"
NAMES = ["accept", "accept_no_tse", "reject", "stream_error", "pipeline_error"]


def summary(rows):
    share = lambda a, b: round(a / b, 6) if b else None
    pos, neg = [r for r in rows if r[1]], [r for r in rows if not r[1]]
    count = lambda rs, *ds: sum(r[5] in ds for r in rs)
    cers = [1.0 if r[5] == "reject" else r[3] for r in pos]
    pending = sum(c is None for c in cers)
    cer = None if pending else sum(cers) / len(cers) if cers else 0.0
    ms, scores = sorted(r[4] for r in rows if r[4] is not None), [r[2] for r in rows if r[2] is not None]
    rr = count(neg, "reject") / len(neg) if neg else 0.0
    return {
        "n": len(rows), "n_present": len(pos), "n_absent": len(neg), **{f"n_{d}": count(rows, d) for d in NAMES}, "accept_rate": share(count(rows, "accept"), len(rows)),
        "reject_rate": share(count(rows, "reject"), len(rows)), "error_rate": share(count(rows, "stream_error", "pipeline_error"), len(rows)),
        "mean_score": round(sum(scores) / len(scores), 6) if scores else None, "frr": share(count(pos, "reject"), len(pos)), "far": share(count(neg, "accept"), len(neg)),
        "rr": share(count(neg, "reject"), len(neg)), "pending": pending, "cer": None if cer is None else round(cer, 6), "contest": None if cer is None else round(0.5 * rr + 0.5 * (1 - cer), 6),
        "latency_mean": round(sum(ms) / len(ms), 6) if ms else None, "latency_p50": ms[len(ms) // 2] if ms else None, "latency_p95": ms[int(0.95 * (len(ms) - 1))] if ms else None,
    }


def test_run_report(spark):
    rng, rows = random.Random(1), []
    for i in range(400):
        split = rng.choice(["pos", "neg", "known", None, "mute"])
        d = rng.choice(NAMES)
        cer = None if rng.random() < 0.2 and split != "known" else round(rng.random(), 3)
        ms = None if split == "mute" or rng.random() < 0.1 else float(rng.randint(1, 40))
        rows.append((split, {"pos": True, "neg": False}.get(split, rng.random() < 0.5), None if d == "pipeline_error" else round(rng.random(), 3), cer, ms, d))
    got = {(r.split, r.is_all): {k: v for k, v in r.asDict().items() if k not in ("split", "is_all")} for r in analysis.run_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {(s, False): summary([r for r in rows if r[0] == s]) for s in ("pos", "neg", "known", None, "mute")} | {(None, True): summary(rows)}
    close = lambda a, b: a == b or (isinstance(a, float) and b is not None and abs(a - b) < 2e-6)
    assert got.keys() == want.keys()
    assert all(close(got[k][c], want[k][c]) for k in want for c in want[k]), [(k, c, got[k][c], want[k][c]) for k in want for c in want[k] if not close(got[k][c], want[k][c])]
    assert got["known", False]["contest"] is not None and got[None, True]["contest"] is None


def test_report_of_no_rows(spark):
    assert analysis.run_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_results_by_predictions(spark):
    backup = spark.createDataFrame([(1, "present"), (2, "present"), (3, None), (4, "absent"), (4, "absent")], "id long, label string")
    rows = [(1, False, "hi", 0.25), (2, True, "no", 0.0), (3, False, None, None), (4, False, "b", 0.5), (4, True, "a", 0.1), (None, False, "x", 0.0), (9, False, "y", 0.0)]
    got = overlay.with_predictions(backup, spark.createDataFrame(rows, "id long, reject boolean, content string, cer double")).collect()
    assert sorted((r.id, r.content, r.label or "", r.cer) for r in got) == [(1, "hi", "present", 0.25), (2, "", "present", 1.0), (3, "", "", 1.0), (4, "", "absent", 1.0), (4, "", "absent", 1.0)]


def test_percentiles_like_numpy(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.random(), float(rng.randint(0, 3))])) for _ in range(300)] + [("one", 2.5), ("none", None)]
    picks = {"p0": 0.0, "p20": 0.2, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.k: [r[n] for n in picks] for r in ranks.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", picks).collect()}
    for k in ("a", "b", None, "one"):
        assert np.allclose(got[k], np.quantile([v for name, v in rows if name == k and v is not None], list(picks.values())), atol=1e-12)
    assert set(got) == {"a", "b", None, "one"}


def test_regions_and_lengths(spark):
    rng = random.Random(5)
    kinds = ["设备播报", "闲聊/背景", "其他", "空转写", "动作命令"]
    rows = [(rng.random() < 0.4, rng.random() < 0.5, rng.randint(0, 30), rng.choice(kinds), rng.random() < 0.5) for _ in range(500)]
    df = spark.createDataFrame(rows, "present boolean, reject boolean, tl int, primary string, task boolean")
    names = {(True, False): "TP", (True, True): "FR", (False, False): "FA", (False, True): "TN"}
    got = {r.region: r for r in analysis.region_report(df).collect()}
    for key, name in names.items():
        own = [r for r in rows if r[:2] == key]
        tl, r = sorted(x[2] for x in own), got[name]
        share = lambda f: round(sum(map(f, own)) / len(own), 6)
        assert (r.n, r.len_mean, r.len_p50, r.len_p90) == (len(own), round(sum(tl) / len(tl), 6), tl[len(tl) // 2], tl[round(0.9 * (len(tl) - 1))])
        assert (r.task_rate, r.len_ge14, r.chat_or_other, r.tts) == (share(lambda x: x[4]), share(lambda x: x[2] >= 14), share(lambda x: x[3] != "动作命令"), share(lambda x: x[3] == "设备播报"))
    fa, tp = [r for r in rows if r[:2] == (False, False)], [r for r in rows if r[:2] == (True, False)]
    for r in analysis.length_precision(df, (0, 14, 99)).collect():
        a, b = sum(x[2] >= r.len for x in fa), sum(x[2] >= r.len for x in tp)
        assert (r.n_fa_hit, r.n_tp_hit, r.prec_as_neg, r.fa_recall) == (a, b, round(a / (a + b), 6) if a + b else None, round(a / len(fa), 6))


def test_names_of_paths(spark):
    df = spark.createDataFrame([("a/b/c.wav",), ("c.wav",), ("/a/b//",), ("",), (None,)], "p string")
    assert [r[0] for r in df.select(X.basename(F.col("p"))).collect()] == ["c.wav", "c.wav", "b", "", None]
