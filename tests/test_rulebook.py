"""Rule cubes and fusion tables against plain evaluation of every rule."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelight.operators import calibrate as K
from gatelight.operators import cube as B
from gatelight.operators import fusion as U
from gatelight.operators import rules as R
from gatelight.plans import rulebook


def rates(rejected, present):
    rr = (rejected & ~present).sum() / max(1, (~present).sum()) if (~present).any() else 1.0
    frr = (rejected & present).sum() / max(1, present.sum())
    return round(float(rr), 9), round(float(frr), 9), round(float(0.5 * rr + 0.5 * (1 - frr)), 9)


def text_rows(n, seed):
    rng = random.Random(seed)
    classes = ["设备播报", "闲聊/背景", "其他", "空转写", "动作命令", "信息询问"]
    rows = []
    for _ in range(n):
        margin, c = round(rng.uniform(-0.3, 0.5), 2), rng.choice(classes)
        rows.append((rng.random() < 0.4, margin < 0, margin, c, rng.randint(0, 30), c in ("动作命令", "信息询问")))
    return rows


def wanted(kind, delta, length, m, c, n, task):
    gray, tts, chat, long = (m >= 0) & (m <= delta), c == "设备播报", np.isin(c, ["闲聊/背景", "其他", "空转写"]), n >= length
    return {
        "tts_anywhere": tts, "tts_gray": gray & tts, "len_gray": gray & long, "nontask_gray": gray & ~task, "chat_gray": gray & chat, "len_or_nontask_gray": gray & (long | ~task),
        "len_and_nontask_gray": gray & long & ~task, "len_or_chat_gray": gray & (long | chat), "len_and_chat_gray": gray & long & chat, "len_anywhere": long,
        "len_gray_or_tts": tts | (gray & long), "len_or_chat_gray_or_tts": tts | (gray & (long | chat)),
    }[kind]


def test_text_rules_against_every_rule(spark):
    rows = text_rows(800, 1)
    deltas, lengths = (0.0, 0.05, 0.1, 0.2), (0, 5, 16, 40)
    df = spark.createDataFrame(rows, "present boolean, reject boolean, m double, c string, n int, task boolean")
    rules = spark.createDataFrame([(k, x, n) for k in rulebook.KINDS for x in deltas for n in lengths], "kind string, delta double, len int")
    axes = R.text_axes(F.col("m"), F.col("c"), F.col("n"), F.col("task"), deltas, lengths)
    got = B.rule_metrics(df, axes, rules, ["kind", "delta", "len"], R.text_boxes(F.col("kind"), F.col("delta"), F.col("len"))).collect()
    assert len(got) == len(rulebook.KINDS) * 16
    present, reject, m, c, n, task = (np.array(x) for x in zip(*rows))
    for r in got:
        assert (r.rr, r.frr, r.contest) == rates(reject | wanted(r.kind, r.delta, r.len, m, c, n, task), present), r


def test_ten_thousand_rules_in_one_pass(spark):
    """The rows are read once, whatever the number of rules, and are never joined with them."""
    d = "/root/testdata/sf0.1"
    rules = len(rulebook.KINDS) * len(rulebook.DELTAS) * len(rulebook.LENGTHS)
    assert rules > 10_000
    out = rulebook.text_rule_grid(spark, d)
    assert out.count() == rules
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [doc_id") == 2  # texts in ASCII and others
    axes = R.text_axes(F.col("score") - F.col("thr"), F.col("primary"), F.col("tl"), F.col("task"), rulebook.DELTAS, rulebook.LENGTHS)
    assert B.cells(rulebook._classed(spark, d), axes, {"n": F.lit(1)}).count() <= 2 * 2 * 31 * 31 * 8


def test_boxes_with_open_and_null_sides(spark):
    rows = [(None if i % 7 == 0 else float(i % 10), i % 3, i % 2 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "x double, y int, present boolean")
    axes = [B.Axis("x", (2.0, 4.0, 8.0), lambda c: F.col("x") >= c), B.Axis("y", (1, 2), lambda c: F.col("y") >= c)]
    rules = spark.createDataFrame([(1, 2.0, 8.0), (2, None, 4.0), (3, 4.0, None), (4, None, None)], "k int, low double, high double")
    got = {r.k: (r.n, r.all_n) for r in B.answer(df, axes, rules, ["k"], [B.Box({"x": (F.col("low"), F.col("high")), "y": (F.lit(1), None)}, F.col("k") < 4)], {"n": F.lit(1)}).collect()}
    at = lambda x, low, high: (low is None or (x is not None and x >= low)) and (high is None or not (x is not None and x >= high))
    want = {k: (sum(at(x, low, high) and y >= 1 for x, y, _ in rows), 200) for k, low, high in ((1, 2.0, 8.0), (2, None, 4.0), (3, 4.0, None))}
    assert got == {**want, 4: (0, 200)}


def test_unknown_cuts_are_refused(spark):
    df = spark.createDataFrame([(1.0, True)], "x double, present boolean")
    rules = spark.createDataFrame([(3.0,)], "low double")
    with pytest.raises(Exception, match="no cut of x"):
        B.answer(df, [B.Axis("x", (1.0,), lambda c: F.col("x") >= c)], rules, ["low"], [B.Box({"x": (F.col("low"), None)})], {"n": F.lit(1)}).collect()


def test_cube_of_no_rows(spark):
    df = spark.createDataFrame([], "x double, present boolean")
    rules = spark.createDataFrame([(1.0,)], "low double")
    got = B.rule_metrics(df, [B.Axis("x", (1.0,), lambda c: F.col("x") >= c)], rules, ["low"], [B.Box({"x": (F.col("low"), None)})]).collect()
    assert [tuple(r) for r in got] == [(1.0, 1.0, 0.0, 1.0)]


def test_thresholds_over_the_range_of_scores(spark):
    rows = [("a", 0.1 + 0.003 * i, i % 3 > 0) for i in range(50)] + [("b", 7.0, True)] * 3 + [("c", 2.0, True), ("c", 2.004, False)]
    df = spark.createDataFrame(rows, "k string, score double, present boolean")
    got = {}
    for r in K.candidates(df, ["k"], ranged=True).collect():
        got.setdefault(r.k, set()).add(round(r.thr, 6))
    for k in "abc":
        s = [x for name, x, _ in rows if name == k]
        lo, hi = min(s), max(s)
        step = max((hi - lo) / 200, 1e-4)
        even = {round(lo + i * step, 6) for i in range(int((hi - lo + 1e-12) / step) + 1)}
        assert got[k] == {round(x, 6) for x in s} | even | {round(-0.5 + 0.01 * i, 6) for i in range(201)}


# ---- fusion ----
def drawn(s, most):
    s = np.asarray(s)
    both = np.unique(np.concatenate((np.unique(np.round(s, 6)), np.round(s.min() + np.arange(201) * ((s.max() - s.min()) / 200), 6) if s.max() > s.min() else [s.min()])))
    if len(both) <= most:
        return both
    half = most // 2
    at = np.arange(half) / (half - 1) * (len(s) - 1)
    o = np.sort(np.round(s, 6))
    lo, hi = o[np.floor(at).astype(int)], o[np.ceil(at).astype(int)]
    return np.unique(np.concatenate((np.round(lo + (hi - lo) * (at - np.floor(at)), 6), both[:: max(1, len(both) // half)])))


def scored(spark, seed, n, key):
    rng = np.random.default_rng(seed)
    present = rng.random(n) < 0.4
    s1, s2 = np.round(rng.normal(0.4 * present, 0.3), 6), np.round(rng.normal(0.3 * present, 0.4), 6)
    rows = [(key, float(a), float(b), bool(p)) for a, b, p in zip(s1, s2, present)]
    return s1, s2, present, rows


@pytest.mark.parametrize("most", [30, 60, 1000])
def test_thresholds_drawn_from_scores(spark, most):
    s1, _, _, rows = scored(spark, 3, 500, "a")
    df = spark.createDataFrame(rows + [("b", 0.5, 0.0, True)] * 3 + [("c", None, 0.0, True)], "key string, score double, s2 double, present boolean")
    got = {}
    for r in U.drawn(df, ["key"], F.array(F.lit(most))).collect():
        got.setdefault(r.key, []).append(r.thr)
    assert sorted(got) == ["a", "b"] and got["b"] == [0.5]
    assert np.allclose(np.sort(got["a"]), drawn(s1, most), atol=1.1e-6) and len(got["a"]) == len(drawn(s1, most))


def best_of(s1, s2, present, mode, tps, tss, margins):
    best = None
    for tp in tps:
        for m in margins:
            for ts in tss:
                accept = {"or": (s1 >= tp) | (s2 >= ts), "and": (s1 >= tp) & (s2 >= ts), "gray": (s1 >= tp) | ((s1 >= tp - m) & (s2 >= ts))}[mode]
                rr, frr = (~accept & ~present).sum() / (~present).sum(), (~accept & present).sum() / present.sum()
                c = round(0.5 * rr + 0.5 * (1 - frr), 12)
                if best is None or c > best[0]:
                    best = (c, tp, ts, m if mode == "gray" else None)
    return best


def test_fusion_against_every_rule(spark):
    rows, want = [], {}
    margins = [0.0, 0.05, 0.3]
    for key in "ab":
        s1, s2, present, own = scored(spark, ord(key), 300, key)
        rows += own
        for mode, n1, n2, m in (("or", 16, 16, [0.0]), ("and", 16, 16, [0.0]), ("gray", 14, 12, margins)):
            want[key, mode] = best_of(s1, s2, present, mode, drawn(s1, n1), drawn(s2, n2), m)
    df = spark.createDataFrame(rows + [("a", None, 1.0, True), ("a", 1.0, None, False)], "key string, s1 double, s2 double, present boolean")
    got = {(r.key, r.mode): (round(r.contest, 9), r.thr, r.second, r.margin) for r in U.fuse_pairs(df, ["key"], margins, (16, 14, 12)).collect()}
    assert got == {k: (round(v[0], 9), *v[1:]) for k, v in want.items()}


def test_fusion_at_full_size(spark):
    """300 x 250 thresholds and 31 margins: the rule found is at least as good as any of 20,000 drawn at random."""
    s1, s2, present, rows = scored(spark, 9, 4000, "a")
    df = spark.createDataFrame(rows, "key string, s1 double, s2 double, present boolean")
    margins = [round(0.01 * i, 6) for i in range(31)]
    got = {r.mode: r for r in U.fuse_pairs(df, ["key"], margins).collect()}
    tps, tss = drawn(s1, 300), drawn(s2, 250)
    assert len(tps) > 250 and len(tss) > 200
    g = got["gray"]
    accept = (s1 >= g.thr) | ((s1 >= g.thr - g.margin) & (s2 >= g.second))
    assert rates(~accept, present) == (g.rr, g.frr, g.contest)
    rng = random.Random(1)
    for _ in range(20_000):
        tp, ts, m = rng.choice(tps), rng.choice(tss), rng.choice(margins)
        accept = (s1 >= tp) | ((s1 >= tp - m) & (s2 >= ts))
        assert rates(~accept, present)[2] <= g.contest + 1e-9
    for mode in ("or", "and"):
        r = got[mode]
        accept = (s1 >= r.thr) | (s2 >= r.second) if mode == "or" else (s1 >= r.thr) & (s2 >= r.second)
        assert rates(~accept, present) == (r.rr, r.frr, r.contest)


def test_quantiles_are_one_pass(spark):
    """No frame that shrinks row by row: Spark reads such a one anew for each row."""
    rows = spark.createDataFrame([("k", i / 997) for i in range(900)] + [("m", 0.5)], "key string, score double")
    got = U.drawn(rows, ["key"], F.array(F.lit(40)))
    assert "currentrow$(), unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    thr = {r.thr for r in got.where("key = 'k'").collect()}
    assert {round(float(x), 6) for x in np.quantile([round(i / 997, 6) for i in range(900)], np.linspace(0, 1, 20))} <= thr
