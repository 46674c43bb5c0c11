"""Capped water-filling and the mix against plain Python, and odd input."""

import random
import re
from fractions import Fraction

import pytest

from gatelight.llm import mixing

SCHEMA = "doc_id long, text string, source string, Size string, cell string, place string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "s", "c", "p") for r in rows], SCHEMA).repartition(3)


def levels(sizes, weights, most):
    """Exact targets: clamp what is over its cap, deal the rest by weight, until none is above."""
    total, clamped = sum(sizes), set()
    while True:
        free = sum(w for i, w in enumerate(weights) if i not in clamped)
        left = total - sum(most * sizes[i] for i in clamped)
        over = {i for i, w in enumerate(weights) if i not in clamped and Fraction(left * w, free) > most * sizes[i]}
        if not over:
            return [Fraction(most * s) if i in clamped else Fraction(left * w, free) for i, (s, w) in enumerate(zip(sizes, weights))]
        clamped |= over


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(spark, rows, **how):
    got = mixing.mix(docs(spark, rows), **how).collect()
    assert len(got) == len(rows)
    own = {}
    for r in rows:
        own[r[2]] = own.get(r[2], 0) + words(r[1])
    order = sorted((s for s in own if s is not None), key=lambda s: s.encode()) + ([None] if None in own else [])
    weights = how.get("weights", (1, 2, 3))
    most = how.get("max_epochs", 3)
    targets = dict(zip(order, levels([own[s] for s in order], [weights[i % len(weights)] for i in range(len(order))], most)))
    taken, n = {}, {}
    for r in got:
        assert r["size"] == words(r.text) and r.source_size == own[r.source]
        assert r.target == pytest.approx(float(targets[r.source]), rel=1e-12)
        assert 0 <= r.taken <= most * r["size"] and r.whole * r["size"] <= r.taken
        taken[r.source] = taken.get(r.source, 0) + r.taken
        n[r.source] = n.get(r.source, 0) + 1
    for s in order:
        assert abs(taken[s] - targets[s]) <= n[s] / mixing.CELLS * 4 + 4  # a word for each document of a group
    return {(r.doc_id, r.text): r.taken for r in got}


def test_random_sources(spark):
    rng = random.Random(2)
    names = [None, "", "b", "a", "é", "z", "\U0001f600", "￿", "hot", "hot", "hot", "hot"]
    rows = [(i, "w " * rng.choice([1, 5, 30, 400]), rng.choice(names)) for i in range(900)]
    first = check(spark, rows)
    assert check(spark, rows[::-1]) == first  # reruns and layouts agree
    check(spark, rows, weights=(5,), max_epochs=2)


def test_clamping_goes_on(spark):
    """Each round of clamping brings the next source over its cap."""
    rows = [(i, "w " * n, f"s{i:02}") for i, n in enumerate([1, 2, 4, 8, 16, 32, 64, 1000])]
    check(spark, rows)
    check(spark, rows, weights=(1,))


def test_odd_rows(spark):
    long = "word " * 300_000
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, long, "big"), (4, long, "big"), (4, "x y", "big"), (None, "p q r", "b"), (None, "p q r", "b"), (5, "nbsp word z\x0by", "a")]
    check(spark, rows)


def test_empty_tables(spark):
    assert mixing.mix(docs(spark, [])).collect() == []
    got = mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_columns_are_kept(spark):
    out = mixing.mix(docs(spark, [(1, "a b", "s")]))
    assert out.columns == ["doc_id", "text", "source", "cell", "place", "size", "source_size", "target", "whole", "taken"]
    assert out.first().cell == "c"


def test_no_python(spark):
    plan = mixing.op12_mixing(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
