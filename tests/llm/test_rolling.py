"""Rolling median and MAD against sorting each window, thin and dense chunks alike, and odd input."""

import datetime
import random

import numpy as np
import pytest

from gatelight.llm import rolling

SCHEMA = "click_id long, ts timestamp_ntz, kind string, value double, N string, far string"
START = datetime.datetime(2024, 3, 31, 1, 50)  # over a change of clocks in many zones


def brute(rows, width):
    """{id: (series, n, median2, mad4, far)}, of each id the least row."""
    flat = {}
    for i, ts, kind, value in rows:
        if ts is not None:
            c = None if value is None or not abs(value) < 1e15 else int(np.floor(100 * value + 0.5))
            us = (ts - START) // datetime.timedelta(microseconds=1)
            new = (us, kind, c)
            key = lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or 0)
            flat[i] = min(flat.get(i, new), new, key=key)
    out = {}
    for i, (t, kind, own) in flat.items():
        w = sorted(c for u, k, c in flat.values() if k == kind and t - width < u <= t and c is not None)
        n = len(w)
        if not n:
            out[i] = (kind, 0, None, None, None)
            continue
        m = w[(n - 1) // 2] + w[n // 2]
        d = sorted(abs(2 * c - m) for c in w)
        q = d[(n - 1) // 2] + d[n // 2]
        out[i] = (kind, n, m, q, None if own is None else 2 * abs(2 * own - m) > 2 * q)
    return out


def clicks(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA).repartition(3)


def random_rows(seed, n, hours=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = START + datetime.timedelta(microseconds=rng.choice([rng.randrange(hours * 3_600_000_000), rng.randrange(50) * 300_000_000, 900_000_000 * rng.randrange(8)]))
        value = rng.choice([None, 0.005, -0.005, 1.0, rng.uniform(0, 500), rng.uniform(0, 500), rng.uniform(0, 500), rng.uniform(-1e9, 1e9)])
        rows.append((i, ts, rng.choice([None, "", "view", "view", "view", "click"]), value))
    return rows


def got(df):
    rows = df.collect()
    out = {r.id: (r.series, r.n, r.median2, r.mad4, r.far) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("seed", range(20))
def test_sweep_against_sorting(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(rolling, "BLOCK", rng.choice([3, 16, 256]))
    monkeypatch.setattr(rolling, "DIGIT", rng.choice([2, 16, 1024]))
    n, width, spread = rng.randint(1, 80), rng.randint(1, 60), rng.choice([3, 1000, 10**6])
    t = np.array(sorted(rng.randint(0, 100) for _ in range(n)))
    c = np.array([rng.randint(-spread, spread) if rng.random() < 0.9 else rng.randint(-(10**12), 10**12) for _ in t])
    both, order = np.concatenate((t, t + width)), np.argsort(np.concatenate((t, t + width)), kind="stable")
    change = np.concatenate((np.ones(n), -np.ones(n)))
    found = rolling.sweep(both[order], np.concatenate((c, c))[order], change[order], np.arange(170))
    for at in range(170):
        w = sorted(int(x) for u, x in zip(t, c) if at - width < u <= at)
        k = len(w)
        m = w[(k - 1) // 2] + w[k // 2] if k else 0
        d = sorted(abs(2 * x - m) for x in w)
        assert [int(x[at]) for x in found] == [k, m, d[(k - 1) // 2] + d[k // 2] if k else 0]


@pytest.mark.parametrize("dense,windows", [(1 << 16, 24), (40, 3), (5, 1)])
def test_rolling_against_brute_force(spark, dense, windows):
    rows = random_rows(dense, 700)
    rows += rows[:40]  # repeated rows
    rows += [(5, START, "zz", 3.0), (5, None, "view", 1.0), (900, None, "view", 1.0), (901, START, "lone", None), (902, START, "nan", float("nan")), (903, START, "inf", float("inf"))]
    found = got(rolling.rolling_mad(clicks(spark, rows), dense=dense, chunk_windows=windows))
    assert found == brute(rows, 900_000_000)


def test_one_instant_with_most_rows(spark):
    """A time that a third of all rows share is merged by value, and its rows are dealt by a join."""
    rows = [(i, START, "view", float(i % 7)) for i in range(3000)] + random_rows(3, 300)[:300]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    assert got(rolling.rolling_mad(clicks(spark, rows), dense=100, chunk_windows=2)) == brute(rows, 900_000_000)


def test_runs_of_a_dense_chunk_are_bounded(spark, monkeypatch):
    """A group has as many changes as the bound and one unit's, beside one row for each value that it begins with."""

    def bounded(t):
        from gatelight.llm.rolling import _run

        assert t.num_rows <= 100 + 2 + 40, t.num_rows
        return _run(t)

    rows = [(i, START + datetime.timedelta(seconds=i), "view", float(i % 40)) for i in range(4000)]
    want = brute(rows, 900_000_000)
    monkeypatch.setattr(rolling, "_run", bounded)
    assert got(rolling.rolling_mad(clicks(spark, rows), dense=100, chunk_windows=2)) == want


def test_no_rows(spark):
    assert got(rolling.rolling_mad(clicks(spark, []))) == {}
    assert got(rolling.rolling_mad(clicks(spark, [(1, None, "a", 1.0)]))) == {}


def test_zones_do_not_matter(spark):
    rows = random_rows(9, 200)
    want = brute(rows, 900_000_000)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        assert got(rolling.rolling_mad(clicks(spark, rows))) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
