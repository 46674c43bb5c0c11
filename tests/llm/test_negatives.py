"""Hard negatives against brute force, pruning by the balls, and odd input."""

import numpy as np
import pytest

from gatelight.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def brute(rows, is_anchor, k=5, m=3, low=50, high=95):
    by = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        v = [float(np.floor(256 * float(np.float32(x)))) for x in v]
        if max(map(abs, v), default=0) < negatives.LARGEST:
            by[i] = min(by.get(i, (label, v)), (label, v))
    out = set()
    for a, (label, q) in by.items():
        if not is_anchor(a):
            continue
        score = {i: int(np.dot(q, v)) for i, (_, v) in by.items() if len(v) == len(q) and i != a}
        best = lambda ids, n: sorted(ids, key=lambda i: (-score[i], i))[:n]
        for p in best([i for i in score if by[i][0] == label], k):
            fits = [i for i in score if by[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out |= {(a, p, rank, i, score[p], score[i]) for rank, i in enumerate(best(fits, m), 1)}
    return out


def check(spark, rows, every=10, **how):
    df = frame(spark, rows)
    got = [tuple(r) for r in negatives.hard_negatives(df, df.where(f"vec_id % {every} = 0"), **how).collect()]
    assert len(got) == len(set(got))
    want = brute(rows, lambda i: i % every == 0)
    assert set(got) == want
    return want


def vectors(seed, n, d=16, labels=4, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d)) * 0.3
    if clusters:
        x = rng.standard_normal((clusters, d))[rng.integers(0, clusters, n)] + 0.05 * x
    return [(i, [float(f) for f in v], int(rng.integers(0, labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("how", [{}, {"shard_bytes": 8000}, {"shard_bytes": 8000, "block_bytes": 2000}])
def test_against_brute_force(spark, how):
    assert check(spark, vectors(1, 600), **how)


def test_many_and_negative_labels(spark):
    rows = [(i, v, label * 1000 - 70) for i, v, label in vectors(2, 400, labels=150)]
    rows += [(i + 1000, v, -3) for i, v, _ in vectors(3, 60)]
    assert check(spark, rows)


def test_copies_and_ties(spark):
    """Groups of equal vectors: ties go to smaller ids, over shards and leaves."""
    base = vectors(4, 12, clusters=0)
    rows = [(i, base[i % 12][1], i % 5) for i in range(700)]
    assert check(spark, rows, shard_bytes=10_000)


def test_odd_rows(spark):
    rows = vectors(5, 120)
    rows += [(200, None, 1), (210, [], 1), (211, [], 2), (220, [None] * 16, 1), (230, [float("nan")] * 16, 1), (240, [float("inf")] * 16, 2), (250, [1e30] * 16, 1), (None, rows[0][1], 1)]
    rows += [(260, rows[0][1], None), (270, [0.0] * 16, 1), (280, [0.1, 0.2], 1), (281, [0.1, 0.2], 1), (282, [0.09, 0.2], 2), (290, [0.5], 3), *rows[:20]]
    rows += [(0, rows[1][1], 0), (0, rows[2][1], 3)]  # one id, different rows: the least counts
    assert check(spark, rows)


def test_empty_tables(spark):
    some = frame(spark, vectors(6, 20))
    none = some.where("vec_id < 0")
    for rows, anchors in ((none, none), (some, none), (none, some)):
        assert negatives.hard_negatives(rows, anchors).collect() == []


def test_balls_prune():
    """In 40 clusters about half of the rows are never multiplied (measured: 49 %), and the results stay exact."""
    rows = vectors(7, 4000, clusters=40)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    ids, labels = np.arange(4000), np.array([label for _, _, label in rows])
    tree = negatives.BallTree(ids, labels, x)
    for node, (a, b) in enumerate(zip(tree.begin, tree.end)):
        off = np.sqrt(np.square(tree.x[a:b] - tree.centres[node]).sum(axis=1))
        assert off.max() <= tree.radii[node] * (1 + 1e-12)
    ask = np.arange(0, 4000, 40)
    s = (x[ask] @ x.T).astype(np.int64)
    top = s.max(axis=1).astype(float)[:, None]
    best, _ = tree.search(x[ask], ids[ask], labels[ask], 0.5 * top, 0.9 * top, 3, False)
    assert tree.visited < 0.55 * 4000 * len(ask)
    for i in range(len(ask)):
        fits = (labels != labels[ask[i]]) & (s[i] >= 0.5 * top[i]) & (s[i] <= 0.9 * top[i])
        want = np.sort(s[i][fits])[::-1][:3]
        assert (best[i, 0][: len(want)] == want).all()
