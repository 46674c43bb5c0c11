"""Substring dedup against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from gatelight.llm import substrings

SCHEMA = "doc_id long, text string, KEPT string, n_removed string, other array<int>"


def brute(rows, k):
    """(id, text) rows to (n_words, removed places) by the definition."""
    words = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for p in range(len(w) - k + 1):
            key = tuple(w[p : p + k])
            if i is not None:
                least[key] = min(least.get(key, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = {q for p in range(len(w) - k + 1) if tuple(w[p : p + k]) in least and (i is None or least[tuple(w[p : p + k])] < i) for q in range(p, p + k)}
        out.append((len(w), gone, b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    return out


def rows_of(seed, n=60, vocabulary=40):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 40))] for _ in range(8)]
    texts = []
    for _ in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(t))
            t[at:at] = rng.choice(passages)
        texts.append(rng.choice([" ", "\n", "  "]).join(t))
    texts += ["a " * 60, "a " * 40, "a b " * 30, None, "", " \t", "é " * 3000, texts[0], texts[1]]
    ids = [rng.randint(-5, 40) if rng.random() < 0.9 else None for _ in texts]
    return [*zip(ids, texts), (3, texts[2]), (3, texts[2]), (3, texts[2] + " and more"), (None, texts[2])]


@pytest.mark.parametrize(("k", "hot", "blocks"), [(13, 50_000, 6 << 20), (13, 0, 500), (9, 3, 900), (5, 50_000, 300), (1, 50_000, 400), (120, 50_000, 5000)])
def test_against_brute_force(spark, monkeypatch, k, hot, blocks):
    monkeypatch.setattr(substrings, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(substrings, "GROUP_SUFFIXES", 200)
    monkeypatch.setattr(substrings, "GROUP_ANCHORS", 200)
    monkeypatch.setattr(substrings, "PREFIX_SUFFIXES", 20)
    rows = rows_of(k + hot % 7)
    docs = spark.createDataFrame([(i, t, str(n), "x", [n]) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(4)
    got = {r.other[0]: r for r in substrings.mark_repeats(docs, min_words=k, hot_prefix=hot).collect()}
    assert len(got) == len(rows)
    for n, ((i, t), (n_words, gone, kept)) in enumerate(zip(rows, brute(rows, k))):
        r = got[n]
        assert (r.doc_id, r.text, r.n_words, r.n_removed, r.kept) == (i, t, n_words, len(gone), kept)
        assert {q for s in r.removed for q in range(s.start, s.end)} == gone and all(a.end < b.start for a, b in zip(r.removed, r.removed[1:]))


@pytest.mark.parametrize(("hot", "blocks"), [(50_000, 6 << 20), (0, 500)])
def test_blocks_come_in_any_order(spark, monkeypatch, hot, blocks):
    """Each read of a block may give its rows in another order, as fetches from several executors do."""

    def mixed(t):
        return t.take(pa.array(np.random.default_rng().permutation(t.num_rows)))

    def one(f):
        return lambda t: f(mixed(t))

    def two(f):
        return lambda t, back: f(mixed(t), mixed(back))

    monkeypatch.setattr(substrings, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(substrings.C, "grouped", one)
    monkeypatch.setattr(substrings.C, "cogrouped", two)
    rows = rows_of(3)
    docs = spark.createDataFrame([(i, t, str(n), "x", [n]) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(4)
    got = {r.other[0]: r for r in substrings.mark_repeats(docs, hot_prefix=hot).collect()}
    for n, ((i, t), (n_words, gone, kept)) in enumerate(zip(rows, brute(rows, 13), strict=True)):
        assert (got[n].doc_id, got[n].text, got[n].n_words, got[n].n_removed, got[n].kept) == (i, t, n_words, len(gone), kept)


def test_internal_nodes():
    """Suffixes part at the depth of their common prefix; windows before the anchor tell classes apart."""
    words = np.array([ord(c) for c in "xabcdyabcdxabce"], np.uint64)
    before, n, k = np.array([1, 1, 1]), np.array([2, 2, 2]), 4
    tree = substrings.Tree(words, before, n, k)
    assert sorted(tree.common.tolist()) == [0, 3, 4]
    assert len(set(tree.nodes(4).tolist())) == 2 and len(set(tree.nodes(3).tolist())) == 1
    order, at = tree.classes(np.arange(3), 3, 1)
    assert np.diff(np.append(at, 3)).tolist() == [2, 1]  # x|abc twice, y|abc once


def test_compression_round_trip():
    for x in (None, b"", b"a", b"ab" * 500, bytes(range(256))):
        assert substrings.inflate(substrings.deflate(x)) == x
