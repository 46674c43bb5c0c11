"""Benchmark decontamination against tiling every pair by brute force."""

import math
import random
import re

import numpy as np
import pytest

from gatelight.llm import decontam


def words_of(t):
    t = re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "")
    return [w for w in ("".join(c for c in x if ord(c) > 127 or c.isalnum()) for x in t.split()) if w]


def brute_tiles(doc, item, least):
    """Longest common runs of unmarked words, one at a time: longest, then first in the item, then in the document."""
    fd, fi, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and j + n < len(item) and fd[p + n] and fi[j + n] and doc[p + n] == item[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, j, p)
        if best is None:
            return sorted((j, n) for n, j, _ in tiles)
        n, j, p = best
        fd[p : p + n] = [False] * n
        fi[j : j + n] = [False] * n
        tiles.append(best)


def cases(seed):
    rng = random.Random(seed)
    common = ["which", "of", "the", "following", "is", "right"]
    items = [[*common, *[f"v{rng.randint(0, 60)}" for _ in range(rng.randint(4, 30))]] for _ in range(14)]
    items += [items[0], ["too", "short"], [f"z{i % 7}" for i in range(30)], common]
    docs = []
    for _ in range(40):
        d = [f"v{rng.randint(0, 60)}" for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 2)):
            w = list(rng.choice(items))
            cut = rng.randint(0, len(w))
            w = rng.choice([w, w[cut:] + ["noise"] + w[:cut], w[: cut + 5], [x.upper() + "," for x in w]])
            at = rng.randint(0, len(d))
            d[at:at] = w
        docs.append(" ".join(d))
    docs += [docs[3], docs[3], None, "", " .. !! ", "z0 " * 50, " ".join(f"z{i % 7}" for i in range(300)), " ".join(common)]
    return docs, [" ".join(i) for i in items]


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.5), (2, 0.3), (3, 0.9)])
def test_against_brute_force(spark, seed, threshold):
    docs, items = cases(seed)
    ids = [n // 2 if n % 9 else None for n in range(len(docs))]
    rows = spark.createDataFrame([(i, t, "c", 1.0) for i, t in zip(ids, docs)], "doc_id long, text string, item_id string, coverage double").repartition(3)
    bench = spark.createDataFrame([*[(n if n != 4 else None, t, "x") for n, t in enumerate(items)], (2, items[2], "y"), (50, None, "z"), (51, "", "")], "item_id long, text string, key string")
    want, dirty = [], set()
    for n, t in enumerate(docs):
        for m, i in enumerate(items):
            iw = words_of(i)
            if len(iw) >= 5:
                tiles = brute_tiles(words_of(t), iw, 5)
                if tiles and sum(x for _, x in tiles) / len(iw) >= threshold:
                    want.append((ids[n], m if m != 4 else None, sum(x for _, x in tiles), tiles))
                    dirty.add(n)
    got = decontam.contaminated_pairs(rows, bench, threshold=threshold).collect()
    found = [(r.doc_id, r.item_id, sum(x.length for x in r.tiles), sorted((x.item_start, x.length) for x in r.tiles)) for r in got]
    assert sorted((str(a), str(b), c) for a, b, c, _ in found) == sorted((str(a), str(b), c) for a, b, c, _ in want)
    assert all(r.n_tiles == len(r.tiles) for r in got)
    kept = decontam.decontaminate(rows, bench, threshold=threshold)
    assert kept.columns == rows.columns
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(str, [(ids[n], docs[n]) for n in range(len(docs)) if n not in dirty]))


def test_empty_benchmark_and_empty_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated_pairs(docs, none).count() == 0 and decontam.decontaminate(docs, none).count() == 2
    assert decontam.contaminated_pairs(docs.limit(0), docs.withColumnRenamed("doc_id", "item_id")).count() == 0


def test_no_covered_item_has_fewer_matching_places():
    rng = random.Random(0)
    for _ in range(200):
        lengths = [rng.randint(5, 30) for _ in range(rng.randint(1, 6))]
        total = sum(lengths) + rng.randint(0, sum(lengths))
        if sum(lengths) >= 0.5 * total:
            assert sum(n - 4 for n in lengths) >= max(1, math.ceil(total * 0.5 / 5 - 1e-9))


def test_tiles_of_random_texts():
    rng = random.Random(7)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 40))] for _ in range(2))
        code = lambda s: np.array([ord(c) for c in s], np.uint64)
        got = decontam.greedy_tiles(code(a), code(b), 3)
        for p, j, n in got:
            assert a[p : p + n] == b[j : j + n] and n >= 3
        assert sorted((j, n) for _, j, n in got) == brute_tiles(a, b, 3)
