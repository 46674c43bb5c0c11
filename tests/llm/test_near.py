"""Near duplicates: repeated ids, hot clusters, pivots and hubs."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from gatelight.llm import common, components, jaccard

SCHEMA = "doc_id long, text string, n long, node string, root long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, n, "x", 1) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, k, t):
    """Component (least id) and links of each row; rows without id or words stand alone."""
    sets = []
    for i, x in rows:
        w = (x or "").encode().lower().split()
        s = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.append(s if i is not None else set())
    near = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j])] for i in range(len(rows))]
    groups = [-1] * len(rows)
    for i in range(len(rows)):
        if groups[i] < 0:
            todo, groups[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if groups[j] < 0:
                        groups[j] = i
                        todo.append(j)
    least = {g: min((rows[j][0] for j in range(len(rows)) if groups[j] == g), key=lambda x: (x is None, x)) for g in set(groups)}
    return [(least[g], len(near[i])) for i, g in enumerate(groups)], groups


def rows_with_repeated_ids(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(20, 60))) for _ in range(25)]
    rows = []
    for _ in range(120):
        w = rng.choice(texts).split()
        if rng.random() < 0.6:
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((rng.randint(-3, 40), " ".join(w).upper() if rng.random() < 0.1 else " ".join(w)))
    rows += [rows[0], rows[0], (None, rows[0][1]), (5, None), (5, None), (6, ""), (7, " \n"), (8, "one"), (9, "ONE"), (5, "long " * 4000), (11, "long " * 4001)]
    return rows


def test_repeated_ids_against_brute_force(spark):
    rows = rows_with_repeated_ids(1)
    want, _ = brute(rows, 4, 85)
    got = jaccard.join_components(make(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got if r.doc_id is not None) == sorted((i, c, n) for (i, _), (c, n) in zip(rows, want) if i is not None)
    assert [(r.component_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]


def test_one_row_of_each_component_stays(spark):
    rows = rows_with_repeated_ids(2)
    want, groups = brute(rows, 5, 80)
    docs = make(spark, rows)
    got = jaccard.keep_representatives(docs).collect()
    assert docs.columns == jaccard.keep_representatives(docs).columns
    has_words = [bool((t or "").split()) and i is not None for i, t in rows]
    assert sorted(r.n for r in got if not has_words[r.n]) == [n for n in range(len(rows)) if not has_words[n]]
    kept = [r for r in got if has_words[r.n]]
    assert sorted(groups[r.n] for r in kept) == sorted({g for n, g in enumerate(groups) if has_words[n]})
    assert all(r.doc_id == want[r.n][0] for r in kept)


def test_small_tiles_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):  # one large cluster
        w = list(base)
        w[rng.randrange(60)] = f"x{i % 30}"
        rows.append((i, " ".join(w)))
    want, _ = brute(rows, 4, 85)
    monkeypatch.setattr(jaccard, "TILE_SETS", 20)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join_components(make(spark, rows)).collect()}
    assert [got[i] for i in range(90)] == want


def test_many_alike_sets_in_little_memory():
    rng = np.random.default_rng(0)
    sets = []
    for _ in range(2 * jaccard.TILE_SETS):
        s = np.arange(100, dtype=np.uint64)
        s[rng.integers(0, 100, 3)] = rng.integers(1000, 2**62, 3, dtype=np.uint64)
        sets.append(np.unique(s))
    tracemalloc.start()
    got = jaccard.join_sets(sets, 85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    for x in range(0, len(sets), 97):
        assert got[x].tolist() == [y for y in range(len(sets)) if y != x and 185 * len(np.intersect1d(sets[x], sets[y])) >= 85 * (len(sets[x]) + len(sets[y]))]


def test_pivots_agree_with_plain_counts():
    rng = np.random.default_rng(1)
    for t in (50, 80, 95):
        sets = []
        for c in range(4):
            for _ in range(40):
                s = np.arange(c * 20, c * 20 + 60, dtype=np.uint64)
                n = rng.integers(0, 12)
                s[rng.integers(0, 60, n)] = rng.integers(500, 600, n, dtype=np.uint64)
                sets.append(np.unique(s))
        got = jaccard.join_sets(sets, t)
        for x, a in enumerate(sets):
            assert got[x].tolist() == [y for y, b in enumerate(sets) if y != x and (100 + t) * len(np.intersect1d(a, b)) >= t * (len(a) + len(b))]


def test_components_of_a_hub_and_chains(spark):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 400)] + [(1000 + i, 1001 + i) for i in range(60)] + [(3000, i) for i in range(2000, 2300)] + [(5, 5), (None, 7)]
    rng.shuffle(edges)
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(400)} | {i: 1000 for i in range(1000, 1061)} | {i: 2000 for i in [*range(2000, 2300), 3000]}


def test_tables_can_be_discarded(spark):
    df = common.materialize(spark.range(5))
    assert df.agg(F.sum("id")).first()[0] == 10
    common.discard(df)
    import os
    assert not os.path.exists(df._gl_path.removeprefix("file:"))


def test_one_row_many_times(spark, monkeypatch):
    """Copies of a row, and near copies of it: no group of sets holds more than its classes."""
    rng = random.Random(4)
    words = [rng.choice("abcdefghij") * 3 + str(rng.randrange(1000)) for _ in range(80)]
    near = [" ".join([*words[:i], "new", *words[i + 1 :]]) for i in (0, 79)]
    rows = [(1, " ".join(words))] * 5000 + [(2, near[0]), (3, near[1])]
    seen = jaccard.C.grouped

    def bounded(f):
        def run(t):
            assert "shingles" not in t.column_names or t.num_rows <= 6, t.num_rows
            return f(t)

        return seen(run)

    monkeypatch.setattr(jaccard.C, "grouped", bounded)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert got == {1: (1, 5001), 2: (1, 5001), 3: (1, 5001)}


def test_parities_differ_no_more_than_sets():
    """Linked sets pass; sets without anything in common, which may share a part by chance, don't."""
    rng = np.random.default_rng(5)
    for t in (50, 80, 85):
        parts = jaccard.Parts(t, None)
        for n in (1, 2, 7, 40, 200, 3000):
            x = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            for change in (0, 1, n // 20, n // 10, n // 5, n):
                y = np.unique(np.concatenate((x[change:], rng.integers(0, 2**63, int(rng.integers(0, change + 1)), dtype=np.uint64))))
                if not len(y):
                    continue
                both = len(np.intersect1d(x, y))
                (low, a), (high, b) = sorted(((parts.interval(len(s)), s) for s in (x, y)), key=lambda p: p[0])
                if (100 + t) * both >= t * (len(x) + len(y)):
                    assert high - low <= 1
                    pair = [parts.parities(a)[high - low]], [parts.parities(b)[0]]
                    assert jaccard.may_link(*pair, [len(a)], [len(b)], t).all()
            if n >= 40:
                y = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                assert not jaccard.may_link(parts.parities(x)[:1], parts.parities(y)[:1], [n], [n], 80).any()
    assert jaccard.may_link([None, b"\0"], [b"\1", b"\1\0"], [5, 5], [5, 5], 80).all()  # of another size, or not known


def test_no_cluster_by_a_common_passage(spark, monkeypatch):
    """Texts that share a passage, but little else, share parts by chance; their sets aren't sent."""
    rng = random.Random(6)
    rows = []
    for group in range(6):
        passage = [f"p{group}x{i}" for i in range(22)]
        for i in range(8):
            rows.append((len(rows), " ".join([f"r{rng.randrange(10**9)}" for _ in range(20)] + passage + [f"r{rng.randrange(10**9)}" for _ in range(20)])))
    rows.append((100, rows[0][1] + " more"))
    want, _ = brute(rows, 5, 80)
    sent, real = [], common.materialize

    def counted(df):
        out = real(df)
        if "places" in df.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard.C, "materialize", counted)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard.join_components(make(spark, rows), k=5, t=80).collect()}
    assert [got[i] for i, _ in rows] == want and got[100] == (0, 1)
    assert sent == [2]


def test_parts_of_many_sets_are_chained(spark, monkeypatch):
    """Beyond the bound of paired sets, signatures join as before, whatever the parities."""
    rows = rows_with_repeated_ids(7)
    want, _ = brute(rows, 5, 80)
    for bound in (1, 3):
        monkeypatch.setattr(jaccard, "PAIRED_SETS", bound)
        got = jaccard.join_components(make(spark, rows), k=5, t=80).collect()
        assert sorted((r.doc_id, r.component_id, r.n_links) for r in got if r.doc_id is not None) == sorted((i, c, n) for (i, _), (c, n) in zip(rows, want) if i is not None)


def test_shuffle_files_go_with_their_query(spark):
    def files():
        return {f.getName() for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}

    before = files()
    df = common.materialize(spark.range(10_000).repartition(4).groupBy(F.col("id") % 7).count())
    assert not files() - before
    assert df.count() == 7 and spark.conf.get(common.CLEANUP, None) is None
