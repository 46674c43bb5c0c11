"""Corpus operators against brute force and on odd input: nulls, empty and long texts, ties, repeats,
empty tables, clashing columns."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatelight.llm import ann, bpe, chat, components, decontam, jaccard, licenses, quality, substrings, toxicity, urls

DOCS = "doc_id long, text string, kept string, score string, n_tokens string, host string"


def make_docs(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "k", "s", "n", "h") for i, t in zip(ids, texts)], DOCS).repartition(3)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 80))) for _ in range(n)]
    for i in range(0, n, 4):  # near copies
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts += [f"{texts[0]} {passage} {texts[1]}", f"x y {passage}", passage, texts[3], texts[3]]
    return [*texts, None, "", " \t\n", "one", "one", "a b c", "A B C", "é " * 5000, "q " * 40]


def sets_of(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def test_jaccard_against_brute_force(spark):
    texts = corpus()
    got = {r.doc_id: r for r in jaccard.join_components(make_docs(spark, texts)).collect()}
    sets = [sets_of(t, 4) for t in texts]
    parent = list(range(len(texts)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].n_links) == (len(sets[i]), top(i), links[i])


def test_join_sets_derives_the_same_answers():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    sets = []
    for _ in range(60):
        s = base.copy()
        k = rng.integers(0, 40)
        s[rng.choice(200, k, replace=False)] = rng.integers(0, 2**63, k, dtype=np.uint64)
        sets.append(np.unique(s))
    want = [[y for y in range(60) if y != x and jaccard.linked(len(np.intersect1d(sets[x], sets[y])), len(sets[x]), len(sets[y]), 85)] for x in range(60)]
    assert [x.tolist() for x in jaccard.join_sets(sets, 85)] == want
    side = np.arange(60) % 2
    cross = jaccard.join_sets(sets, 85, side)
    assert [x.tolist() for x in cross] == [[y for y in w if side[y] != side[x]] for x, w in enumerate(want)]


def test_tiles_of_a_cluster_give_the_same(spark, monkeypatch):
    docs = make_docs(spark, corpus(n=24))
    whole = sorted(map(tuple, jaccard.join_components(docs).collect()))
    monkeypatch.setattr(jaccard, "TILE_SHINGLES", 60)
    assert sorted(map(tuple, jaccard.join_components(docs).collect())) == whole


def test_substrings_against_brute_force(spark):
    texts = corpus(2, 30)
    got = {r.doc_id: r for r in substrings.mark_repeats(make_docs(spark, texts)).collect()}
    first = {}
    words = [(t or "").encode().split() for t in texts]
    for i, w in enumerate(words):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, w in enumerate(words):
        gone = {q for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        r = got[i]
        assert (r.n_words, r.n_removed) == (len(w), len(gone))
        assert r.kept.encode() == b" ".join(x for p, x in enumerate(w) if p not in gone)
        assert {q for s in r.removed for q in range(s.start, s.end)} == gone


def test_null_and_repeated_ids(spark):
    text = " ".join(f"t{i}" for i in range(40))
    docs = make_docs(spark, [text] * 4, [5, 5, None, 9])
    got = sorted(substrings.mark_repeats(docs).select("doc_id", "n_removed").collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 40), (5, 0), (5, 0), (9, 40)]
    rows = jaccard.join_components(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_links) for r in rows) == [(0, 0, 0), (5, 5, 2), (5, 5, 2), (9, 5, 2)]
    assert sorted(r.doc_id or 0 for r in jaccard.keep_representatives(docs).collect()) == [0, 5]


def test_empty_tables(spark):
    docs = make_docs(spark, []).limit(0)
    path, pattern = bpe.tokenizer()
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    for df in (
        substrings.mark_repeats(docs), jaccard.join_components(docs), jaccard.keep_representatives(docs), bpe.bpe_encode(docs, path, pattern),
        decontam.contaminated_pairs(docs, bench), decontam.decontaminate(docs, bench), quality.quality_filter(docs, labels), ann.nearest(vectors, vectors, 3),
        toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels, ["toxic"]), ["toxic"]), licenses.scan_licenses(docs, licenses.known_licenses(spark)),
        chat.format_preferences(chat.adjacent_pairs(turns)), urls.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0


def test_bpe_is_tiktoken(spark):
    import tiktoken

    path, pattern = bpe.tokenizer()
    ranks = bpe.read_ranks(open(path, "rb").read())
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = [*corpus(n=10), "  two  spaces \n\n and 'll it's 123 ４５ é漢字🙂", " lead", "trail ", "\x1c a", "aaaa" * 50, "x  y", "<|endoftext|>"]
    out = bpe.bpe_decode(bpe.bpe_encode(make_docs(spark, texts), path, pattern), path).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = own.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.token_ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert bytes(r.decoded) == (texts[r.doc_id] or "").encode()
    once = bpe.bpe_round_trip(make_docs(spark, texts), path, pattern).select(out[0].__fields__)
    assert sorted(once.collect(), key=str) == sorted(out, key=str)


def test_merge_replay_in_pieces(monkeypatch):
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 299, b"abc": 300}
    words = [b"abcab", b"x" * 9, b"ab", b"cab", b"abab"]
    whole = bpe.MergeReplay(ranks).encode(words)
    monkeypatch.setattr(bpe, "REPLAY_BYTES", 4)
    monkeypatch.setattr(bpe, "LOOKUP", 2)
    assert bpe.MergeReplay(ranks).encode(words) == whole


def test_merge_replay_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"abc": 256, b"ab": 299, b"cc": 301, b"abcabc": 302}
    replay = bpe.MergeReplay(ranks)

    def plain(word):
        parts = [bytes([b]) for b in word]
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not pairs:
                return [ranks[p] for p in parts]
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(0)
    words = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 14))) for _ in range(500)})
    assert [np.frombuffer(x, "<u4").tolist() for x in replay.encode(words)] == [[ranks[w]] if w in ranks else plain(w) for w in words]


def test_decontamination(spark):
    rng = random.Random(4)
    item = [f"b{i}" for i in range(40)]
    shuffled = item[20:] + ["noise"] * 3 + item[:20]
    filler = [rng.choice("uvwxyz") for _ in range(50)]
    texts = [" ".join(filler + item + filler), "Zz " + " ".join(w.upper() + "," for w in shuffled), " ".join(filler), " ".join(item[:12]), None, ""]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (None, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contaminated_pairs(make_docs(spark, texts), bench).collect()}
    assert set(got) == {0, 1} and got[0].coverage == 1.0 and got[0].n_tiles == 1 and got[1].coverage == 1.0 and got[1].n_tiles == 2
    assert sorted(r.doc_id for r in decontam.decontaminate(make_docs(spark, texts), bench).collect()) == [2, 3, 4, 5]


def test_greedy_tiles_longest_first():
    a = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert decontam.greedy_tiles(a("abcdeXabcdefgh"), a("abcdefghabcde"), 3) == [(6, 0, 8), (0, 8, 5)]
    assert decontam.greedy_tiles(a("xyz"), a("abc"), 3) == []


def test_quality_ranks_held_out(spark):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "on", "mats."]) for _ in range(30))
    bad = lambda: " ".join(rng.choice("#$%&") * 3 + "A!!" for _ in range(30))
    texts = [good() if i % 4 else bad() for i in range(400)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, quality int")
    docs = make_docs(spark, texts)
    rows = quality.score_quality(docs, quality.fit_quality(docs, labels)).collect()
    assert len(rows) == 402 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(r.predicted == int(r.doc_id % 4 > 0) for r in held)
    one_class = quality.fit_quality(docs, labels.where("quality = 1"))
    assert quality.score_quality(docs, one_class).where("predicted = 0").count() == 0


def test_toxicity_chain(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(80)]
    texts, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(25)]
        rude, threat = i % 3 == 0, i % 6 == 0
        w += ["scoundrel"] * rude + ["smashing"] * threat
        rng.shuffle(w)
        texts.append(" ".join(w))
        labels.append((i, int(rude), int(threat)))
    docs = make_docs(spark, [*texts, None, ""])
    cats = ["rude", "threat"]
    chain = toxicity.fit_toxicity(docs, spark.createDataFrame(labels, "doc_id long, rude int, threat int"), cats)
    assert len(chain) == 2 and len(chain[1].earlier) == 1
    rows = toxicity.score_toxicity(docs, chain, cats).collect()
    held = [r for r in rows if r.doc_id < 400 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all((r.p_rude > 0.5) == (r.doc_id % 3 == 0) and (r.p_threat > 0.5) == (r.doc_id % 6 == 0) for r in held)


def test_redirect_classes(spark):
    link = '<link rel="canonical" href="{}">'
    pages = spark.createDataFrame([
        (1, "https://a.example.com/x", link.format("https://shop.net/y")), (2, "http://b.example.com/z?k=1", '<meta http-equiv="refresh" content="0; url=https://a.example.com/x/">'),
        (3, "https://shop.example.net/en/ok", link.format("https://a.example.com/x")), (4, "https://Shop.Example.COM/de/q#f", None), (5, None, None), (6, "nothing", "<p>"),
        (7, "https://c.example.com/free", ""), (8, "https://c.example.com/free", ""), (9, "http://x.example.com/fr/1", link.format("/en/2")),
    ], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.filter_urls(pages).collect()}
    assert got == {
        1: ("a.example.com", "/x", None, "block"), 2: ("b.example.com", "/z", None, "block"), 3: ("shop.example.net", "/en/ok", "example.net/en/", "allow"),
        4: ("shop.example.com", "/de/q", "example.com/de/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("c.example.com", "/free", None, "allow"), 8: ("c.example.com", "/free", None, "allow"), 9: ("x.example.com", "/fr/1", None, "allow"),
    }


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (500, 400), (None, 3)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100, 400: 400, 500: 400} | {1000 + i: 1000 for i in range(50)}


def test_preferences(spark):
    turns = spark.createDataFrame([
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", None), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "alone"),
        (4, 0, "user", "x"), (5, 0, "user", "x"), (5, 0, "user", "x"), (None, 0, "user", "y"),
    ], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in chat.format_preferences(chat.adjacent_pairs(turns)).collect()}
    pairs = spark.createDataFrame([(0, 0, 1, "x"), (2, 4, 5, "x"), (1, 2, 3, "x"), (9, None, 1, "x")], "pair_id long, chosen_id long, rejected_id long, prompt string")
    joined = chat.format_preferences(chat.join_sides(pairs, chat.conversations_of(turns)))
    assert {r.pair_id: r for r in joined.collect()} == got
    assert set(got) == {0, 2}
    r = got[0]
    assert r.n_common == 1 and r.prompt == "<|user|>\nhi<|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n"
    assert [r.chosen[m.start : m.end] for m in r.chosen_mask] == ["yes"] and [r.rejected[m.start : m.end] for m in r.rejected_mask] == ["no"]
    assert got[2].n_common == 1 and got[2].chosen == "" and got[2].chosen_mask == [] and got[2].rejected == "<|user|>\nx<|end|>\n"


@pytest.mark.parametrize("name", ["op1_license_scan", "op2_url_filter", "op3_preferences", "op5_substring_dedup", "op6_jaccard_join"])
def test_sql_twins(spark, name):
    import duckdb

    from gatelight.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = QUERIES[name](spark, d)
    rel = con.sql(ORACLE_SQL[name])
    assert sorted(map(str, df.select(*rel.columns).toPandas().values.tolist())) == sorted(map(str, rel.df().values.tolist()))


def test_pipeline(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.common.materialize(stage(spark, docs, d))
        assert i == 4 or docs.columns == names
    assert docs.where(~F.col("round_trip")).count() == 0 and docs.count() > 50
