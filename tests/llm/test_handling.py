"""Models against plain versions, and every operator and stage on odd input."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gatelight.llm import bpe, chat, common, quality, toxicity, urls

D = "/root/testdata/sf0.001"


def test_quality_scores_row_by_row(spark):
    """Scores don't depend on a row's neighbours: each is the model's linear score of its features alone."""
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    model = quality.fit_quality(docs, spark.read.parquet(f"{D}/labels.parquet"))
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "long words " * 100_000), (-3, "long words " * 100_000), (None, "x")], "doc_id long, text string")
    both = docs.union(odd).withColumn("SCORE", F.lit("clash")).withColumn("predicted", F.lit(7))
    rows = quality.score_quality(both, model).collect()
    assert len(rows) == both.count()
    for r in rows[::7] + rows[-5:]:
        x = quality.Featurizer()([r.text.encode() if r.text is not None else None])
        z = float(((x - model.mean) / model.scale @ model.weights)[0]) if hasattr(model, "weights") else None
        want = float(model.score(x)[0])
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.3) and (z is None or np.isfinite(z))


def test_bradley_terry_is_at_its_optimum():
    """More weight on any feature difference doesn't lower the pairwise logistic loss."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, quality.N_FEATURES))
    y = (x[:, 0] + 0.5 * x[:, 1] + 0.3 * rng.standard_normal(300) > 0).astype(int)
    model = quality.fit_bradley_terry(x, y)
    s = model.score(x)
    assert np.mean((s >= quality.CUT) == (y == 1)) > 0.95
    pairs = s[y == 1][:, None] > s[y == 0][None]
    assert pairs.mean() > 0.98


def test_quality_of_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    rows = quality.op8_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id").where("held_out and quality is not null").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_toxicity_chain_link_by_link(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{D}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    cats = ["low_quality", "toxic"]
    chain = toxicity.fit_toxicity(docs, labels, cats)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "very long " * 100_000), (-3, "very long " * 100_000)], "doc_id long, text string")
    both = docs.union(odd).withColumn("P_TOXIC", F.lit("clash"))
    rows = toxicity.score_toxicity(both, chain, cats).collect()
    assert len(rows) == both.count()
    words = common.Tokenizer("plain", toxicity.STEMS)
    for r in rows[::5] + rows[-4:]:
        own = set((words([(r.text or "").encode()])[0] >> np.uint64(32)).tolist())
        before = []
        for link in chain:
            z = link.bias + sum(w for v, w in zip(link.vocab.tolist(), link.words) if v in own) + sum(w * p for w, p in zip(link.earlier, before))
            before.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        assert [r.p_low_quality, r.p_toxic] == pytest.approx(before, abs=1e-5)


def test_toxicity_of_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    found = {r.doc_id for r in toxicity.op4_toxicity(spark, d).collect()}
    held = [r for r in spark.read.parquet(f"{d}/labels.parquet").where("toxic is not null").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    bad, good = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert np.mean([r.doc_id in found for r in bad]) > 0.85 and np.mean([r.doc_id in found for r in good]) < 0.03


def test_out_of_fold_inputs():
    """A later link sees earlier probabilities of models that didn't see the row."""
    rng = np.random.default_rng(1)
    n = 120
    vocab = rng.integers(0, 2**32, 30, dtype=np.uint32)
    texts = [np.unique(rng.choice(vocab, 8)) for _ in range(n)]
    h, counts = np.concatenate(texts), np.array([len(t) for t in texts])
    y = np.stack([rng.integers(0, 2, n), rng.integers(0, 2, n)], 1)
    chain = toxicity.fit_chain(h, counts, y, folds=3, max_words=10)
    before, fold = np.zeros(n), toxicity.folds_of(h, counts, 3)
    for f in range(3):
        inn = fold != f
        link = toxicity.fit_link(np.concatenate([t for t, i in zip(texts, inn) if i]), counts[inn], np.zeros((inn.sum(), 0)), y[inn, 0], 10)
        out = [t for t, i in zip(texts, inn) if not i]
        before[~inn] = link.prob(toxicity.presence(np.concatenate(out), counts[~inn], link.vocab), np.zeros((len(out), 0)))
    want = toxicity.fit_link(h, counts, before[:, None], y[:, 1], 10)
    assert np.allclose(chain[1].words, want.words) and np.allclose(chain[1].earlier, want.earlier)


def test_copies_are_in_one_fold():
    rng = np.random.default_rng(2)
    texts = [np.unique(rng.integers(0, 2**32, 9, dtype=np.uint32)) for _ in range(40)]
    some = [texts[i % 40] for i in range(400)]
    fold = toxicity.folds_of(np.concatenate(some), np.array([len(t) for t in some]), 4)
    assert all(fold[i] == fold[i % 40] for i in range(400)) and set(fold.tolist()) == {0, 1, 2, 3}


def test_a_labelled_id_is_one_row(spark):
    """Ids that stand in thousands of rows send one text each to the driver, whatever the rows' order."""
    rows = [(2, f"text {i % 7}") for i in range(3000)] + [(3, None)] * 1000 + [(7, "x")]
    ids = [i for i in (2, 3, 7, 8) if zlib.crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, 1) for i in (2, 3, 7, 8)] * 3, "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((bytes(r.text) if r.text is not None else b"") for r in quality.labelled_sample(df, labels, "doc_id", "text", ["quality"], 10).collect()) for df in (docs, docs.repartition(7))]
    assert got[0] == got[1] and len(got[0]) == len([i for i in ids if i != 8])


def test_url_ties_and_clashing_columns(spark):
    rules = [("block", "a.com", "/x/"), ("allow", "a.com", "/x/"), ("block", "com", "/"), ("allow", "b.a.com", "/")]
    pages = spark.createDataFrame([(1, "http://a.com/x/1", None, "r", "v"), (2, "http://a.com/y", "", "r", "v"), (3, "http://b.a.com/y", "", "r", "v"), (3, "http://b.a.com/y", "", "r", "v"), (4, None, None, "r", "v"), (5, "x://" + "a" * 100_000, "<p>", "r", "v")],
                                  "page_id long, url string, html string, RULE string, verdict string")
    got = sorted((r.page_id, r.rule, r.verdict) for r in urls.filter_urls(pages, rules).select("page_id", "rule", "verdict").collect())
    assert got == [(1, "a.com/x/", "allow"), (2, "com/", "block"), (3, "b.a.com/", "allow"), (3, "b.a.com/", "allow"), (4, None, "allow"), (5, None, "allow")]


def test_preferences_with_clashing_columns_and_nulls(spark):
    turns = spark.createDataFrame([(-2, 0, None, "hi", "p"), (-1, 0, "", "hi", "p"), (-1, 1, "assistant", "é" * 50_000, "p"), (6, None, "user", "b", "p"), (6, None, "user", "a", "p"), (7, 0, "user", "a", "p")],
                                  "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat.format_preferences(chat.adjacent_pairs(turns)).collect()}
    assert set(got) == {-1, 3} and got[-1].n_common == 1 and got[-1].chosen == "" and got[-1].rejected_mask[0].end - got[-1].rejected_mask[0].start == 50_000
    assert got[3].prompt == "<|user|>\na<|end|>\n" and got[3].rejected == "" and got[3].chosen == "<|user|>\nb<|end|>\n"


def test_other_split_patterns(spark):
    import tiktoken

    path, _ = bpe.tokenizer()
    ranks = bpe.read_ranks(open(path, "rb").read())
    for pattern in (r"\p{L}+ \p{L}+|\s+|\S", r"[\s\S]{1,7}"):
        own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        texts = ["one two three four", "a b", " lead and  two ", "", "x"]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        for r in bpe.bpe_encode(docs, path, pattern).collect():
            assert np.frombuffer(r.token_ids, "<u4").tolist() == own.encode_ordinary(texts[r.doc_id])


def odd_documents(spark):
    """Columns of documents and clashing ones; nulls, empty and long texts, ties, repeated ids and rows."""
    names = ["score", "PREDICTED", "kept", "n_words", "removed", "digest", "component_id", "n_tokens", "item_id", "key", "id"]
    rng = random.Random(1)
    base = [r.text for r in spark.read.parquet(f"{D}/documents.parquet").select("text").limit(30).collect()]
    bench = [r.text for r in spark.read.parquet(f"{D}/benchmark.parquet").limit(2).collect()]
    texts = [*base, None, "", " \n", base[0], base[0], " ".join(rng.choice(base[:5]) for _ in range(200)), bench[0], base[3] + " " + bench[1]]
    ids = [*range(len(base)), 40, 41, 42, 0, 43, 44, None, 45]
    rows = [(i, t, "en", None, len(t or "")) for i, t in zip(ids, texts)] + [(3, base[4], None, "s", None), (None, None, None, None, None)]
    out = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    return out.withColumns({n: F.lit("clash") for n in names}).repartition(3)


@pytest.mark.parametrize("at", range(5))
def test_stages_on_odd_documents(spark, at):
    docs = common.materialize(odd_documents(spark))
    name, stage = corpus_pipeline.STAGES[at]
    out = common.materialize(stage(spark, docs, D))
    assert at == 4 or out.columns == docs.columns
    before = {(r.doc_id, r.text) for r in docs.collect()}
    after = out.collect()
    if name != "substrings":
        assert {(r.doc_id, r.text) for r in after} <= before
    if name != "quality":
        assert sum(r.doc_id is None and r.text is None for r in after) == 1
    if name == "near_dups":
        assert {r.doc_id for r in after} >= {0, 1, 2, 40, 41, 42} and 43 not in {r.doc_id for r in after} and sum(r.doc_id == 0 for r in after) == 1
    if name == "benchmark":
        assert 45 not in {r.doc_id for r in after} and {40, 41, 42} <= {r.doc_id for r in after}
    if name == "tokens":
        assert len(after) == docs.count() and all(r.round_trip for r in after)
    empty = stage(spark, docs.limit(0), D)
    assert empty.count() == 0
