"""Toxicity categories by a classifier chain.

Categories are predicted one after another by linear models over presence of words and stems; each later model
also gets the probabilities of the earlier categories, and is trained on out-of-fold ones, so that
training and use see the same kind of input.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.llm import common as C
from gatelight.llm.quality import labelled_sample

#: Labelled rows to learn from at most, words kept for each category, folds.
MAX_TRAIN = 12_000
MAX_WORDS = 768
FOLDS = 4
#: The registered query calls a document toxic from this probability on.
TOXIC = 0.25
#: Leading bytes of words that count as features beside the words, for inflected forms.
STEMS = (4, 5)


class Link(NamedTuple):
    """A category's model: sorted word hashes, weights of words, earlier categories and 1."""

    vocab: np.ndarray
    words: np.ndarray
    earlier: np.ndarray
    bias: float

    def prob(self, x: np.ndarray, before: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.words + before @ self.earlier + self.bias)


def short(h: np.ndarray) -> np.ndarray:
    """32 bits of a hash, which is what features go by."""
    return (h >> np.uint64(32)).astype(np.uint32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def presence(h: np.ndarray, counts: np.ndarray, vocab: np.ndarray) -> np.ndarray:
    """Which words of the vocabulary each text has, as 0 and 1."""
    x = np.zeros((len(counts), len(vocab)), np.float32)
    if len(vocab) and len(h):
        at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
        hit = np.flatnonzero(vocab[at] == h)
        x[np.repeat(np.arange(len(counts)), counts)[hit], at[hit]] = 1
    return x


def telling_words(h: np.ndarray, counts: np.ndarray, y: np.ndarray, limit: int) -> np.ndarray:
    """The words of three texts or more whose presence differs most between the classes, by z score;
    sorted. A text's words are distinct."""
    if not len(h) or y.min() == y.max():
        return np.zeros(0, np.uint32)
    every, own = np.sort(h), np.sort(h[np.repeat(y == 1, counts)])
    at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    c = np.diff(np.append(at, len(every)))
    vocab, c = every[at[c >= 3]], c[c >= 3].astype(float)
    del every
    c1 = (np.searchsorted(own, vocab, side="right") - np.searchsorted(own, vocab)).astype(float)
    n1, n0 = y.sum(), (1 - y).sum()
    p = (c + 1) / (n1 + n0 + 2)
    z = np.abs(c1 / n1 - (c - c1) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    return np.sort(vocab[np.argsort(-z, kind="stable")[:limit]])


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.1, rounds: int = 60) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression by L-BFGS; the bias isn't penalised."""
    n = len(y)
    x1 = np.hstack([x, np.ones((n, 1), x.dtype)])
    pen = np.full(x1.shape[1], l2 / n)
    pen[-1] = 0

    def at(w):
        z = np.clip(x1 @ w, -40, 40)
        return np.mean(np.log1p(np.exp(z)) - y * z) + (pen * w * w).sum() / 2, x1.T @ (sigmoid(z) - y) / n + pen * w

    w = np.zeros(x1.shape[1])
    f, g = at(w)
    memory: list = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, t, rho in reversed(memory):
            alphas.append(rho * s @ q)
            q -= alphas[-1] * t
        q *= (memory[-1][0] @ memory[-1][1]) / (memory[-1][1] @ memory[-1][1]) if memory else 1.0
        for (s, t, rho), alpha in zip(memory, reversed(alphas), strict=True):
            q += s * (alpha - rho * t @ q)
        step = 1.0
        while step > 1e-8:
            f2, g2 = at(w - step * q)
            if f2 <= f - 1e-4 * step * (g @ q):
                break
            step /= 2
        s, t = -step * q, g2 - g
        w, f, g = w + s, f2, g2
        if s @ t > 1e-12:
            memory = [*memory[-9:], (s, t, 1 / (s @ t))]
        if np.abs(g).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_link(h, counts, before, y, max_words) -> Link:
    """One category's model; with one class only, its constant."""
    k = before.shape[1]
    if not len(y) or y.min() == y.max():
        return Link(np.zeros(0, np.uint32), np.zeros(0), np.zeros(k), 30.0 if len(y) and y[0] else -30.0)
    vocab = telling_words(h, counts, y, max_words)
    w, bias = fit_logistic(np.hstack([presence(h, counts, vocab), before.astype(np.float32)]), y)
    return Link(vocab, w[: len(vocab)], w[len(vocab) :], bias)


def rows_of(h: np.ndarray, counts: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h[np.repeat(mask, counts)], counts[mask]


def folds_of(h: np.ndarray, counts: np.ndarray, folds: int) -> np.ndarray:
    """A row's fold, by its words alone."""
    return np.array([zlib.crc32(h[end - n : end].tobytes()) % folds for end, n in zip(np.cumsum(counts), counts, strict=True)], np.int64)


def fit_chain(h: np.ndarray, counts: np.ndarray, y: np.ndarray, folds: int = FOLDS, max_words: int = MAX_WORDS) -> list[Link]:
    """A link for each column of `y`, in order; a row's fold is by its words, so copies are never told apart."""
    n = len(counts)
    fold = folds_of(h, counts, folds)
    before, chain = np.zeros((n, 0)), []
    for c in range(y.shape[1]):
        chain.append(fit_link(h, counts, before, y[:, c], max_words))
        if c + 1 < y.shape[1]:
            out = np.zeros(n)
            for f in range(folds):
                inn = fold != f
                link = fit_link(*rows_of(h, counts, inn), before[inn], y[inn, c], max_words)
                ho, co = rows_of(h, counts, ~inn)
                out[~inn] = link.prob(presence(ho, co, link.vocab), before[~inn])
            before = np.hstack([before, out[:, None]])
    return chain


def fit_toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], id_col: str = "doc_id", text_col: str = "text", max_train: int = MAX_TRAIN) -> list[Link]:
    """Learn a chain over the 0/1 columns `categories` of `labels`, in this order.

    At most about `max_train` labelled rows are drawn; the distinct word hashes of their whole texts
    go to the driver. Held-out rows, null ids and null labels aren't learned from.
    """
    sample = labelled_sample(docs, labels, id_col, text_col, categories, max_train)
    kinds = ", ".join(f"y{i} int" for i in range(len(categories)))

    def run(batches):
        words = C.Tokenizer("plain", STEMS)
        for batch in batches:
            for part in C.text_slices(batch, "text"):
                blobs = [np.unique(short(words([t])[0])).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), *part.columns[1:]], names=["h", *(f"y{i}" for i in range(len(categories)))])

    rows = sample.select("text", *[f"__gl_{c}" for c in categories]).mapInArrow(run, f"h binary, {kinds}").toArrow()
    blobs = rows["h"].to_pylist()
    y = np.stack([rows[f"y{i}"].to_numpy() for i in range(len(categories))], 1) if blobs else np.zeros((0, len(categories)), int)
    order = sorted(range(len(blobs)), key=lambda i: blobs[i])  # the same model whatever the rows' order
    counts = np.array([len(blobs[i]) // 4 for i in order], np.int64)
    h = np.frombuffer(b"".join(blobs[i] for i in order), np.uint32)
    del blobs, rows
    return fit_chain(h, counts, (y[order] != 0).astype(int))


def score_toxicity(docs: DataFrame, chain: list[Link], categories: list[str], text_col: str = "text") -> DataFrame:
    """`docs` with p_<category> (double) for each category of the chain.

    Null and empty texts are scored as texts without words. Columns of these names are replaced;
    rows stay one to one.
    """
    names = [f"p_{c}" for c in categories]
    base = C.replace_columns(docs, names)
    schema = T.StructType([*base.schema.fields, *[T.StructField(n, T.DoubleType()) for n in names]])

    def run(batches):
        words = C.Tokenizer("plain", STEMS)
        for batch in batches:
            col = batch.schema.get_field_index(text_col)
            for part in C.text_slices(batch, text_col):
                h, counts = words(part.column(col).cast(pa.binary()).to_pylist())
                h = short(h)
                before = np.zeros((part.num_rows, 0))
                for link in chain:
                    before = np.hstack([before, link.prob(presence(h, counts, link.vocab), before)[:, None]])
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(before[:, i], pa.float64()) for i in range(len(names))]], names=[*part.schema.names, *names])

    return base.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents judged toxic, with the chain's probabilities: low quality first, then toxic."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = C.table(spark, sf_dir, "labels").withColumn("low_quality", 1 - F.col("quality"))
    categories = ["low_quality", "toxic"]
    scored = score_toxicity(docs, fit_toxicity(docs, labels, categories), categories)
    return scored.where(F.col("p_toxic") >= TOXIC).select("doc_id", "p_low_quality", "p_toxic", F.lit(1).alias("toxic"))
