"""Quality scores by Bradley-Terry ranking.

Documents are compared in preference pairs (label 1 over label 0); the logistic loss on feature
differences gives a linear score, and a quantile of the training scores is the threshold. Features
come from whole texts: frequencies of pairs of byte classes, and how words and lines repeat.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.llm import common as C

#: Labelled rows to learn from at most (a sample by hash beyond), and preference pairs made of them.
MAX_TRAIN = 20_000
MAX_PAIRS = 40_000
#: The score that the quantile threshold is mapped to.
CUT = 0.3

N_CLASSES = 14
N_FEATURES = N_CLASSES * N_CLASSES + 7


class Featurizer:
    """Rows of N_FEATURES numbers; an empty or null text has zeros."""

    def __init__(self):
        kind = np.full(256, N_CLASSES - 1, np.int64)  # bytes outside ASCII
        kind[:128] = 0
        for i, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "aeiou", "bcdfghjklmnpqrstvwxyz", "0123456789", " ", "\t\n\r", ".,;:", "!?", "'\"", "()[]{}<>", "|/\\_-", "#$%&*+=@^~")):
            kind[[ord(c) for c in chars]] = i + 1
        self.kind = kind
        self.words = C.Tokenizer()

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), N_FEATURES))
        h, counts = self.words(texts)
        ends = np.cumsum(counts)
        for i, text in enumerate(texts):
            if not text:
                continue
            k = self.kind[np.frombuffer(text, np.uint8)]
            pairs = np.bincount(k[:-1] * N_CLASSES + k[1:], minlength=N_CLASSES * N_CLASSES)
            out[i, : N_CLASSES * N_CLASSES] = np.sqrt(pairs / len(k))
            w = h[ends[i] - counts[i] : ends[i]]
            n = max(len(w), 1)
            lines = text.split(b"\n")
            _, freq = np.unique(w, return_counts=True)
            out[i, N_CLASSES * N_CLASSES :] = (
                np.log1p(n), len(text) / n / 10, len(freq) / n, np.count_nonzero(w[1:] == w[:-1]) / n,
                freq.max(initial=0) / n, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)),
            )
        return out


class Ranker(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; CUT at the threshold."""
        z = (x - self.mean) / self.scale @ self.weights - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_bradley_terry(x: np.ndarray, y: np.ndarray, max_pairs: int = MAX_PAIRS, l2: float = 1e-3, seed: int = 7) -> Ranker:
    """Newton steps on the mean logistic loss of feature differences.

    Pairs are drawn by a seeded generator, each label-1 and each label-0 row equally often. With one
    class only there is no pair and all scores are equal, above CUT.
    """
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    d = x.shape[1] if x.size else N_FEATURES
    if not len(good) or not len(bad):
        return Ranker(np.zeros(d), np.ones(d), np.zeros(d), -2.0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    n = min(max_pairs, len(good) * len(bad))
    deal = lambda rows: np.resize(rng.permutation(rows), n)
    a, b = deal(good), rng.permutation(deal(bad))
    w = np.zeros(d)
    for _ in range(12):
        grad, hess = l2 * w, l2 * np.eye(d)
        for at in range(0, n, 4096):
            diff = z[a[at : at + 4096]] - z[b[at : at + 4096]]
            p = 1 / (1 + np.exp(np.clip(diff @ w, -40, 40)))
            grad -= diff.T @ p / n
            hess += (diff * (p * (1 - p))[:, None]).T @ diff / n
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / (np.linalg.norm(step) + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return Ranker(mean, scale, w, quantile_threshold(z @ w, y))


def quantile_threshold(score: np.ndarray, y: np.ndarray) -> float:
    """The quantile of the scores (in thousandths) that tells the labels apart best, middle of ties."""
    levels = np.quantile(score, np.linspace(0, 1, 1001))
    right = np.array([np.mean((score >= t) == (y == 1)) for t in levels])
    best = levels[right == right.max()]
    return float(best[len(best) // 2])


def is_held_out(id_col: str):
    """crc32 of the id as text, modulo 5, is 0; rows without id are held out too."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, targets: list[str], limit: int) -> DataFrame:
    """(text, *targets) of at most about `limit` labelled ids that aren't held out, drawn by hash.

    Rows of `labels` with a null id or target are left out; of several rows of one id the least
    labels count, and of several texts of one id the one of the least hash, so that an id is one row.
    """
    own = labels.where(F.col(id_col).isNotNull() & ~is_held_out(id_col))
    for t in targets:
        own = own.where(F.col(t).isNotNull())
    own = own.groupBy(F.col(id_col).alias("__gl_id")).agg(*[F.min(t).cast("int").alias(f"__gl_{t}") for t in targets])
    n = own.count()
    if n > limit:
        own = own.where(F.pmod(F.xxhash64("__gl_id"), F.lit(1 << 30)) < int(limit / n * (1 << 30)))
    own = F.broadcast(own)  # `limit` rows by construction
    texts = docs.select(F.col(id_col).alias("__gl_id"), C.octets(text_col).alias("text"))
    known = texts.join(own, "__gl_id")
    text = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"]
    return known.groupBy("__gl_id", *[f"__gl_{t}" for t in targets]).agg(text.alias("text")).drop("__gl_id")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> Ranker:
    """Learn from at most about `max_train` labelled rows; their features go to the driver."""
    sample = labelled_sample(docs, labels, id_col, text_col, [label_col], max_train)

    def run(batches):
        featurize = Featurizer()
        for batch in batches:
            for part in C.text_slices(batch, "text"):
                x = featurize(part.column(0).to_pylist()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), part.column(1)], names=["x", "y"])

    rows = sample.select("text", f"__gl_{label_col}").mapInArrow(run, "x binary, y int").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
    y = rows["y"].to_numpy()
    order = np.lexsort((*x[:, ::-1].T[:8], y))  # the same model whatever the rows' order
    return fit_bradley_terry(x[order], y[order])


def score_quality(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """`docs` with score (double, 0 to 1) and predicted (int: 1 if score >= CUT).

    Null and empty texts are scored as texts without features. Columns of these names are replaced;
    rows stay one to one.
    """
    base = C.replace_columns(docs, ["score", "predicted"])
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches):
        featurize = Featurizer()
        for batch in batches:
            col = batch.schema.get_field_index(text_col)
            for part in C.text_slices(batch, text_col):
                s = model.score(featurize(part.column(col).cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(s, pa.float64()), pa.array((s >= CUT).astype(np.int32), pa.int32())],
                    names=[*part.schema.names, "score", "predicted"],
                )

    return base.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs`, columns unchanged, without the documents whose score is under CUT."""
    model = fit_quality(docs, labels, id_col, text_col)
    return score_quality(docs, model, text_col).where(F.col("predicted") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`score_quality` of `documents`, learnt from the labels of the rows that aren't held out."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, C.table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", is_held_out("doc_id").alias("held_out"), "score", "predicted")
