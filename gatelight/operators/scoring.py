"""Presence scores and their normalisation against a cohort."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.functions import vector as V

#: Cohort rows whose products are summed at once.
BATCH_ROWS = 8192


def presence(enrol: DataFrame, streams: DataFrame, mix_first: bool = True) -> DataFrame:
    """(uid, score, best_stream): the best cosine of a uid's streams with its enrolment.

    Ties go to the mix, then to the least name; with mix_first off to the least name alone.
    """
    scored = streams.join(enrol.select("uid", F.col("emb").alias("__gl_e")), "uid").withColumn("s", V.cosine(F.col("__gl_e"), F.col("emb")))
    best = F.struct("s", (F.col("stream") == "mix") if mix_first else F.lit(False))
    top = scored.groupBy("uid").agg(F.max(best).alias("b"), F.collect_list(F.struct("s", "stream")).alias("all"))
    ties = F.filter("all", lambda x: x["s"] == F.col("b.s"))
    name = F.array_min(F.transform(ties, lambda x: x["stream"]))
    mix = F.exists(ties, lambda x: x["stream"] == "mix") if mix_first else F.lit(False)
    return top.select("uid", F.col("b.s").alias("score"), F.when(mix, "mix").otherwise(name).alias("best_stream"))


def _moments(cohort: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """{length: (mean vector, covariance matrix)} of the cohort's vectors without nulls, in two passes."""
    v = cohort.select(V.doubles(F.col("emb")).alias("v")).where(F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))

    def sums(of, means):
        def run(batches):
            done = {}
            for batch in batches:
                col = batch.column("v")
                sizes = np.asarray(pc.list_value_length(col))
                for d in np.unique(sizes).tolist():
                    rows = col.filter(pa.array(sizes == d)).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
                    for at in range(0, len(rows), BATCH_ROWS):
                        n, s = done.get(d, (0, 0.0))
                        part = rows[at : at + BATCH_ROWS]
                        done[d] = (n + len(part), s + of(part, means.get(d)))
            for d, (n, s) in done.items():
                yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "n": pa.array([n], pa.int64()), "s": pa.array([np.ravel(s).tolist()], pa.list_(pa.float64()))})

        parts = v.mapInArrow(run, "d int, n long, s array<double>").select("d", "n", F.posexplode("s").alias("i", "x"))
        out = {}
        for r in parts.groupBy("d", "i").agg((F.sum("x") / F.sum("n")).alias("x")).orderBy("d", "i").collect():
            out.setdefault(r.d, []).append(r.x)
        return out

    means = {d: np.array(x) for d, x in sums(lambda rows, _: rows.sum(0), {}).items()}
    spread = sums(lambda rows, mean: (rows - mean).T @ (rows - mean), means)
    return {d: (mean, np.array(spread[d]).reshape(d, d)) for d, mean in means.items()}


def cohort_stats(probes: DataFrame, cohort: DataFrame, eps: float = 1e-4) -> DataFrame:
    """(id, mu, sigma) of each probe's similarities with the cohort (probes: id, emb; cohort: emb).

    Of a cohort of any size, as mu is the probe's product with the cohort's mean vector and sigma
    squared its quadratic form with the covariance matrix. One row gives sigma eps; a probe without
    a cohort row of its length has mu null and sigma eps.
    """
    rows = [(d, mean.tolist(), spread.tolist()) for d, (mean, spread) in _moments(cohort).items()]
    known = probes.sparkSession.createDataFrame(rows, "__gl_d int, __gl_m array<double>, __gl_c array<array<double>>")
    each = probes.join(F.broadcast(known), F.size("emb") == F.col("__gl_d"), "left")
    var = V.dot(F.transform("__gl_c", lambda row: V.dot(row, F.col("emb"))), F.col("emb"))
    return each.select("id", V.dot(F.col("emb"), F.col("__gl_m")).alias("mu"), F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(eps)).alias("sigma"))


def z_norm(score, mu, sigma):
    return (score - mu) / sigma


def as_norm(score, mu_e, sigma_e, mu_t, sigma_t):
    return 0.5 * (z_norm(score, mu_e, sigma_e) + z_norm(score, mu_t, sigma_t))
