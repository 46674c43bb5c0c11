"""Registered queries of whole reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from gatelight.functions import tables as TF
from gatelight.operators import analysis as A
from gatelight.operators import overlay as V
from gatelight.operators import rules as R
from gatelight.plans import views as D
from gatelight.plans.more import REC, _rec
from gatelight.plans.queries import SQL, T, query

_PLACE = "(list_sort(list(latency_ms) FILTER (latency_ms IS NOT NULL)))[{} + 1]"
_N = "count(latency_ms)"


@query(f"""{T}, {REC}, runs AS (
  SELECT split, present, score, cer, tl / 10.0::DOUBLE AS latency_ms,
    CASE WHEN score < thr THEN 'reject' WHEN source IS NULL THEN 'accept_no_tse' WHEN digits THEN 'accept' ELSE 'stream_error' END AS decision
  FROM trials LEFT JOIN rec USING (vec_id)),
rated AS (SELECT *, CASE WHEN decision = 'reject' THEN 1.0::DOUBLE ELSE cer END AS v FROM runs),
sums AS (
  SELECT split, grouping(split) = 1 AS is_all, count(*) AS n, count_if(present) AS n_present, count_if(NOT present) AS n_absent,
    {", ".join(f"count_if(decision = '{x}') AS n_{x}" for x in ("accept", "accept_no_tse", "reject", "stream_error", "pipeline_error"))},
    round(avg(score), 6) AS mean_score, count_if(present AND decision = 'reject') AS fr, count_if(NOT present AND decision = 'accept') AS fa,
    count_if(NOT present AND decision = 'reject') AS rj, count_if(present AND v IS NULL) AS pending, avg(v) FILTER (present) AS mean_cer,
    round(avg(latency_ms), 6) AS latency_mean, {_PLACE.format(f"{_N} // 2")} AS latency_p50, {_PLACE.format(f"floor(0.95::DOUBLE * ({_N} - 1))::INT")} AS latency_p95
  FROM rated GROUP BY GROUPING SETS ((split), ()))
SELECT split, is_all, n, n_present, n_absent, n_accept, n_accept_no_tse, n_reject, n_stream_error, n_pipeline_error,
  round(n_accept::DOUBLE / n, 6) AS accept_rate, round(n_reject::DOUBLE / n, 6) AS reject_rate, round((n_stream_error + n_pipeline_error)::DOUBLE / n, 6) AS error_rate,
  mean_score, round(fr::DOUBLE / nullif(n_present, 0), 6) AS frr, round(fa::DOUBLE / nullif(n_absent, 0), 6) AS far, round(rj::DOUBLE / nullif(n_absent, 0), 6) AS rr, pending,
  round(CASE WHEN pending = 0 THEN coalesce(mean_cer, 0) END, 6) AS cer,
  round(CASE WHEN pending = 0 THEN 0.5::DOUBLE * coalesce(rj::DOUBLE / nullif(n_absent, 0), 0) + 0.5::DOUBLE * (1 - coalesce(mean_cer, 0)) END, 6) AS contest,
  latency_mean, latency_p50, latency_p95
FROM sums""")
def run_report(spark, d):
    """The full run summary by split and over all: decisions, rates, pending CERs, latencies (here a tenth of the text's length)."""
    rows = D.trials(spark, d).join(_rec(spark, d), "vec_id", "left")
    status = F.when(F.col("source").isNull(), "none").when(F.col("digits"), "ok").otherwise("failed")
    return A.run_report(rows.select("split", "present", "score", "cer", (F.col("tl") / 10.0).alias("latency_ms"), R.decision(F.col("score"), F.col("thr"), status).alias("decision")))


# ---- results ----
@query(f"""{T}, p AS (SELECT vec_id AS id, reject, 'heard ' || spk AS content, cer FROM trials WHERE present),
one AS (SELECT id, min(struct_pack(content := content, reject := reject, cer := cer)) AS r FROM p GROUP BY id)
SELECT doc_id AS id, CASE WHEN NOT r.reject THEN coalesce(r.content, '') ELSE '' END AS content, quality AS label, CASE WHEN NOT r.reject THEN coalesce(r.cer, 1) ELSE 1.0 END AS cer
FROM labels LEFT JOIN one ON id = doc_id""")
def predicted_results(spark, d):
    """Entries of a backup (here the labels) with what the decisions of the positives say."""
    rows = D.trials(spark, d).where("present").select(F.col("vec_id").alias("id"), "reject", F.concat(F.lit("heard "), F.col("spk").cast("string")).alias("content"), "cer")
    return V.with_predictions(D.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label")), rows)


# ---- table functions ----
@query(SQL["slide_windows"])
def lateral_windows(spark, d):
    """`slide_windows` by a table function in a LATERAL join."""
    return TF.windows_of(D.read(spark, d, "documents"), F.length("text"), ["doc_id"], 800, 400, 350)


@query(SQL["energy_islands"])
def partitioned_islands(spark, d):
    """`energy_islands` by a table function over a partitioned table."""
    return TF.islands_of(D.read(spark, d, "events").where("value > 50"), "user_id", "event_id", 200)
