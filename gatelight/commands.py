"""The commands of a run: each takes the settings and named tables and gives named tables.

`trials` has uid, split, lang and score, and where known id, cer, asr_text (normalised), second_score and
second_window_score; models that make scores and texts are the caller's (operators/models.py).
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.config import RunConfig
from gatelight.functions import metrics as M
from gatelight.functions import text as X
from gatelight.operators import analysis as A
from gatelight.operators import calibrate as K
from gatelight.operators import relational as J
from gatelight.operators import rules as R
from gatelight.sources.ledger import in_chunks

Tables = dict[str, DataFrame]
COMMANDS: dict[str, Callable[[RunConfig, Tables], Tables]] = {}
#: Columns that trials may lack.
OPTIONAL = {"id": "long", "cer": "double", "asr_text": "string", "second_score": "double", "second_window_score": "double"}


def command(f):
    COMMANDS[f.__name__] = f
    return f


def _trials(cfg: RunConfig, t: DataFrame) -> DataFrame:
    """Trials with all columns, `present`, scores of 6 digits, and a stratified part of them if the settings limit a run."""
    t = t.withColumns({c: F.lit(None).cast(kind) for c, kind in OPTIONAL.items() if c not in t.columns})
    t = t.withColumns({"present": F.col("split") == "pos", "score": F.round("score", 6), "lang": F.coalesce(F.nullif(F.col("lang"), F.lit("")), F.lit("zh"))})
    return K.stratified_limit(t, cfg.limit, "split").drop("turn") if cfg.limit > 0 else t


def _thresholds(cfg: RunConfig, t: DataFrame) -> DataFrame:
    """(lang, thr): frozen ones, or the best contest of the rows that aren't held out, by language or for all."""
    langs = t.select("lang").distinct()
    if cfg.locked_thr:
        return langs.select("lang", R.frozen_threshold(F.col("lang")).alias("thr"))
    fit = t.where(~F.col("held_out"))
    if not cfg.lang_split:
        return langs.crossJoin(F.broadcast(K.select_contest(K.curve(fit)).select("thr")))  # one row
    return K.select_contest(K.curve(fit, ["lang"]), ["lang"]).select("lang", "thr")


def _held(cfg: RunConfig, t: DataFrame) -> DataFrame:
    if not cfg.holdout_frac:
        return t.withColumn("held_out", F.lit(False))
    return K.holdout(t, ["present", "lang"], cfg.holdout_frac, cfg.holdout_seed, floors=(10, 5))


def _gated(cfg: RunConfig, t: DataFrame) -> DataFrame:
    """Trials with thr, base (rejected by score), reason and reject after the overlays that are on."""
    t = _held(cfg, t)
    t = t.join(F.broadcast(_thresholds(cfg, t)), "lang", "left")  # a row for each language
    s, thr, said = F.col("score"), F.col("thr"), F.coalesce("asr_text", F.lit(""))
    off = F.lit(False)
    base = F.coalesce(s < thr, F.lit(True))
    text = R.text_reject(s, thr, F.length(said), X.classify(said)["task_oriented"]) if cfg.extra_reject else off
    encoder = R.veto(s, F.col("second_score"), thr) if cfg.veto_encoder else off
    window = R.veto(s, F.col("second_window_score"), thr) if cfg.veto_windows else off
    out = t.withColumn("base", base).withColumn("reason", R.overlay_reason(base, F.coalesce(text, off), encoder, window))
    return out.withColumn("reject", F.col("reason").isNotNull())


def _metrics(df: DataFrame, *by: str, reject: str = "reject") -> DataFrame:
    m = M.contest_metrics(F.col("present"), F.col(reject), F.col("cer"))
    return df.groupBy(*by).agg(*m) if by else df.agg(*m)


@command
def run(cfg: RunConfig, tables: Tables) -> Tables:
    """Thresholds, decisions with reasons, summary by language and side of the holdout, submission."""
    g = _gated(cfg, _trials(cfg, tables["trials"]))
    out = {"decisions": g.select("uid", "split", "lang", "score", "thr", "reject", "reason"), "summary": _metrics(g), "by_lang": _metrics(g, "lang"), "by_side": _metrics(g, "held_out")}
    if not cfg.skip_asr:
        out["submission"] = J.submission(g.withColumn("content", F.col("asr_text")))
    return out


@command
def calibrate(cfg: RunConfig, tables: Tables) -> Tables:
    """Curves and choices: by contest, by the target of false rejects, equal error, by language, on the holdout."""
    t = _held(cfg, _trials(cfg, tables["trials"]))
    fit = t.where(~F.col("held_out"))
    c = K.curve(fit)
    out = {"curve": c, "by_contest": K.select_contest(c), "by_frr": K.select_frr(c, cfg.target_frr), "eer": K.select_eer(c)}
    out["document"] = A.calibration(fit, lambda rows, keys: K.select_contest(K.curve(rows, keys), keys), 5, 3)
    if cfg.holdout_frac:
        out["holdout"] = K.holdout_by(t, ["lang"])
    return out


@command
def lift(cfg: RunConfig, tables: Tables) -> Tables:
    """What each overlay adds to the score: metrics by overlay, and counts of rows that it changes."""
    t = _trials(cfg, tables["trials"])
    arms = {"score": {}, "text": {"extra_reject": True}, "encoder": {"veto_encoder": True}, "window": {"veto_windows": True}, "all": {"extra_reject": True, "veto_encoder": True, "veto_windows": True}}
    off = {"extra_reject": False, "veto_encoder": False, "veto_windows": False}
    rows = None
    for name, on in arms.items():
        g = _gated(RunConfig(**{**vars(cfg), **off, **on}), t).select(F.lit(name).alias("arm"), "present", "base", "reject", "cer")
        rows = g if rows is None else rows.unionByName(g)
    extra = [F.count_if(~F.col("base") & F.col("reject") & p).alias(n) for n, p in (("extra_pos", F.col("present")), ("extra_neg", ~F.col("present")))]
    got = rows.groupBy("arm").agg(*M.contest_metrics(F.col("present"), F.col("reject"), F.col("cer")), *extra)
    score = got.where("arm = 'score'").select(F.col("contest").alias("__gl_c"))
    got = got.crossJoin(F.broadcast(score)).withColumn("gain", F.round(F.col("contest") - F.col("__gl_c"), 6)).drop("__gl_c")  # one row
    return {"lift": got.withColumn("go", R.worthwhile(F.col("gain"), F.col("extra_pos")))}


@command
def recognize(cfg: RunConfig, tables: Tables) -> Tables:
    """CERs of texts (uid, lang, ref, asr_text), both normalised here: rows, and a summary by language.

    With `chunks` and `out_dir` the rows are made chunk by chunk in <out_dir>/recognize_chunks, and a restart of the same
    texts and settings does the open chunks only.
    """

    def rated(texts: DataFrame) -> DataFrame:
        t = X.normalize(X.normalize(texts, "ref", "ref_norm"), "asr_text", "hyp_norm")
        return t.withColumn("cer", X.cer(F.coalesce("ref_norm", F.lit("")), F.coalesce("hyp_norm", F.lit("")))).withColumn("decode_tag", F.lit(cfg.decode_tag()))

    if cfg.chunks and cfg.out_dir:
        rows = in_chunks(tables["texts"], ["uid"], cfg.chunks, f"{cfg.out_dir}/recognize_chunks", rated, cfg.decode_tag())
    else:
        rows = rated(tables["texts"])
    return {"rows": rows, "summary": A.recognition_summary(rows.withColumn("reject", F.lit(False)), ["lang"])}


def _cells(cfg: RunConfig, tables: Tables, *keys: str) -> DataFrame:
    return A.score_matrix(tables["cells"].select(*keys, "present", F.round("score", 6).alias("score")), list(keys))


@command
def encoders(cfg: RunConfig, tables: Tables) -> Tables:
    """Best contest of each (encoder, arm) of `cells`, ordered, and the fusion of two scores of `trials`, if given."""
    best = _cells(cfg, tables, "encoder", "arm")
    out = {"leaderboard": best.orderBy(F.desc("contest"), "frr", "encoder", "arm")}
    if "trials" in tables:
        two = _trials(cfg, tables["trials"]).select("present", F.col("score").alias("s1"), F.col("second_score").alias("s2")).where("s1 is not null and s2 is not null")
        out["fusion"] = K.fuse_two(two)
    return out


@command
def presence(cfg: RunConfig, tables: Tables) -> Tables:
    """The matrix of encoders and arms alone."""
    return {"matrix": _cells(cfg, tables, "encoder", "arm")}


@command
def depth(cfg: RunConfig, tables: Tables) -> Tables:
    """Best contest by arm, over encoders apart: how deep a separation pays."""
    best = _cells(cfg, tables, "encoder", "arm")
    return {"depth": best.groupBy("encoder").agg(F.max_by(F.struct("arm", "thr", "contest"), F.struct("contest", "arm")).alias("b")).select("encoder", "b.*")}


@command
def norms(cfg: RunConfig, tables: Tables) -> Tables:
    """Best contest of each norm of a score: `cells` has the norm as its arm."""
    return {"norms": _cells(cfg, tables, "arm")}


@command
def probe(cfg: RunConfig, tables: Tables) -> Tables:
    """CERs of separated streams (uid, arm, stream, cer): best streams, blocks by arm, gains over the mix."""
    u = A.per_utterance(tables["streams"], ["uid"], "arm", "stream", "cer")
    arms = u.groupBy("arm").agg(F.count("*").alias("n"), F.round(F.avg("least"), 6).alias("mean_least"), F.round(F.avg("most"), 6).alias("mean_most"))
    mix = u.where("arm = 'no_sep'").select("uid", F.col("least").alias("mix"))
    gains = u.where("arm <> 'no_sep'").join(mix, "uid").select("uid", "arm", F.round(F.col("mix") - F.col("least"), 6).alias("gain"))
    return {"utterances": u, "arms": arms, "gains": J.top(gains, [F.desc("gain"), F.asc("uid"), F.asc("arm")], 20), "hurts": J.top(gains, [F.asc("gain"), F.asc("uid"), F.asc("arm")], 20)}


@command
def compare(cfg: RunConfig, tables: Tables) -> Tables:
    """Runs side by side: every table is the trials of a pipeline of that name."""
    rows = None
    for name, t in sorted(tables.items()):
        one = _metrics(_gated(cfg, _trials(cfg, t))).withColumn("pipeline", F.lit(name))
        rows = one if rows is None else rows.unionByName(one)
    return {"pipelines": rows.orderBy(F.desc("contest"), "pipeline")}


@command
def manifest(cfg: RunConfig, tables: Tables) -> Tables:
    """The two manifests of `samples`."""
    from gatelight.operators import manifest as N

    return {"enrolment": N.projected(tables["samples"], N.ENROL_FIELDS), "command": N.projected(tables["samples"], N.COMMAND_FIELDS)}


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path) if path.endswith((".jsonl", ".json")) else spark.read.parquet(path)


def main(argv: list[str] | None = None) -> int:
    """python -m gatelight COMMAND --table NAME=PATH ... --out FOLDER; settings from GATELIGHT_* variables."""
    p = argparse.ArgumentParser(prog="gatelight", description=main.__doc__)
    p.add_argument("command", choices=sorted(COMMANDS))
    p.add_argument("--table", action="append", default=[], metavar="NAME=PATH")
    p.add_argument("--out", required=True)
    args = p.parse_args(argv)
    cfg = RunConfig.from_env().resolved()
    spark = SparkSession.builder.appName(f"gatelight {args.command}").getOrCreate()
    tables = {name: _read(spark, path) for name, _, path in (t.partition("=") for t in args.table)}
    for name, df in COMMANDS[args.command](cfg, tables).items():
        df.write.mode("overwrite").parquet(f"{args.out}/{args.command}/{name}")
        print(f"{args.out}/{args.command}/{name}")
    return 0
