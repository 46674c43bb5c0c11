"""Sub-manifests, joins of samples with results and scores, stream jobs, packing and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelight.functions import text as X
from gatelight.functions import vector as V
from gatelight.operators.relational import keep_last

# Fields of the two manifests that a sample manifest splits into.
ENROL_FIELDS = {"uid": "uid", "split": "split", "id": "id", "enroll_wav": "enroll_path", "wake_text": "wake_text", "lang": "lang", "enroll_source": "enroll_source"}
COMMAND_FIELDS = {"uid": "uid", "split": "split", "id": "id", "cmd_wav": "cmd_path", "cmd_text": "cmd_text", "label": "label"}


def projected(samples: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Fields of the samples under their names in a sub-manifest; fields that samples lack are null texts."""
    return samples.select(*[(F.col(c) if c in samples.columns else F.lit(None).cast("string")).alias(n) for c, n in fields.items()])


def existing(rows: DataFrame, files: DataFrame, needed: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose needed paths are all listed in files, the others with the names of the missing ones)."""
    listed = files.select(F.col("path").alias("__gl_path")).distinct()
    out = rows
    for i, c in enumerate(needed):
        out = out.join(listed.select(F.col("__gl_path").alias(f"__gl_f{i}")), F.col(c) == F.col(f"__gl_f{i}"), "left")
    gaps = F.array_compact(F.array(*[F.when(F.col(f"__gl_f{i}").isNull(), F.lit(c)) for i, c in enumerate(needed)]))
    out = out.withColumn("missing", gaps).drop(*[f"__gl_f{i}" for i in range(len(needed))])
    return out.where(F.size("missing") == 0).drop("missing"), out.where(F.size("missing") > 0)


def with_results(samples: DataFrame, results: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Every sample with `result`, the struct of its last result, null where there is none."""
    last = keep_last(results, [key], ordinal)
    return samples.join(last.select(F.col(key), F.struct(*[F.col(c) for c in last.columns if c != key]).alias("result")), key, "left")


def same_label(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """Rows of both cells by key; a key whose labels differ raises when the rows are read."""
    other = b.withColumnRenamed(label, "__gl_label")
    differs = F.raise_error(F.concat(F.lit("labels differ for "), F.col(key).cast("string"))).cast(a.schema[label].dataType)
    return a.join(other, key).withColumn(label, F.when(F.col(label).eqNullSafe(F.col("__gl_label")), F.col(label)).otherwise(differs)).drop("__gl_label")


def kept(rows: DataFrame, key: str, *keep: DataFrame) -> DataFrame:
    """Rows whose key stands in any of the keep-sets (tables with the key)."""
    return rows.join(reduce(DataFrame.unionByName, [k.select(key) for k in keep]), key, "left_semi")


def lang_of(rows: DataFrame, samples: DataFrame, key: str, default: str = "zh") -> DataFrame:
    """`rows` with lang: its own if filled, else that of the first sample of the key, else the default."""
    first = samples.groupBy(key).agg(F.min_by("lang", "ordinal").alias("__gl_lang"))
    own = F.nullif(F.col("lang"), F.lit("")) if "lang" in rows.columns else F.lit(None).cast("string")
    return rows.join(first, key, "left").withColumn("lang", F.coalesce(own, F.nullif(F.col("__gl_lang"), F.lit("")), F.lit(default))).drop("__gl_lang")


def stream_jobs(samples: DataFrame, arms: dict[str, list[str]], listing: DataFrame, key: str) -> DataFrame:
    """(key, arm, stream, found): a job for each stream of each arm, and whether `listing` (key, arm, stream) has it."""
    names = F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(s).alias("stream")) for a, streams in arms.items() for s in streams])
    jobs = samples.select(key, F.explode(names).alias("j")).select(key, "j.*")
    return jobs.join(listing.select(key, "arm", "stream").distinct().withColumn("__gl_hit", F.lit(True)), [key, "arm", "stream"], "left").select(
        key, "arm", "stream", F.coalesce("__gl_hit", F.lit(False)).alias("found")
    )


def loud_streams(streams: DataFrame, wav: str, least: float) -> DataFrame:
    """Streams at or over a loudness; the mix stays whatever its own."""
    return streams.where((F.col("stream") == "mix") | (V.rms(F.col(wav)) >= least))


def accepted_negatives(rows: DataFrame) -> DataFrame:
    """Negatives that the gate let through: those whose words are transcribed."""
    return rows.where((F.col("split") == "neg") & ~F.coalesce(F.startswith("decision", F.lit("reject")), F.lit(False)))


def other_reasons(rows: DataFrame, usual: str = "speaker_absent", most: int = 50) -> DataFrame:
    """A report of at most `most` rejected rows whose reason isn't the usual one, by uid."""
    odd = F.startswith("decision", F.lit("reject")) & ~F.coalesce(F.col("reason") == usual, F.lit(False))
    return rows.where(odd).orderBy("uid").limit(most)


def truthy(*values: Column) -> Column:
    """The first value that is neither null, zero nor empty; null if none is."""
    return F.coalesce(*[F.when(v.cast("string").isin("", "0", "0.0", "false"), None).otherwise(v) for v in values])


def packed(rows: DataFrame, locked: Column | None = None) -> DataFrame:
    """One shape for records of positives and negatives.

    Of score, thr, hyp and label the first filled of two names counts (zero and empty are not filled); a positive that
    the file didn't accept has CER 1, as it has no transcript; `locked` replaces the file's threshold.
    """
    has = lambda c, t: F.col(c) if c in rows.columns else F.lit(None).cast(t)
    score = F.coalesce(truthy(has("presence_score", "double"), has("second_score", "double")), F.lit(0.0))
    file_thr = F.coalesce(truthy(has("presence_thr", "double"), has("thr", "double")), F.lit(0.0))
    thr = file_thr if locked is None else locked
    decision = F.coalesce(has("decision", "string"), F.lit(""))
    rejected = F.startswith(decision, F.lit("reject")) | F.coalesce(has("reject_decision", "boolean"), F.lit(False))
    accepted = ~rejected & (decision == "accept")
    return rows.select(
        "uid", "split", "lang", F.when((F.col("split") == "pos") & ~accepted, 1.0).otherwise(has("cer", "double")).alias("cer"), score.alias("score"), thr.alias("thr"), file_thr.alias("file_thr"),
        F.coalesce(truthy(has("asr_text", "string"), has("hyp", "string")), F.lit("")).alias("hyp"), F.coalesce(truthy(has("cmd_text", "string"), has("label", "string")), F.lit("")).alias("label"),
        rejected.alias("file_rej"), (score < thr).alias("base_rej"), accepted.alias("orig_accept"),
    )


def recognition_input(source: Column, extracted: Column, command: Column) -> Column:
    """The waveform a recogniser reads: the command's own for `mix`, else the extracted one if there is one."""
    return F.when(F.lower(F.trim(F.coalesce(source, F.lit("extracted")))) == "mix", F.nullif(command, F.lit(""))).otherwise(F.nullif(extracted, F.lit("")))


def features(wake: Column, command: Column, hyp: Column) -> dict[str, Column]:
    """Text features of a row of normalised texts; without a command its language is `na`."""
    wl, hl = X.text_lang(wake), X.text_lang(hyp)
    cl = F.when(command == "", "na").otherwise(X.text_lang(command))
    differ = lambda a, b: a.isin("zh", "en") & b.isin("zh", "en") & (a != b)
    return {
        "empty": hyp == "", "hyp_len": F.length(hyp), "hyp_lang": hl, "wake_lang": wl, "cmd_lang": cl, "wake_cmd_lang_mismatch": differ(cl, wl), "wake_hyp_lang_mismatch": differ(hl, wl),
        "cmd_hyp_lang_mismatch": differ(cl, hl), "looks_command": X.looks_command(hyp), "has_device": X.has_any(hyp, X.DEVICES), "has_act": X.has_any(hyp, X.ACTS), "has_slot": X.has_any(hyp, X.SLOTS),
        "has_digit": hyp.rlike(X.DIGITS), "wake_in_hyp": X.wake_in_hyp(wake, hyp), "wake_only": X.wake_only(wake, hyp), "code_switch_hyp": hl == "mix",
    }


def feature_buckets() -> dict[str, Column]:
    """The fifteen conditions that CERs are summarised by, on columns of `features`."""
    c, n = F.col, F.col("hyp_len")
    return {
        "all": F.lit(True), "wake_cmd_match": ~c("wake_cmd_lang_mismatch"), "wake_cmd_mismatch": c("wake_cmd_lang_mismatch"), "hyp_cmd_lang_mismatch": c("cmd_hyp_lang_mismatch"),
        "hyp_has_wake": c("wake_in_hyp"), "code_switch_hyp": c("code_switch_hyp"), "cmd_zh": c("cmd_lang") == "zh", "cmd_en": c("cmd_lang") == "en", "wake_zh": c("wake_lang") == "zh",
        "wake_en": c("wake_lang") == "en", "len_le4": n <= 4, "len_5_12": n.between(5, 12), "len_ge13": n >= 13, "looks_command": c("looks_command"), "not_command": ~c("looks_command"),
    }
