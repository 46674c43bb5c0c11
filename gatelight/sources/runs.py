"""Folders of runs: threshold files, stream listings, experiment cells, summaries, stream dumps."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelight.functions.vector import rms
from gatelight.sources.records import read_json_document, read_threshold, wav_bytes

THRESHOLD_FILE = "reports/presence_calib/recommended_thr.json"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(conf).exists(at))


def threshold_file(spark: SparkSession, explicit: str | None, run: str, shared: str | None, default: str) -> str:
    """The first threshold file there is: the one given, the run's, its parent's, the shared one; else the default's path."""
    if explicit:
        return explicit
    for root in (run, run.rstrip("/").rpartition("/")[0], shared):
        if root and exists(spark, f"{root}/{THRESHOLD_FILE}"):
            return f"{root}/{THRESHOLD_FILE}"
    return f"{default}/{THRESHOLD_FILE}"


def threshold(spark: SparkSession, value: float | None, path: str, default: float = 0.25) -> DataFrame:
    """(thr, thr_by_lang): a value that is not negative counts alone, else the file, else the default."""
    if value is not None and value >= 0:
        return spark.range(1).select(F.lit(float(value)).alias("thr"), F.lit(None).cast("map<string, double>").alias("thr_by_lang"))
    return read_threshold(spark, path, default)


def listing(spark: SparkSession, root: str, glob: str = "*.wav") -> DataFrame:
    """(path) of the files under a folder, without their contents; none if the folder is missing."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], "path string")
        raise


def stream_files(files: DataFrame, include_mix: bool = False) -> DataFrame:
    """(arm, split, uid, stream, path) of files d1/<split>/<uid>/<stream>.wav and d2/...: of d1 the tracks d1_*, of d2 all but `peak`;
    a mix of d1 is the stream of the arm without separation, and of the others only if wanted."""
    found = files.where(F.col("path").rlike(r"/d[12]/[^/]+/[^/]+/[^/]+\.wav$"))
    part = lambda i: F.substring_index(F.substring_index("path", "/", i - 5), "/", 1)  # noqa: E731  of the last four
    got = found.select("path", F.substr(part(1), F.lit(2)).alias("depth"), part(2).alias("split"), part(3).alias("uid"), F.regexp_replace(part(4), r"\.wav$", "").alias("stream")).where("stream <> 'peak'")
    mix, once = F.col("stream") == "mix", F.col("depth") == "1"
    arms = F.array_compact(F.array(
        F.when(mix & once, F.lit("no_sep")), F.when(once & (F.startswith("stream", F.lit("d1_")) | (mix & F.lit(include_mix))), F.lit("sep_once")),
        F.when(~once & (~mix | F.lit(include_mix)), F.lit("sep_multi")),
    ))
    return got.select(F.explode(arms).alias("arm"), "split", "uid", "stream", "path")


def with_fallback(streams: DataFrame, samples: DataFrame, files: DataFrame) -> DataFrame:
    """`streams` with the command file itself as the mix of samples (split, uid, cmd_wav) that have none, where the file exists."""
    have = streams.where("arm = 'no_sep'").select("split", "uid")
    own = samples.join(have, ["split", "uid"], "left_anti").join(files.select(F.col("path").alias("cmd_wav")).distinct(), "cmd_wav", "left_semi")
    return streams.unionByName(own.select(F.lit("no_sep").alias("arm"), "split", "uid", F.lit("mix").alias("stream"), F.col("cmd_wav").alias("path")))


def read_cells(spark: SparkSession, reports: str) -> DataFrame:
    """(encoder, arm, uid, score, present) of all folders <encoder>__<arm> with a scores.jsonl, split at the first two underscores."""
    schema = "uid string, label string, presence_score double"
    rows = spark.read.schema(schema).json(f"{reports}/*__*/scores.jsonl").select("*", F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1).alias("cell"))
    at = F.instr("cell", "__")
    return rows.select(
        F.substr("cell", F.lit(1), at - 1).alias("encoder"), F.substr("cell", at + 2).alias("arm"), F.coalesce("uid", F.lit("")).alias("uid"), F.col("presence_score").alias("score"),
        F.coalesce(F.col("label").isin("present", "pos", "1", "true"), F.lit(False)).alias("present"),
    )


def run_summaries(spark: SparkSession, roots: dict[str, str], run_file: str = "reports/run_summary.json") -> DataFrame:
    """One flat row for each named root, from the three JSON documents it may hold: run, recognition and threshold."""
    run = "overall struct<n: long, n_accept: long, rr: double, latency_ms: struct<p50: double>>, splits struct<pos: struct<frr: double>, neg: struct<rr: double, far: double>>, meta struct<tse_backend: string, pipeline: string>"
    rows = []
    for name, root in roots.items():
        a = read_json_document(spark, f"{root}/{run_file}", run).select(
            F.coalesce("meta.tse_backend", "meta.pipeline").alias("backend"), "overall.n", "overall.n_accept", F.coalesce("splits.neg.rr", "overall.rr").alias("rr"), F.col("splits.pos.frr").alias("frr"),
            F.col("splits.neg.far").alias("far"), F.col("overall.latency_ms.p50").alias("latency_p50_ms"),
        )
        b = read_json_document(spark, f"{root}/reports/asr_cer/summary.json", "contest struct<contest_score: double, cer: double>").select("contest.contest_score", "contest.cer")
        c = read_threshold(spark, f"{root}/{THRESHOLD_FILE}", float("nan")).select(F.nanvl("thr", F.lit(None).cast("double")).alias("thr"))
        rows.append(a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c)).select(F.lit(name).alias("root"), "*"))  # one row each
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def overlay_source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records with `key` from JSON Lines or a JSON array, by the file's name: their uid, or pos_<id>."""
    rows = spark.read.schema(schema).option("multiLine", path.endswith(".json")).json(path)
    uid = F.nullif(F.col("uid"), F.lit("")) if "uid" in rows.columns else F.lit(None).cast("string")
    return rows.withColumn("key", F.coalesce(uid, F.concat(F.lit("pos_"), F.col("id").cast("string"))))


def dump_streams(streams: DataFrame, path: str, wav: str = "wav") -> DataFrame:
    """Writes WAV bytes of (uid, stream, wav) as a table in folders by stream, and returns what was written: (uid, stream, n, rms)."""
    streams.select("uid", "stream", F.size(wav).alias("n"), F.round(rms(F.transform(wav, lambda x: x.cast("double"))), 8).alias("rms"), wav_bytes(wav).alias("content")).write.mode("overwrite").partitionBy("stream").parquet(path)
    return streams.sparkSession.read.parquet(path).select("uid", "stream", "n", "rms")


def snapshot(df: DataFrame, run: str, name: str) -> str:
    """A manifest or threshold table copied into a run's folder; an earlier copy is replaced."""
    path = f"{run}/inputs/{name}"
    df.write.mode("overwrite").parquet(path)
    return path


def usable_threshold(found: DataFrame, column: Column, expected: bool) -> DataFrame:
    """`found` where its threshold was made with the same setting as the run; a difference raises, an unknown setting passes."""
    differs = F.raise_error(F.lit("the threshold was calibrated with another enrolment setting")).cast("boolean")
    return found.withColumn("compatible", F.when(column.isNull(), F.lit(None).cast("boolean")).when(column == expected, F.lit(True)).otherwise(differs))
