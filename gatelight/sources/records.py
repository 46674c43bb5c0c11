"""JSON Lines, JSON and WAV sources and sinks."""

from __future__ import annotations

import io
import json
import wave

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType, StructType

from gatelight.operators.relational import keep_last


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False, ordinal: str | None = None) -> DataFrame:
    """Strict scan; with missing_ok an absent path gives no rows. `ordinal` names a column of line numbers."""
    try:
        if ordinal:
            return _numbered_jsonl(spark, path, schema, ordinal)
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    except AnalysisException:
        if missing_ok:
            empty = spark.createDataFrame([], schema)
            return empty.withColumn(ordinal, F.lit(0).cast("long")).limit(0) if ordinal else empty
        raise


def line_ordinals(spark: SparkSession, path: str, ordinal: str = "n") -> DataFrame:
    """(value, `ordinal`): the lines of text files that aren't blank, numbered from 0 by file name and place in it.

    A file is read in splits. A line's number is that of its split's first line, a running sum of counts over
    the splits before it, plus its place in the split. Neither depends on where files are cut or on which
    task reads what, and lines are never brought together: only the counts of the splits are, a row for each.
    """
    meta = F.col("_metadata")
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S")).select("value", meta["file_path"].alias("__gl_file"), meta["file_block_start"].alias("__gl_at"), F.monotonically_increasing_id().alias("__gl_id"))
    splits = lines.groupBy("__gl_file", "__gl_at").agg(F.count("*").alias("__gl_c"))
    in_file = Window.partitionBy("__gl_file").orderBy("__gl_at").rowsBetween(Window.unboundedPreceding, -1)
    files = splits.groupBy("__gl_file").agg(F.sum("__gl_c").alias("__gl_all"))
    before = Window.orderBy("__gl_file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    zero = F.lit(0).cast("long")
    files = files.select("__gl_file", F.coalesce(F.sum("__gl_all").over(before), zero).alias("__gl_base"))
    begins = splits.withColumn("__gl_in", F.coalesce(F.sum("__gl_c").over(in_file), zero)).join(files, "__gl_file")
    begins = begins.select("__gl_file", "__gl_at", (F.col("__gl_base") + F.col("__gl_in")).alias("__gl_begin"))
    # a split is read by one task in the order of its lines, so that ids within it rise
    place = F.row_number().over(Window.partitionBy("__gl_file", "__gl_at").orderBy("__gl_id")) - 1
    return lines.withColumn("__gl_place", place).join(begins, ["__gl_file", "__gl_at"]).select("value", (F.col("__gl_begin") + F.col("__gl_place")).alias(ordinal))


def _numbered_jsonl(spark: SparkSession, path: str, schema: StructType | str, ordinal: str) -> DataFrame:
    lines = line_ordinals(spark, path, "__gl_n")
    kind = schema if isinstance(schema, str) else schema.simpleString()
    parsed = lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r"), "__gl_n")
    return parsed.select("r.*", F.col("__gl_n").alias(ordinal))


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_document(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """One row; malformed or missing documents give a row of nulls."""
    try:
        got = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).limit(1)
    except AnalysisException:
        got = spark.createDataFrame([], schema)
    one = spark.range(1)
    return one.join(got, F.lit(True), "left").drop("id") if "id" not in got.columns else got


def read_threshold(spark: SparkSession, path: str, default: float) -> DataFrame:
    """(thr, thr_by_lang): presence_thr, else the recommended one, else the default."""
    schema = "presence_thr double, recommended struct<thr: double>, thr_by_lang map<string, double>"
    return read_json_document(spark, path, schema).select(F.coalesce("presence_thr", "recommended.thr", F.lit(default)).alias("thr"), "thr_by_lang")


def enrolment_index(index: DataFrame, ordinal: str) -> DataFrame:
    """Usable enrolments: ok unless said otherwise, with a uid, the last of each uid."""
    return keep_last(index.where(F.coalesce("ok", F.lit(True)) & (F.coalesce("uid", F.lit("")) != "")), ["uid"], ordinal)


def first_filled(*cols: str):
    """The first of the aliased columns that isn't empty, else an empty text."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in cols], F.lit(""))


def resolve_path(rows: DataFrame, files: DataFrame, choices: list) -> DataFrame:
    """`rows` with resolved: the first of the choices (path columns) that `files` (path) lists."""
    listed = files.select(F.col("path").alias("__gl_path")).distinct()
    out, found = rows, []
    for i, c in enumerate(choices):
        mine = listed.select(F.col("__gl_path").alias(f"__gl_p{i}"))
        out = out.join(mine, c == F.col(f"__gl_p{i}"), "left")
        found.append(F.col(f"__gl_p{i}"))
    return out.withColumn("resolved", F.coalesce(*found)).drop(*[f"__gl_p{i}" for i in range(len(choices))])


def speaker_of(path):
    """Speaker id from a file's name: SSB and four digits, else the name without a numeric suffix."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    coded = F.coalesce(F.regexp_substr(name, F.lit(r"SSB\d{4}")), F.lit(""))
    return F.when(coded != "", coded).otherwise(F.regexp_replace(name, r"[_-]?\d+$", ""))


def decode_wav(data: bytes, rate: int = 16000) -> np.ndarray:
    """Mono float samples at `rate`: channels averaged, other rates resampled linearly."""
    with wave.open(io.BytesIO(data)) as w:
        raw, width, channels, own = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 2:
        x = np.frombuffer(raw, "<i2").astype(np.float32) / 32768
    elif width == 3:
        x = np.pad(np.frombuffer(raw, np.uint8).reshape(-1, 3), ((0, 0), (1, 0))).view("<i4").ravel().astype(np.float32) / 2**31
    else:
        x = np.frombuffer(raw, "<i4").astype(np.float32) / 2**31
    x = x.reshape(-1, channels).mean(1)
    if own != rate and len(x):
        x = np.interp(np.arange(0, len(x), own / rate), np.arange(len(x)), x).astype(np.float32)
    return x


def encode_wav(samples, rate: int = 16000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


@F.pandas_udf(ArrayType(FloatType()))
def wav_samples(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else decode_wav(b))


@F.pandas_udf(BinaryType())
def wav_bytes(samples: pd.Series) -> pd.Series:
    return samples.map(lambda x: None if x is None else encode_wav(x))


def read_wavs(spark: SparkSession, path: str) -> DataFrame:
    """(path, speaker, wav) of all .wav files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)
    return files.select("path", speaker_of(F.col("path")).alias("speaker"), wav_samples("content").alias("wav"))


def write_jsonl(df: DataFrame, path: str, append: bool = False, by: list[str] | None = None) -> None:
    """Nulls are kept as fields; `by` fans out to folders."""
    w = df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false")
    (w.partitionBy(*by) if by else w).json(path)


def report_json(df: DataFrame, path: str) -> dict:
    """The first row as a JSON document."""
    got = df.first().asDict(True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(got, f, ensure_ascii=False, indent=2, default=str)
    return got


def report_markdown(title: str, df: DataFrame, most: int = 100) -> str:
    """A table of a small aggregate."""
    rows = df.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)]) + "\n"


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """One CSV folder for each sheet."""
    for name, df in sheets.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")
