"""Long work in chunks: each chunk's rows are committed with its line in a ledger, and a restart does the open ones."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> dict | None:
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, line: dict) -> None:
    """Under another name first, so that a line is there whole or not at all."""
    p, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    try:
        out.write(bytearray(json.dumps(line).encode()))
    finally:
        out.close()
    fs.delete(p, False)
    if not fs.rename(part, p):
        raise OSError(f"{path} can't be written")


def chunk_of(keys: list[str], chunks: int):
    return F.pmod(F.xxhash64(*keys), F.lit(chunks)).cast("int")


def in_chunks(tasks: DataFrame, keys: list[str], chunks: int, out: str, work: Callable[[DataFrame], DataFrame], tag: str = "", most: int | None = None) -> DataFrame | None:
    """`work` of all `tasks`, done chunk by chunk under `out`; what earlier calls have done is kept.

    Tasks are dealt to chunks by a hash of their keys. A chunk's rows are written to a folder of its own, and then
    its line in the ledger: tag, number of tasks, and a sum of their hashes. A chunk whose line says the same is
    done; any other one, open, cut off or of other tasks or another tag, is done anew. With `most` the call stops
    after so many chunks, and returns None if some are left; else it returns the rows of all.

    The driver has one line for each chunk. Chunks run one after the other, each over all executors. An empty
    chunk has a line and no rows.
    """
    spark = tasks.sparkSession
    dealt = tasks.withColumn("__gl_chunk", chunk_of(keys, chunks))
    digest = F.sum(F.xxhash64(*tasks.columns).cast("decimal(20,0)"))
    now = {r["__gl_chunk"]: (r["n"], str(r["digest"])) for r in dealt.groupBy("__gl_chunk").agg(F.count("*").alias("n"), digest.alias("digest")).collect()}
    left, folders = most, []
    for k in range(chunks):
        n, sums = now.get(k, (0, "0"))
        line, folder = {"chunk": k, "tag": tag, "tasks": n, "digest": sums}, f"{out}/chunk={k}"
        if _read(spark, f"{out}/_ledger/{k}.json") != line:
            if left == 0:
                return None
            left = None if left is None else left - 1
            if n:
                work(dealt.where(F.col("__gl_chunk") == k).drop("__gl_chunk")).write.mode("overwrite").parquet(folder)
            _write(spark, f"{out}/_ledger/{k}.json", line)
        if n:
            folders.append(folder)
    if not folders:
        return work(tasks.limit(0))
    return spark.read.schema(spark.read.parquet(folders[0]).schema).parquet(*folders)


def ledger(spark: SparkSession, out: str, chunks: int) -> list[dict]:
    """The lines of the chunks that are done."""
    return [line for k in range(chunks) if (line := _read(spark, f"{out}/_ledger/{k}.json")) is not None]
