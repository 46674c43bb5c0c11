"""What the corpus operators share: the shared folder, block-wise text access, hashes of words."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than ASCII white space; bytes.split() does just that.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text handled at once in a Python worker.
CHUNK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max

M1 = np.uint64(0x9E3779B97F4A7C15)
M2 = np.uint64(0xD6E8FEB86659FD93)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, by spark.checkpoint.dir or the context's checkpoint folder.

    Where both are unset, a folder of our own in local mode, whose driver and executor are one process;
    elsewhere an error, as executors can't read each other's folders.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gatelight-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Shuffle files go when a query has ended, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder; shuffle files of the query are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gatelight-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._gl_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of `materialize` that nothing will read any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._gl_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def octets(col: str) -> Column:
    return F.col(col).cast("binary")


#: Input bytes of a group from which the freed memory is given back after it.
LARGE_GROUP = 1 << 20


def give_back() -> None:
    """Return freed memory to the system: idle workers live on, and would hold what they once took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def streaming(f):
    """`f` for mapInArrow, giving its memory back at the end."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run


def grouped(f):
    """`f` for applyInArrow over a group, giving its memory back after a large one."""

    def run(t):
        out = f(t)
        if t.nbytes > LARGE_GROUP:
            give_back()
        return out

    return run


def cogrouped(f):
    """`grouped` for two tables."""

    def run(t, back):
        out = f(t, back)
        if t.nbytes + back.nbytes > LARGE_GROUP:
            give_back()
        return out

    return run


def text_slices(batch: pa.RecordBatch | pa.Table, text_col: str, limit: int = CHUNK_BYTES):
    """Consecutive row slices of at most `limit` text bytes, one row at least."""
    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.cast(pc.binary_length(batch.column(text_col)), pa.int64()), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False) if isinstance(sizes, pa.Array) else sizes.to_numpy())
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


class Tokenizer:
    """Word hashes of many texts at once, by array operations on their bytes.

    A word's hash is a polynomial in its bytes modulo 2**64, read off running sums and finalised
    by `mix`. fold: "" takes words as they are; "lower" lower-cases A-Z; "plain" also lower-cases
    Latin-1 letters and drops ASCII characters other than letters and digits, so that a word may
    vanish. stems: numbers of leading bytes whose hashes follow each word's own as further entries.
    """

    def __init__(self, fold: str = "", stems: tuple[int, ...] = ()):
        self.stems = stems
        rng = np.random.Generator(np.random.PCG64(20240229))
        self.table = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.fold = fold
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        if fold:
            self.table[65:91] = self.table[97:123]
        self.keep = np.ones(256, bool)
        if fold == "plain":
            self.keep[:128] = False
            self.keep[[*range(48, 58), *range(65, 91), *range(97, 123), 9, 10, 11, 12, 13, 32]] = True
        self.grow(1 << 20)

    def grow(self, n: int) -> None:
        base = np.uint64(0xD1342543DE82EF95)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.power, self.unpower = np.full(n, base), np.full(n, inverse)
        self.power[0] = self.unpower[0] = 1
        np.cumprod(self.power, out=self.power)
        np.cumprod(self.unpower, out=self.unpower)

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all words in a row, number of hashes of each text)."""
        parts, counts, at = [], np.zeros(len(texts), np.int64), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size < 1 << 20):
                size += len(texts[to] or b"") + 1
                to += 1
            h, counts[at:to] = self._some(texts[at:to])
            parts.append(h)
            at = to
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), counts

    def _some(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or b"" for t in texts]
        buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        if self.fold == "plain":
            up = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
            if len(up):
                buf = buf.copy()
                buf[up] += 0x20
            keep = self.keep[buf]
            ends = np.cumsum(keep)[ends - 1]
            buf = buf[keep]
        n = len(buf)
        if n > len(self.power):
            self.grow(n)
        sums = self.table[buf]
        sums *= self.power[:n]
        np.cumsum(sums, out=sums)
        space = self.space[buf]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1  # starts and ends of words in turn
        if not space[0]:
            edge = np.concatenate((np.zeros(1, edge.dtype), edge))
        start, end = edge[0::2], edge[1::2]
        h = sums[end - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))
        h *= self.unpower[start]
        counts = np.diff(np.searchsorted(start, ends), prepend=0)
        if not self.stems:
            return mix(h), counts
        all_h = [mix(h)]
        for k in self.stems:
            stop = np.minimum(start + k, end)
            part = sums[stop - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))
            all_h.append(mix(part * self.unpower[start] + np.uint64(k * int(M1) % (1 << 64))))
        return np.stack(all_h, 1).ravel(), counts * len(all_h)


def windows(h: np.ndarray, k: int, mult: np.uint64) -> np.ndarray:
    """Polynomial hash of every k consecutive entries, modulo 2**64."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    acc = h[:n].copy()
    for i in range(1, k):
        acc *= mult
        acc += h[i : i + n]
    return acc


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads all bits; a bijection."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def inside(counts: np.ndarray, k: int, n_windows: int) -> np.ndarray:
    """Which of the windows of k entries over the concatenation lie in one text."""
    ends = np.repeat(np.cumsum(counts), counts)[:n_windows]
    return np.arange(n_windows) + k <= ends


def replace_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop input columns that the operator is about to add, whatever their case."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def n_parts(amount: float, each: float) -> int:
    return max(1, math.ceil(amount / each))
