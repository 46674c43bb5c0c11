"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet in a join by seeds, runs of `min_tile` words that both hold. An item
covered to the threshold shares a known least number of its seeds, so it need only be looked up by the
rarest of them, all but that number less one: seeds that very many items share open no pairs. For each
pair the longest matches that do not overlap are marked again and again, found by running Karp-Rabin
hashes over what is still unmarked; the covered part of the item decides, so reordered passages count
like ordered ones.

The benchmark stays a table. All that goes to every task is a filter of 2 ** FILTER_BITS bits, whatever
the benchmark's size, over the items' seeds; a larger benchmark lets more through it, and the join decides. Of a
document only the stretches of seeds that pass are sent on. Equal texts are one row before the join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelight.llm import common as C

MIN_TILE = 5
MIN_COVERAGE = 0.5
#: log2 of the bits of the filter of seeds: 4 MB.
FILTER_BITS = 25

TILES = "array<struct<item_start:long,length:long>>"


def greedy_tiles(doc: np.ndarray, item: np.ndarray, min_tile: int) -> list[tuple[int, int, int]]:
    """(doc start, item start, length) of the tiles; 0 in `doc` never matches.

    Longest first, ties by item start, then doc start.
    """
    free_d, free_i = doc != 0, np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    s = min(len(item), len(doc))
    while s >= min_tile:
        hd, hi = C.windows(doc, s, C.M1), C.windows(item, s, C.M1)
        ok_d = C.windows(free_d.astype(np.uint64), s, np.uint64(1)) == s
        ok_i = C.windows(free_i.astype(np.uint64), s, np.uint64(1)) == s
        where: dict[int, list[int]] = {}
        for j in np.flatnonzero(ok_i):
            where.setdefault(int(hi[j]), []).append(int(j))
        found: list[tuple[int, int, int]] = []
        if where:
            for p in np.flatnonzero(ok_d & np.isin(hd, np.fromiter(where, np.uint64, len(where)))).tolist():
                for j in where[int(hd[p])]:
                    if np.array_equal(doc[p : p + s], item[j : j + s]):
                        n = s
                        while p + n < len(doc) and j + n < len(item) and free_d[p + n] and free_i[j + n] and doc[p + n] == item[j + n]:
                            n += 1
                        found.append((n, j, p))
        longest = max((n for n, _, _ in found), default=0)
        if longest > s:  # the longest matches go first
            found = [x for x in found if x[0] == longest]
        for n, j, p in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_d[p : p + n].all() and free_i[j : j + n].all():
                free_d[p : p + n] = free_i[j : j + n] = False
                tiles.append((p, j, n))
        if not found:  # next length: halve, then the least
            s = s // 2 if s // 2 > min_tile else (min_tile if s > min_tile else 0)
        elif longest == s:
            s -= 1
    return tiles


def item_seeds(benchmark: DataFrame, item_col: str, text_col: str, min_tile: int) -> tuple[DataFrame, DataFrame]:
    """(items, places): items with item_id and key; for each different word sequence (key) its words as
    `item`, and the seed and number of each place."""
    kind = pa.list_(pa.int64())

    def run(batches):
        words = C.Tokenizer("plain")
        for batch in batches:
            for part in C.text_slices(batch, "text"):
                h, counts = words(part.column("text").to_pylist())
                ends, rows = np.cumsum(counts), []
                for i, (end, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True)):
                    if n >= min_tile:
                        own = h[end - n : end]
                        rows.append((i, hashlib.md5(own.tobytes()).digest(), own.tobytes(), C.mix(C.windows(own, min_tile, C.M1)).view(np.int64)))
                ids = part.column("item_id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], kind)], names=["item_id", "key", "item", "seeds"])

    base = benchmark.select(F.col(item_col).cast("long").alias("item_id"), C.octets(text_col).alias("text"))
    rows = C.materialize(base.mapInArrow(C.streaming(run), "item_id long, key binary, item binary, seeds array<long>"))
    return rows.select("item_id", "key").distinct(), rows.dropDuplicates(["key"]).select("key", "item", "seeds")


def telling_seeds(items: DataFrame, min_tile: int, threshold: float) -> DataFrame:
    """(seed, key): the rarest seeds of each item, enough that no covered item is missed.

    Tiles of n words hold n - min_tile + 1 seeds, never less than n / min_tile, so the seeds at
    `needed` places of a covered item match.
    """
    places = items.select("key", F.size("seeds").alias("n"), F.posexplode("seeds").alias("place", "seed"))
    often = places.groupBy("seed").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("often", "seed", "place"))
    length = F.col("n") + (min_tile - 1)
    needed = F.greatest(F.lit(1), F.ceil(length * F.lit(threshold) / min_tile - F.lit(1e-9)))
    ranked = places.join(often, "seed").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.col("n") - needed + 1).select("seed", "key").distinct()


def seed_filter(items: DataFrame) -> np.ndarray:
    """Bits of all seeds, as bytes; a table of fixed size."""
    bits = items.select(F.explode("seeds").alias("seed")).select(F.shiftrightunsigned("seed", 64 - FILTER_BITS).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.view(np.uint8)


def stretches(docs: DataFrame, bits: np.ndarray, min_tile: int) -> DataFrame:
    """`docs` (id, text) as rows (id, key, part, seeds) of the documents with seeds that pass the filter.

    key is a digest of the text; part the word hashes that such seeds cover, stretches apart by a 0.
    """
    held = docs.sparkSession.sparkContext.broadcast(bits.tobytes())
    kind = pa.list_(pa.int64())

    def run(batches):
        table, words = np.frombuffer(held.value, np.uint8), C.Tokenizer("plain")
        for batch in batches:
            for part in C.text_slices(batch, "text"):
                texts = part.column("text").to_pylist()
                h, counts = words(texts)
                seeds = C.mix(C.windows(h, min_tile, C.M1))
                bit = (seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                at = np.flatnonzero((table[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1)
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, at, side="right")
                at, doc = at[at + min_tile <= ends[doc]], doc[at + min_tile <= ends[doc]]
                rows = []
                for d in np.unique(doc).tolist():
                    own = at[doc == d]
                    covered = np.unique((own[:, None] + np.arange(min_tile)).ravel())
                    cuts = np.flatnonzero(np.diff(covered) > 1) + 1
                    parts = [x for run_ in np.split(covered, cuts) for x in (h[run_], np.zeros(1, np.uint64))]
                    rows.append((d, hashlib.md5(texts[d]).digest(), np.concatenate(parts).tobytes(), np.unique(seeds[own]).view(np.int64)))
                ids = part.column("id").take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], kind)], names=["id", "key", "part", "seeds"])

    schema = f"id {docs.schema['id'].dataType.simpleString()}, key binary, part binary, seeds array<long>"
    return docs.select("id", C.octets("text").alias("text")).mapInArrow(C.streaming(run), schema)


def _pairs(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, min_tile: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, items, pairs): rows of documents with seeds, rows of items, and of their different texts
    the pairs covered to the threshold, with coverage and tiles."""
    items, sequences = item_seeds(benchmark, item_col, item_text_col, min_tile)
    hits = C.materialize(stretches(docs, seed_filter(sequences), min_tile))
    texts = hits.dropDuplicates(["key"])
    seeds = telling_seeds(sequences, min_tile, threshold).withColumnRenamed("key", "item_key")
    met = texts.select("key", F.explode("seeds").alias("seed")).join(seeds, "seed").select("key", "item_key").distinct()
    sides = met.join(texts.select("key", "part"), "key").join(sequences.select(F.col("key").alias("item_key"), "item"), "item_key")

    def run(batches):
        kind = pa.list_(pa.struct([("item_start", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            rows = []
            for i, (part, item) in enumerate(zip(batch.column("part").to_pylist(), batch.column("item").to_pylist(), strict=True)):
                item = np.frombuffer(item, np.uint64)
                tiles = greedy_tiles(np.frombuffer(part, np.uint64), item, min_tile)
                coverage = sum(x[2] for x in tiles) / len(item)
                if tiles and coverage >= threshold:
                    rows.append((i, coverage, [{"item_start": j, "length": n} for _, j, n in sorted(tiles, key=lambda x: x[1])]))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("key").take(at), batch.column("item_key").take(at), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], kind)], names=["key", "item_key", "coverage", "tiles"])

    pairs = sides.select("key", "item_key", "part", "item").mapInArrow(C.streaming(run), f"key binary, item_key binary, coverage double, tiles {TILES}")
    return hits, items, pairs


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                       item_text_col: str = "text", min_tile: int = MIN_TILE, threshold: float = MIN_COVERAGE) -> DataFrame:
    """Rows (doc_id, item_id, coverage, n_tiles, tiles) of every pair covered to the threshold.

    Words are lower-cased (ASCII and Latin-1) and lose ASCII characters other than letters and digits;
    words left empty don't count. Null or empty texts and items of fewer than `min_tile` words match
    nothing. Repeated rows of documents give repeated pairs; repeated rows of the benchmark (same id and
    words) count once. Null ids are kept. Of tiles equally long that of the first place in the item, then in the
    document, goes first. An empty documents or benchmark table gives no rows; further columns, whatever
    their names, are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hits, items, pairs = _pairs(base, benchmark, item_col, item_text_col, min_tile, threshold)
    out = pairs.join(items.withColumnRenamed("key", "item_key"), "item_key").join(hits.select("id", "key"), "key")
    return out.select(F.col("id").alias("doc_id"), "item_id", "coverage", F.size("tiles").cast("long").alias("n_tiles"), "tiles")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  min_tile: int = MIN_TILE, threshold: float = MIN_COVERAGE) -> DataFrame:
    """`docs`, columns unchanged, without the documents that hold a benchmark item.

    Cases as for `contaminated_pairs`; rows with null texts stay.
    """
    base = docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text"))
    found = C.materialize(_pairs(base, benchmark, item_col, item_text_col, min_tile, threshold)[2].select(F.hex("key").alias("__gl_md5")).distinct())
    marked = docs.withColumn("__gl_md5", F.upper(F.md5(C.octets(text_col))))
    return marked.join(found, "__gl_md5", "left_anti").drop("__gl_md5")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, one row for each such pair."""
    return contaminated_pairs(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
