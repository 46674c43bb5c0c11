"""N-gram Jaccard join: set-relation skipping inside tasks, lossless signatures between them.

Equal sets are one class. Two sets over the threshold differ in few shingles, so of slightly more
parts than that, cut by hash, one at least is the same in both: classes that share a part's
signature come into one cluster, and no link leads out of a cluster. Sizes are cut into intervals,
and clusters are formed for each interval by itself: of its own sets, and of those of the interval
below that may link with them. A cluster's sets then meet in a task, large clusters in pairs of
tiles, where an index of rare-first prefixes with blocks by position is skipped along for every set, and
the sizes of a set's intersections are derived from those of a highly similar pivot.

Parts that hold few shingles, or only very frequent ones (by counts over all documents, in a table of
fixed size), prove little; there are some more parts than needed, so that the weakest can go. Two sets
that share a part all the same must also have digests of some bits a shingle, the parities of their bins,
that differ in no more bits than linked sets differ in shingles: most pairs that meet by chance don't, and
bring no sets into a cluster. Signatures that many sets have join them unchecked.
"""

from __future__ import annotations

import zlib
from collections import deque
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelight.llm import common as C
from gatelight.llm.components import connected_components

SHINGLE = 4
THRESHOLD = 85
#: log2 of the bins that shingles are counted in (a bit each goes to every task), slices of them.
SKETCH_BITS = 20
SLICES = 64
#: A shingle is frequent if its bin has this many times the mean, and this many at least.
HOT_TIMES, HOT_LEAST = 3, 64
#: Signatures of a group; shingles and sets of a tile.
GROUP_ENTRIES = 600_000
TILE_SHINGLES = 1_500_000
TILE_SETS = 512
#: Sets of a signature up to which all their pairs are held against the sets' parities; more are joined in a chain.
PAIRED_SETS = 16
#: Bits of parities a shingle, bits at least.
PARITY_BITS, PARITY_LEAST = 0.75, 128
#: Pivots kept: sets with the sizes of their intersections.
PIVOTS = 4

U = np.uint64


def scaled(x: np.uint64, n: int) -> np.uint64:
    return U(int(x) * n % (1 << 64))


class Sets:
    """Distinct shingle hashes of texts, each text's sorted."""

    def __init__(self, k: int):
        self.k, self.words = k, C.Tokenizer("lower")

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        h, counts = self.words(texts)
        w, ends, out = C.mix(C.windows(h, self.k, C.M1)), np.cumsum(counts), []
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= self.k:
                out.append(np.unique(w[end - n : end - self.k + 1]))
            elif n:
                out.append(C.mix(C.windows(h[end - n : end], n, C.M1) + scaled(C.M2, n)))
            else:
                out.append(np.zeros(0, U))
        return out


def digests(s: np.ndarray) -> tuple[int, int]:
    """A set's 128-bit digest as two signed integers."""
    a, b = C.mix(s * C.M1).sum(dtype=U), C.mix(s ^ C.M2).sum(dtype=U)
    return tuple(C.mix(np.array([a, b ^ U(len(s))])).view(np.int64).tolist())


class Parts:
    """Signatures of a set for threshold t in percent.

    Sizes fall into intervals, each but the first beginning over 1/t of the former's begin, so that linked sets lie in
    the same interval or in adjacent ones; a set signs for its own interval and as the smaller side
    for the next. With both sizes up to `hi` the sets differ in at most d = 2 hi (100 - t) / (100 + t)
    shingles; of m parts then at least m - d are the same. A set signs by d + 1 parts, those with the
    most shingles that aren't frequent, in an order by content: the first in it of the parts that are
    the same stands before m - d - 1 others on both sides, so both sign by it.
    """

    def __init__(self, t: int, hot: np.ndarray | None):
        self.t, self.hot, lows = t, hot, [1]
        while lows[-1] < 1 << 40:
            lows.append(lows[-1] * 100 // t + 1)
        self.lows = np.array(lows, np.int64)

    def interval(self, sizes):
        return np.searchsorted(self.lows, sizes, side="right") - 1

    def __call__(self, s: np.ndarray) -> list[np.ndarray]:
        """The signatures for the own interval, and those for the next."""
        j, out = int(self.interval(len(s))), []
        cold = ~self.hot[s >> U(64 - SKETCH_BITS)] if self.hot is not None else np.ones(len(s), bool)
        for scheme in (j, j + 1):
            hi = int(self.lows[scheme + 1]) - 1
            differ = 2 * hi * (100 - self.t) // (100 + self.t)
            m = differ + 3 + ceil(differ / 8)
            x = C.mix(s ^ scaled(C.M2, scheme + 1))
            part = ((x >> U(32)) * U(m)) >> U(32)
            order = np.argsort(part, kind="stable")
            part, x, own = part[order], C.mix(x)[order], cold[order]
            at = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            telling, sums = np.zeros(m, np.int64), np.zeros(m, U)
            telling[part[at]], sums[part[at]] = np.add.reduceat(own.astype(np.int64), at), np.add.reduceat(x, at)
            label = np.lexsort((np.arange(m), sums, -telling))[: differ + 1].astype(U)
            sums = sums[label]
            out.append(C.mix(sums + label * C.M1 + scaled(C.M2, scheme)))
        return out


    def parities(self, s: np.ndarray) -> list[bytes]:
        """For the own interval, and for the next: of each of a number of bins whether it has an odd number of shingles.

        The number is one for all sets of a scheme. A shingle that only one of two sets has turns one bit, so
        they differ in at least as many shingles as bits.
        """
        j, out = int(self.interval(len(s))), []
        for scheme in (j, j + 1):
            n = 8 * ceil(max(PARITY_LEAST, PARITY_BITS * int(self.lows[scheme + 1])) / 8)
            out.append(np.packbits(np.bincount(((s >> U(32)) * U(n) >> U(32)).astype(np.int64), minlength=n) & 1).tobytes())
        return out


def may_link(x: list[bytes], y: list[bytes], nx: np.ndarray, ny: np.ndarray, t: int) -> np.ndarray:
    """Which pairs of sets can link by their parities: 100 * intersection >= t * union, in terms of what differs."""
    out = np.ones(len(x), bool)
    for i, (a, b) in enumerate(zip(x, y, strict=True)):
        if a is not None and b is not None and len(a) == len(b):
            differ = (int.from_bytes(a, "little") ^ int.from_bytes(b, "little")).bit_count()
            out[i] = (100 + t) * differ <= (100 - t) * (int(nx[i]) + int(ny[i]))
    return out


def linked(overlap, nx, ny, t: int):
    """100 * intersection >= t * union, in whole numbers."""
    return (100 + t) * overlap >= t * (nx + ny)


def join_sets(sets: list[np.ndarray], t: int, left: np.ndarray | None = None, counts=None) -> list[np.ndarray]:
    """For each set the numbers of the other sets that it links with.

    With `left`, only links between a set of the left and one of the others count (a pair of tiles);
    with `counts`, only those with the sets that counts(x) marks for set x.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets) if m else np.zeros(0, U)
    vocab, tokens, freq = np.unique(flat, return_inverse=True, return_counts=True)
    rare = np.empty(len(vocab), np.int64)
    rare[np.argsort(freq, kind="stable")] = np.arange(len(vocab))  # rank: rare first
    tokens = rare[tokens]
    ends = np.cumsum(sizes)
    rows = [np.sort(tokens[e - n : e]) for e, n in zip(ends, sizes, strict=True)]
    flat = np.concatenate(rows) if m else np.zeros(0, np.int64)
    begins = ends - sizes
    mark = np.zeros(len(vocab), bool)
    out: list = [None] * m

    def overlaps(x: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections with others."""
        if not len(others):
            return np.zeros(0, np.int64)
        mark[rows[x]] = True
        part = mark[np.concatenate([rows[y] for y in others])]
        mark[rows[x]] = False
        return np.add.reduceat(part.astype(np.int64), np.concatenate(([0], np.cumsum(sizes[others])[:-1])))

    # index: of each token of a prefix the sets, by position in the set; block: eight positions
    prefix = sizes - -(-t * sizes // 100) + 1
    entry_set = np.repeat(np.arange(m), prefix)
    entry_pos = np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)
    entry_token = flat[np.repeat(begins, prefix) + entry_pos]
    order = np.lexsort((entry_set, entry_pos // 8, entry_token))
    entry_set, entry_pos, entry_token = entry_set[order], entry_pos[order], entry_token[order]
    key = entry_token * (1 << 24) + entry_pos // 8

    def candidates(x: int, fair: np.ndarray) -> np.ndarray:
        n, p = int(sizes[x]), int(prefix[x])
        top = rows[x][:p]
        most = n * 100 // t
        need = -(-t * (n + most) // (100 + t))
        last = max(most - need, 0) // 8  # in later blocks no set has enough left
        lo = np.searchsorted(key, top * (1 << 24))
        hi = np.searchsorted(key, top * (1 << 24) + last, side="right")
        take = hi - lo
        at = np.repeat(lo - (np.cumsum(take) - take), take) + np.arange(take.sum())
        y, i = entry_set[at], np.repeat(np.arange(p), take)
        ny = sizes[y]
        room = 1 + np.minimum(n - i - 1, ny - entry_pos[at] - 1)
        fits = linked(np.minimum(n, ny), n, ny, t) & ((100 + t) * room >= t * (n + ny)) & fair[y] & (y != x)
        return np.unique(y[fits])

    pivots: deque = deque(maxlen=PIVOTS)  # sets with the sizes of their intersections, -1 where unknown
    for x in range(m):
        n = int(sizes[x])
        fair = np.ones(m, bool) if counts is None else counts(x)
        if left is not None:
            fair = fair & (left != left[x])
        y = candidates(x, fair)
        for (pivot, known), common in zip(pivots, overlaps(x, np.array([p for p, _ in pivots], np.int64)).tolist(), strict=True):
            only_x, only_pivot = n - common, int(sizes[pivot]) - common
            if only_x + only_pivot > n // 10 or not len(y):
                continue
            # from the pivot's sizes: intersections lose at most only_pivot and gain at most only_x
            low, high = known[y] - only_pivot, np.minimum(known[y] + only_x, n)
            sure = (known[y] >= 0) & linked(low, n, sizes[y], t)
            open_ = np.flatnonzero((known[y] < 0) | (~sure & linked(high, n, sizes[y], t)))
            if len(open_) <= max(8, len(y) // 2):
                hit = sure
                hit[open_] = linked(overlaps(x, y[open_]), n, sizes[y[open_]], t)
                break
        else:
            got = overlaps(x, y)
            hit = linked(got, n, sizes[y], t)
            if len(y) > 8:
                known = np.full(m, -1)
                known[y], known[x] = got, n
                pivots.appendleft((x, known))
        out[x] = y[hit]
    return out


def _facts(docs: DataFrame, k: int, t: int) -> DataFrame:
    """Of each row id, mark (as in `docs`), n, d1, d2, parities (kind 0); of each task the shingle counts in slices (kind 1)."""
    per = (1 << SKETCH_BITS) // SLICES

    def run(batches):
        sets, parts, bins = Sets(k), Parts(t, None), np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["kind", "id", "mark", "n", "d1", "d2", "own_bits", "next_bits", "blob"]
        for batch in batches:
            for part in C.text_slices(batch, "text"):
                got = sets(part.column(1).to_pylist())
                flat = np.concatenate(got)
                bins += np.bincount((flat >> U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(bins))
                d = [digests(s) if len(s) else (None, None) for s in got]
                bits = [parts.parities(s) if len(s) else (None, None) for s in got]
                yield pa.RecordBatch.from_arrays([
                    pa.array([0] * len(got), pa.int32()), part.column(0), part.column(2), pa.array([len(s) for s in got], pa.int64()),
                    pa.array([x for x, _ in d], pa.int64()), pa.array([x for _, x in d], pa.int64()),
                    pa.array([x for x, _ in bits], pa.binary()), pa.array([x for _, x in bits], pa.binary()), pa.nulls(len(got), pa.binary()),
                ], names=names)
        if bins.any():
            blobs = [zlib.compress(bins[s * per : (s + 1) * per].astype("<u4").tobytes(), 1) for s in range(SLICES)]
            none, empty = pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([1] * SLICES, pa.int32()), pa.array(range(SLICES), pa.int64()), none, none, none, none, empty, empty, pa.array(blobs, pa.binary())], names=names)

    return docs.mapInArrow(C.streaming(run), "kind int, id long, mark long, n long, d1 long, d2 long, own_bits binary, next_bits binary, blob binary")


def _hot(facts: DataFrame) -> np.ndarray:
    """Which bins are frequent: 2 ** SKETCH_BITS bits, whatever the corpus' size."""

    def total(t: pa.Table) -> pa.Table:
        out = 0
        for blob in t.column("blob").to_pylist():
            out = out + np.frombuffer(zlib.decompress(blob), "<u4").astype(np.int64)
        return pa.table([t.column("id").slice(0, 1), pa.array([zlib.compress(out.tobytes(), 1)], pa.binary())], names=["id", "blob"])

    rows = facts.where("kind = 1").select("id", "blob").groupBy("id").applyInArrow(total, "id long, blob binary").collect()
    bins = np.zeros(1 << SKETCH_BITS, np.int64)
    per = len(bins) // SLICES
    for r in rows:
        bins[r["id"] * per : (r["id"] + 1) * per] = np.frombuffer(zlib.decompress(r["blob"]), np.int64)
    return bins > max(HOT_LEAST, HOT_TIMES * bins.mean())


def _clusters(docs: DataFrame, live: DataFrame, k: int, t: int, hot: np.ndarray, n_signatures: int) -> DataFrame:
    """(node, root): of the classes that share a signature with another one they may link with, and their cluster.

    A class is two nodes: d1 with the last bit set in its own interval's clusters, with the last bit
    unset in the next one's. Signatures that no set of the interval itself has join nothing. `live` has
    the classes' n, d1 and parities, in as many rows as there are.
    """
    buckets = C.n_parts(n_signatures, GROUP_ENTRIES)
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(hot).tobytes())

    def sign(batches):
        sets, parts = Sets(k), Parts(t, np.unpackbits(np.frombuffer(bits.value, np.uint8)).astype(bool))
        seen: set[int] = set()
        sigs, nodes, size = [], [], 0

        def flush():
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            bucket = (C.mix(sig ^ C.M1) % U(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, sig, node = bucket[order], sig[order], node[order]
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            blobs = [sig[i:j].tobytes() + node[i:j].tobytes() for i, j in zip(at, np.append(at[1:], len(sig)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in batches:
            for part in C.text_slices(batch, "text"):
                for s in sets(part.column(1).to_pylist()):
                    if len(s) and (node := digests(s)[0]) not in seen:  # equal sets sign once in a task
                        if len(seen) < 1_000_000:
                            seen.add(node)
                        for x, name in zip(parts(s), (node | 1, node & ~1), strict=True):
                            sigs.append(x)
                            nodes.append(np.full(len(x), name))
                            size += len(x)
                if size > 1_000_000:
                    yield flush()
                    sigs, nodes, size = [], [], 0
        if size:
            yield flush()

    def meet(t: pa.Table) -> pa.Table:
        """Edges between all nodes of a signature, or along the nodes of one that many have (held)."""
        sig, node = [], []
        for blob in t.column("blob").to_pylist():
            n = len(blob) // 16
            sig.append(np.frombuffer(blob, U, n))
            node.append(np.frombuffer(blob, np.int64, n, 8 * n))
        sig, node = np.concatenate(sig), np.concatenate(node)
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        new = np.append(True, (sig[1:] != sig[:-1]) | (node[1:] != node[:-1]))  # equal sets sign in several tasks
        sig, node = sig[new], node[new]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        long = np.diff(np.append(first, len(sig)))
        own, many = np.repeat(np.maximum.reduceat(node & 1, first) > 0, long), np.repeat(long > PAIRED_SETS, long)
        pairs = []
        for far in range(1, max(PAIRED_SETS, 2)):
            same = sig[far:] == sig[:-far]
            at = np.flatnonzero(same & ~many[far:] & ((node[far:] | node[:-far]) & 1 > 0))
            pairs.append(np.stack([node[at], node[at + far], np.zeros(len(at), np.int64)], 1))
            if far == 1:
                at = np.flatnonzero(same & many[1:] & own[1:])
                pairs.append(np.stack([node[at], node[at + 1], np.ones(len(at), np.int64)], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        return pa.table([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2] > 0)], names=["a", "b", "held"])

    def fits(batches):
        for batch in batches:
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            fine = may_link([v["bits"] for v in x], [v["bits"] for v in y], [v["n"] for v in x], [v["n"] for v in y], t)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()).filter(pa.array(fine)), pa.array(b, pa.int64()).filter(pa.array(fine))], names=["a", "b"])

    met = docs.mapInArrow(C.streaming(sign), "bucket int, blob binary").groupBy("bucket").applyInArrow(C.grouped(meet), "a long, b long, held boolean")
    met = C.materialize(met.groupBy("a", "b").agg(F.max("held").alias("held")))
    # a node's last bit is not the digest's; sets of one digest but for that have no parities to be judged by
    bits = live.select(F.shiftright("d1", 1).alias("key"), F.struct("n", "own_bits", "next_bits").alias("set")).groupBy("key").agg(F.min("set").alias("set"), F.max("set").alias("other"))
    pairs = met.where("not held").select("a", "b")
    for node, to in (("a", "x"), ("b", "y")):
        side = F.when(F.col("set") == F.col("other"), F.when(F.col(node).bitwiseAND(1) == 1, F.col("set.own_bits")).otherwise(F.col("set.next_bits")))
        pairs = pairs.withColumn("key", F.shiftright(node, 1)).join(bits.hint("merge"), "key").withColumn(to, F.struct("set.n", side.alias("bits"))).drop("key", "set", "other")
    pairs = pairs.mapInArrow(fits, "a long, b long")
    out = connected_components(pairs.union(met.where("held").select("a", "b")))
    C.discard(met)
    return out


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, t: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows have id, mark (a hash of the text), n, d1, d2; classes are the different
    sets that have an id, with d1, d2, node, root and n_links. A node is struct<rep, d1, d2>, where rep is
    the least id of the set, and root the least node of its component."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), C.octets(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    facts = C.materialize(_facts(base, k, t))
    hot = _hot(facts)
    own = facts.where("kind = 0").select("id", "mark", "n", "d1", "d2")
    live = facts.where("kind = 0 and id is not null and n > 0")
    total = live.agg(F.sum("n")).first()[0] or 0
    classes = live.groupBy("d1", "d2").agg(F.min(F.struct("id", "mark")).alias("least"), F.count("*").alias("copies"), F.first("n").alias("n"))
    classes = classes.select("d1", "d2", F.col("least.id").alias("rep"), F.col("least.mark").alias("mark"), "copies", "n")
    roots = _clusters(base.where("id is not null"), live, k, t, hot, int(total * 0.4))
    sides = F.explode(F.array(F.struct(F.expr("d1 | 1L").alias("node"), F.lit(True).alias("own")), F.struct(F.expr("d1 & ~1L").alias("node"), F.lit(False).alias("own"))))
    members = classes.select("*", sides.alias("side")).select("rep", "mark", "d1", "d2", "copies", "n", "side.*").join(roots, "node").drop("node")
    sums = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).where("m > 1")
    tiles = F.greatest(F.ceil(F.col("total") / TILE_SHINGLES), F.ceil(F.col("m") / TILE_SETS)).cast("int")
    members = members.join(sums, "root").withColumn("tiles", tiles)
    place = F.struct("root", "own", "tiles", F.pmod(F.xxhash64("d1", "d2"), F.col("tiles")).cast("int").alias("tile"))
    members = C.materialize(members.groupBy("rep", "mark", "d1", "d2", "copies").agg(F.collect_list(place).alias("places")))  # two at most

    def build(batches):
        sets = Sets(k)
        for batch in batches:
            for part in C.text_slices(batch, "text"):
                got = sets(part.column(batch.schema.get_field_index("text")).to_pylist())
                d1, d2 = part.column(batch.schema.get_field_index("d1")).to_pylist(), part.column(batch.schema.get_field_index("d2")).to_pylist()
                fine = [i for i, s in enumerate(got) if len(s) and digests(s) == (d1[i], d2[i])]  # an id may have other texts
                rest = part.select(["rep", "d1", "d2", "copies", "places"]).take(pa.array(fine, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rest.columns, pa.array([got[i].tobytes() for i in fine], pa.binary())], names=[*rest.schema.names, "shingles"])

    # never a broadcast: members grow with the corpus, and the plan is the same at every size
    # equal rows are merged before the exchange, so a class has one text however often its row stands there
    one = base.where("id is not null").dropDuplicates(["id", "mark"])
    texts = one.join(members.withColumnRenamed("rep", "id").hint("merge"), ["id", "mark"]).select(F.col("id").alias("rep"), "copies", "places", "d1", "d2", "text")
    sets = texts.mapInArrow(C.streaming(build), "rep long, d1 long, d2 long, copies long, places array<struct<root:long,own:boolean,tiles:int,tile:int>>, shingles binary")
    keep = ["rep", "d1", "d2", "copies"]
    sets = sets.select(*keep, F.explode("places").alias("place"), "shingles").select(*keep, "place.*", "shingles")
    pair = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = sets.select("root", *keep, "own", "tile", pair.alias("other"), "shingles")
    dealt = dealt.select("root", *keep, "own", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "shingles")

    intervals = Parts(t, None)
    node_type = pa.struct([("rep", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def links(g: pa.Table) -> pa.Table:
        """Edges (a, b), and rows (a, null) with the number of linked rows in `n`; a set has a row for each interval."""
        keys = np.stack([g.column(c).to_numpy() for c in ("rep", "d1", "d2")], 1)
        keys, first, which = np.unique(keys, axis=0, return_index=True, return_inverse=True)  # repeated rows
        own = np.zeros(len(first), bool)
        np.logical_or.at(own, which.ravel(), g.column("own").to_numpy())
        blobs = g.column("shingles")
        sets = [np.frombuffer(blobs[int(i)].as_py(), U) for i in first]
        order = np.lexsort((np.arange(len(first)), [len(s) for s in sets]))
        sets, first, own, keys = [sets[i] for i in order], first[order], own[order], keys[order]
        level = intervals.interval(np.array([len(s) for s in sets]))
        copies, tile = g.column("copies").to_numpy()[first], g.column("tile").to_numpy()[first]
        cross = g.column("i")[0].as_py() != g.column("j")[0].as_py()

        def counts(x):
            """Each link counts in one cluster: that of the larger set's interval."""
            return np.where(level == level[x], own & own[x], np.where(level > level[x], own, own[x]))

        found = join_sets(sets, t, tile if cross else None, counts)
        parent = np.arange(len(first))  # edges as a forest

        def top(x):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        a, b, n = [], [], []
        for x, ys in enumerate(found):
            if len(ys):
                a.append(x)
                b.append(-1)
                n.append(int(copies[ys].sum()))
            for y in ys[ys < x].tolist():
                p, q = top(x), top(y)
                if p != q:
                    parent[p] = q
                    a.append(x)
                    b.append(y)
                    n.append(0)

        def nodes(at):
            at = np.array(at, np.int64)
            cols = [pa.array(keys[at, c]) for c in range(3)]
            return pa.StructArray.from_arrays(cols, fields=list(node_type), mask=pa.array(at < 0))

        return pa.table([nodes(a), nodes(b), pa.array(n, pa.int64())], names=["a", "b", "n"])

    node = "struct<rep:long,d1:long,d2:long>"
    found = C.materialize(dealt.groupBy("root", "i", "j").applyInArrow(C.grouped(links), f"a {node}, b {node}, n long"))
    C.discard(members)
    comp = connected_components(found.where("b is not null").select("a", "b"))
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_other"))
    classes = classes.withColumn("node", F.struct("rep", "d1", "d2")).join(comp, "node", "left").join(counts, "node", "left")
    return own, classes.select("d1", "d2", "node", F.coalesce("root", "node").alias("root"), (F.coalesce("n_other", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, t: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links), a row for each row of `docs`.

    Texts are sets of distinct k-word shingles, A-Z lower-cased; with fewer words the whole sequence
    is the one shingle. Two rows link when 100 * intersection >= t * union; component_id is the least
    id reachable by links, n_links the number of other rows linked with. Null texts and texts without
    words have no shingles and link with nothing. Rows without id link with nothing and have no
    component. Rows of one id and different texts are different rows with the same id, in the same or in
    different components. Other columns aren't read. An empty table gives no rows; a long text is one set.
    """
    own, classes = _classes(docs, id_col, text_col, k, t)
    classes = classes.select("d1", "d2", F.col("root.rep").alias("component"), "n_links")
    keyed = own.withColumn("live", F.col("id").isNotNull() & (F.col("n") > 0))
    out = keyed.where("live").join(classes, ["d1", "d2"]).select("id", "n", "component", "n_links")
    out = out.unionByName(keyed.where("not live").select("id", "n", F.col("id").alias("component"), F.lit(0).cast("long").alias("n_links")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "n_links")


def keep_representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, t: int = 80) -> DataFrame:
    """`docs`, columns unchanged, with one row of each component of `join_components`: one of the least
    id, of several alike texts of that id one. Rows of one id whose texts are not alike stay, as they are
    in different components; of rows of the same id and text one stays. Rows without id or without words
    stay. An empty table gives an empty one.
    """
    own, classes = _classes(docs, id_col, text_col, k, t)
    first = classes.where("node = root").select("d1", "d2", F.col("root.rep").alias("id"))
    keep = own.where("id is not null and n > 0").join(first, ["id", "d1", "d2"]).groupBy("id", "d1", "d2").agg(F.min("mark").alias("mark"))
    keep = keep.select(F.col("id").alias("__gl_id"), F.col("mark").alias("__gl_mark"))
    text = F.col(f"`{text_col}`")
    base = docs.withColumn("__gl_id", F.col(f"`{id_col}`").cast("long")).withColumn("__gl_mark", F.xxhash64(C.octets(text_col)))
    live = F.col("__gl_id").isNotNull() & F.coalesce(text.cast("string").rlike(C.WORD_PATTERN), F.lit(False))
    # equal rows are merged before the exchange, so one repeated without end is one row a task
    some = base.where(live).dropDuplicates(["__gl_id", "__gl_mark"]).join(keep.hint("merge"), ["__gl_id", "__gl_mark"], "left_semi")
    return some.select(*docs.columns).unionByName(base.where(~live).select(*docs.columns))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`join_components` of `documents`: 4-word shingles, 85 percent."""
    return join_components(C.table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT w.doc_id, count(g)::BIGINT AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
d AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT n.doc_id, n.n AS n_shingles, min(root) AS component_id, coalesce(max(k), 0)::BIGINT AS n_links
FROM n JOIN r ON r.node = n.doc_id LEFT JOIN d ON d.a = n.doc_id GROUP BY n.doc_id, n.n
"""
