"""Substring dedup by prefix-partitioned suffix trees.

A repeat of min_words words (a window) holds the same run of GRAM words with the least hash at the same
place in all its copies: its anchor. So it is enough to put the suffixes that begin at anchors into
trees, each with the few words before it that its windows take up. A suffix whose anchor occurs in one
document only isn't sent.

Suffixes are dealt by a prefix to groups that fit a task, and the prefix is as long as it must be: words
are added until, by the corpus' word counts, few enough suffixes should share it. A prefix that still
has too many suffixes, by exact count, goes on over the whole window. Short prefixes share a group. A
group's suffixes are sorted by their words; the lengths of the prefixes common to neighbours give the
internal nodes, each with its own depth. A window that begins o words before its anchor is a repeat if
the suffix lies under an internal node of depth min_words - o or more in which some other suffix has the
same o words before it. Trees are cut where no window reaches; adjacent repeats chain up to longer ones.

Documents are dealt to blocks once, their texts compressed, and that exchange is read three times.
Within a block equal suffixes are merged before anything is sent: a passage that a third of all
documents hold is one suffix for each block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.llm import common as C

MIN_WORDS = 13
GRAM = 7
#: Text bytes of a block, anchors and suffixes of a group of prefixes, suffixes expected of a prefix.
BLOCK_BYTES = 6 << 20
GROUP_ANCHORS = 600_000
GROUP_SUFFIXES = 150_000
PREFIX_SUFFIXES = 20_000
#: Suffixes of one anchor, by exact count, from which its windows are dealt one by one.
HOT_PREFIX = 50_000
BINS = 4096
#: Least bytes of a text or of a group's part of a block that are worth compressing.
SMALL = 64

ROWS = "bucket int, block int, blob binary"


def census(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Text bytes, and words by bin of their hash: BINS numbers, whatever the corpus' size."""

    def run(batches):
        words, size, bins = C.Tokenizer(), 0, np.zeros(BINS, np.int64)
        for batch in batches:
            for part in C.text_slices(batch, "__gl_text"):
                texts = part.column(0).to_pylist()
                size += sum(len(t) for t in texts if t)
                bins += np.bincount((words(texts)[0] & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS + 1), pa.int32()), pa.array([*bins.tolist(), size], pa.int64())], names=["bin", "n"])

    rows = docs.select("__gl_text").mapInArrow(C.streaming(run), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BINS + 1, np.int64)
    for r in rows:
        out[r["bin"]] = r["n"]
    return int(out[BINS]), out[:BINS]


def in_order(t: pa.Table) -> pa.Table:
    """A block's rows by id and text. Places in a block are sent from one task to the next, which reads the
    block anew: rows come as the shuffle fetches them, in another order each time where there are several executors.
    """
    return t.take(pc.sort_indices(t, sort_keys=[("__gl_id", "ascending"), ("__gl_text", "ascending")]))


class Block:
    """A block's documents: words, windows, and the stretches of windows of one anchor.

    A stretch is a run of consecutive windows with the anchor at the same place: first window, number of
    windows, place of the anchor, document.
    """

    def __init__(self, t: pa.Table, k: int):
        self.k, self.texts = k, [inflate(x) for c in t.column("__gl_text").chunks for x in c.to_pylist()]
        ids = t.column("__gl_id").combine_chunks().fill_null(C.NO_ID)
        self.ids = np.asarray(ids.to_numpy(zero_copy_only=False) if isinstance(ids, pa.Array) else ids.to_numpy())
        self.h, self.counts = C.Tokenizer()(self.texts)
        self.gram = min(k, max(GRAM, k - 100))  # places fit a byte
        g = C.mix(C.windows(self.h, self.gram, C.M1))
        n = max(len(self.h) - k + 1, 0)
        start = np.flatnonzero(C.inside(self.counts, k, n)) if n else np.zeros(0, np.int64)
        low, place = g[:n].copy(), np.zeros(n, np.int64)
        for j in range(1, k - self.gram + 1):
            less = g[j : j + n] < low
            place[less] = j
            np.minimum(low, g[j : j + n], out=low)
        place = place[start] + start
        at = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1))) if len(start) else np.zeros(0, np.int64)
        self.windows = start
        self.first, self.place, self.n = start[at], place[at], np.diff(np.append(at, len(start)))
        self.anchor = g[self.place]
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)

    def digests(self, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for all words of each stretch."""
        if not hasattr(self, "labels"):
            self.labels = C.windows(self.h, self.k, C.M1), C.windows(C.mix(self.h ^ C.M2), self.k, C.M2)
        return tuple(C.mix(d[first] * C.M1 + d[first + n - 1] + n.astype(np.uint64) * C.M2) for d in self.labels)


def deflate(x: bytes | None) -> bytes | None:
    if x is None:
        return None
    z = pa.compress(x, codec="zstd", asbytes=True) if len(x) >= SMALL else x
    return len(x).to_bytes(6, "little") + z if len(z) < len(x) else b"\xff" * 6 + x


def inflate(z: bytes | None) -> bytes | None:
    if z is None:
        return None
    return z[6:] if z[:6] == b"\xff" * 6 else pa.decompress(z[6:], int.from_bytes(z[:6], "little"), codec="zstd", asbytes=True)


def _split(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by bucket, begins and ends of the buckets in it."""
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    return order, at, np.append(at, len(bucket))[1:]


def _pack(bucket: np.ndarray, columns: list[np.ndarray], block: int) -> pa.Table:
    """A row for each bucket: its entries, column by column."""
    order, at, ends = _split(bucket)
    columns = [c[order] for c in columns]
    blobs = [b"".join(c[i:j].tobytes() for c in columns) for i, j in zip(at, ends, strict=True)]
    return pa.table([pa.array(bucket[order][at].astype(np.int32)), pa.array(np.full(len(at), block, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "block", "blob"])


def _unpack(t: pa.Table, kinds: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """(block of each entry, columns) of a bucket's rows."""
    width = sum(np.dtype(k).itemsize for k in kinds)
    blocks, columns = [], [[] for _ in kinds]
    for block, blob in zip(t.column("block").to_pylist(), t.column("blob").to_pylist(), strict=True):
        n, at = len(blob) // width, 0
        blocks.append(np.full(n, block, np.int32))
        for c, k in zip(columns, kinds, strict=True):
            c.append(np.frombuffer(blob, k, n, at))
            at += n * np.dtype(k).itemsize
    return (np.concatenate(blocks) if blocks else np.zeros(0, np.int32)), [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(columns, kinds, strict=True)]


def _back(block: np.ndarray, columns: list[np.ndarray]) -> pa.Table:
    """Entries to return, a row for each block."""
    t = _pack(block.astype(np.int64), columns, 0)
    return pa.table([t.column("bucket"), t.column("bucket"), t.column("blob")], names=["bucket", "block", "blob"])


#: What a suffix has beside its words: first window's place in the block, words before the anchor,
#: windows, whether several documents of the block have it and whether its prefix is hot, least document.
SHAPE = [np.uint32, np.uint8, np.uint8, np.uint8, np.int64]
HITS = [np.uint32, np.uint8, np.uint8, np.uint8, np.int64]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], ..., first[i] + n[i] - 1 for each i in a row."""
    return np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)


def pack_suffixes(bucket: np.ndarray, h: np.ndarray, shape: list[np.ndarray], k: int, block: int) -> pa.Table:
    """A row for each bucket: shapes, then the words, by a dictionary of the part's own."""
    order, at, ends = _split(bucket)
    shape, blobs = [c[order].astype(t) for c, t in zip(shape, SHAPE, strict=True)], []
    for i, j in zip(at, ends, strict=True):
        own = [c[i:j] for c in shape]
        words, code = np.unique(h[_ranges(own[0].astype(np.int64), own[2].astype(np.int64) + k - 1)], return_inverse=True)
        code = code.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
        head = np.array([j - i, len(words)], np.uint32)
        blobs.append(deflate(b"".join(c.tobytes() for c in (head, *own, words, code))))
    return pa.table([pa.array(bucket[order][at].astype(np.int32)), pa.array(np.full(len(at), block, np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "block", "blob"])


def unpack_suffixes(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(block of each suffix, shapes, word hashes of all suffixes in a row)."""
    blocks, shapes, words = [], [[] for _ in SHAPE], []
    for block, blob in zip(t.column("block").to_pylist(), t.column("blob").to_pylist(), strict=True):
        blob = inflate(blob)
        n, v = np.frombuffer(blob, np.uint32, 2).tolist()
        at = 8
        blocks.append(np.full(n, block, np.int32))
        for c, kind in zip(shapes, SHAPE, strict=True):
            c.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        own = np.frombuffer(blob, np.uint64, v, at)
        words.append(own[np.frombuffer(blob, np.uint16 if v <= 1 << 16 else np.uint32, -1, at + 8 * v)])
    return np.concatenate(blocks), [np.concatenate(c) for c in shapes], np.concatenate(words)


def packed(columns: np.ndarray, size: int) -> list[np.ndarray]:
    """Columns of numbers under `size`, as few keys of 63 bits, the first column in the first key's high bits."""
    bits = max(1, int(size).bit_length())
    each, out = max(1, 63 // bits), []
    for at in range(0, columns.shape[1], each):
        key = np.zeros(len(columns), np.int64)
        for c in range(at, min(at + each, columns.shape[1])):
            key = (key << bits) | columns[:, c]
        out.append(key)
    return out


class Tree:
    """The suffix tree of a group, as sorted suffixes and the lengths of neighbours' common prefixes.

    right has the words from the anchor on, left those before it, the nearest one last; 0 where a
    suffix has no more. common[i] is the depth of the internal node at which suffixes i - 1 and i part.
    """

    def __init__(self, words: np.ndarray, before: np.ndarray, n: np.ndarray, k: int):
        lengths = n + k - 1
        words, rank = np.unique(words, return_inverse=True)
        self.size, reach = len(words) + 1, int(before.max(initial=0))
        grid = np.zeros((len(n), reach + k), np.int64)
        grid[np.repeat(np.arange(len(n)), lengths), _ranges(reach - before, lengths)] = rank + 1
        self.order = np.lexsort(packed(grid[:, reach:], self.size)[::-1])
        grid = grid[self.order]
        self.left, self.right = grid[:, :reach], grid[:, reach:]
        same = (self.right[1:] == self.right[:-1]) & (self.right[1:] > 0)
        self.common = np.concatenate(([0], np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)))

    def nodes(self, depth: int) -> np.ndarray:
        """Of each suffix in order the node of that depth or the first below it on its path."""
        return np.cumsum(self.common < depth)

    def classes(self, some: np.ndarray, depth: int, o: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes `some` ordered by (node of that depth, the o words before), and where classes begin."""
        node = self.nodes(depth)[some]
        keys = [node, *packed(self.left[some, self.left.shape[1] - o :], self.size)] if o else [node]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(some), bool)
        new[:1] = True
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        return order, np.flatnonzero(new)


def repeats(blocks: np.ndarray, shape: list[np.ndarray], words: np.ndarray, k: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(block, HITS columns): of each suffix its runs of windows that a smaller document may have too.

    A run is the suffix's place, its windows, first and number of the run's, and the least document.
    """
    place, before, n, flags, low = (c.astype(np.int64) for c in shape)
    tree = Tree(words, before, n, k)
    before, n, low, several = before[tree.order], n[tree.order], low[tree.order], (flags[tree.order] & 1) > 0
    suffix, window, least = [], [], []
    for o in range(int(before.max(initial=0)) + 1):
        some = np.flatnonzero((before - n < o) & (o <= before))
        if not len(some):
            continue
        order, at = tree.classes(some, k - o, o)
        some = some[order]
        first = np.repeat(np.minimum.reduceat(low[some], at), np.diff(np.append(at, len(some))))
        hit = (first < low[some]) | several[some]
        suffix.append(some[hit])
        window.append(before[some[hit]] - o)
        least.append(first[hit])
    if not suffix:
        return np.zeros(0, np.int32), [np.zeros(0, t) for t in HITS]
    suffix, window, least = np.concatenate(suffix), np.concatenate(window), np.concatenate(least)
    order = np.lexsort((window, suffix))
    suffix, window, least = suffix[order], window[order], least[order]
    at = np.flatnonzero(np.append(True, (suffix[1:] != suffix[:-1]) | (window[1:] != window[:-1] + 1) | (least[1:] != least[:-1]))) if len(suffix) else suffix
    long = np.diff(np.append(at, len(suffix)))
    own = tree.order[suffix[at]]
    return blocks[own], [c.astype(t) for c, t in zip((place[own], shape[2][own] | (shape[3][own] & 2) << 6, window[at], long, least[at]), HITS, strict=True)]


def prefix_groups(h: np.ndarray, start: np.ndarray, log_p: np.ndarray, least: float, k: int) -> np.ndarray:
    """A hash of the prefix of each suffix: as many words, up to k, as bring its expected share to `least`."""
    share, out, open_ = np.zeros(len(start)), np.zeros(len(start), np.uint64), np.ones(len(start), bool)
    for j in range(k):
        w = h[start + j]
        out = np.where(open_, (out + w) * C.M1, out)
        share += log_p[(w & np.uint64(BINS - 1)).astype(np.int64)]
        open_ &= share > least
        if not open_.any():
            break
    return C.mix(out)


def _deal(base: DataFrame, blocks: int, names: list[str]) -> DataFrame:
    """Rows with their block and their compressed text.

    Equal rows go to one block only as far as they stand in one slice of a partition, so that a row
    repeated without end fills no block.
    """

    def run(batches):
        n = 0
        for batch in batches:
            for part in C.text_slices(batch, "__gl_text"):
                n += 1
                salt = part.column("__gl_part").to_numpy().astype(np.uint64) * C.M2 + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))
                block = C.mix(part.column("__gl_hash").to_numpy().view(np.uint64) ^ C.mix(salt)) % np.uint64(blocks)
                text = [deflate(x) for x in part.column("__gl_text").to_pylist()]
                rest = [part.column(c) for c in (*names, "__gl_id")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(text, pa.binary()), pa.array(block.astype(np.int32))], names=[*names, "__gl_id", "__gl_text", "__gl_block"])

    fields = {f.name: f for f in base.schema.fields}
    schema = T.StructType([*[fields[c] for c in (*names, "__gl_id", "__gl_text")], T.StructField("__gl_block", T.IntegerType())])
    base = base.withColumns({"__gl_hash": F.xxhash64("__gl_id", "__gl_text"), "__gl_part": F.spark_partition_id()})
    return base.mapInArrow(C.streaming(run), schema)


def mark_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, hot_prefix: int = HOT_PREFIX) -> DataFrame:
    """`docs` with kept (string), n_words, n_removed (long) and removed (array<struct<start, end>>).

    A word is removed if a window of min_words words that covers it also starts in a document with a
    smaller id; removed has the maximal runs of such words as half-open word ranges, and kept the
    words left, joined by single spaces. Words are runs of bytes other than ASCII white space.

    Null and empty texts have no words and an empty kept. Rows without id are judged against all
    others, but aren't a reason to remove anything. Rows of the same id don't count against each
    other, so repeated rows are treated alike. Columns of these names are replaced, others kept; a
    long text is one row of its block. An empty table gives an empty one.
    """
    k = min_words
    added = ["kept", "n_words", "n_removed", "removed"]
    base = C.replace_columns(docs, added)
    text_name = next(c for c in base.columns if c.lower() == text_col.lower())
    base = base.select("*", F.col(f"`{id_col}`").cast("long").alias("__gl_id"), C.octets(text_col).alias("__gl_text"))
    size, bins = census(base)
    n_words = int(bins.sum())
    blocks = C.n_parts(size, BLOCK_BYTES)
    buckets = C.n_parts(n_words / 4, GROUP_ANCHORS)
    groups = C.n_parts(n_words / 8, GROUP_SUFFIXES)
    log_p = np.log((bins + 1) / (n_words + BINS))
    least = np.log(min(1.0, PREFIX_SUFFIXES / max(n_words, 1)))
    names = [f.name for f in base.schema.fields if not f.name.startswith("__gl_")]
    fields = {f.name: f for f in base.schema.fields}
    dealt = _deal(base, blocks, [c for c in names if c != text_name]).groupBy("__gl_block")

    def anchors(t: pa.Table) -> pa.Table:
        """The block's different anchors, whether several documents have one, and how many stretches."""
        b = Block(t, k)
        order = np.argsort(b.anchor, kind="stable")
        a, own = b.anchor[order], b.ids[b.doc[b.first[order]]]
        at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        several = np.maximum.reduceat(own, at) != np.minimum.reduceat(own, at) if len(at) else np.zeros(0, bool)
        n = np.minimum(np.diff(np.append(at, len(a))), 127)
        a = a[at]
        return _pack((C.mix(a) % np.uint64(buckets)).astype(np.int64), [a, (n * 2 + several).astype(np.uint8)], t.column("__gl_block")[0].as_py())

    def repeated(t: pa.Table) -> pa.Table:
        """To each block, those of its anchors that several documents have, and whether they are hot."""
        block, (a, flags) = _unpack(t, [np.uint64, np.uint8])
        order = np.argsort(a, kind="stable")
        a, block, flags = a[order], block[order], flags[order].astype(np.int64)
        at = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(a)))
        several = (n > 1) | (np.maximum.reduceat(flags & 1, at) > 0 if len(at) else False)
        hot = (np.add.reduceat(flags >> 1, at) > hot_prefix if len(at) else several).astype(np.uint8)
        hit = np.repeat(several, n)
        return _back(block[hit], [a[hit], np.repeat(hot, n)[hit]])

    def suffixes(t: pa.Table, back: pa.Table) -> pa.Table:
        """The block's suffixes that may share a deep node, equal ones as one."""
        if not t.num_rows or not back.num_rows:
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["bucket", "block", "blob"])
        b = Block(in_order(t), k)
        a, hot = _unpack(back, [np.uint64, np.uint8])[1]
        order = np.argsort(a, kind="stable")
        a, hot = a[order], hot[order]
        at = np.minimum(np.searchsorted(a, b.anchor), len(a) - 1)
        some = np.flatnonzero(a[at] == b.anchor)
        first, n, place, hot = b.first[some], b.n[some], b.place[some], hot[at[some]] > 0
        if hot.any():  # a hot anchor's windows go one by one
            each = n[hot]
            first, place, n, hot = (np.concatenate(x) for x in ((first[~hot], _ranges(first[hot], each)), (place[~hot], np.repeat(place[hot], each)), (n[~hot], np.ones(each.sum(), np.int64)), (hot[~hot], np.ones(each.sum(), bool))))
        d1, d2 = b.digests(first, n)
        own = b.ids[b.doc[first]]
        order = np.lexsort((d2, d1))
        d1, d2, own, first, n, place, hot = (x[order] for x in (d1, d2, own, first, n, place, hot))
        at = np.flatnonzero(np.append(True, (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1]))) if len(d1) else np.zeros(0, np.int64)
        low = np.minimum.reduceat(own, at) if len(at) else own
        several = np.maximum.reduceat(own, at) != low if len(at) else np.zeros(0, bool)
        first, n, place, hot = first[at], n[at], place[at], hot[at]
        group = np.where(hot, d1[at], prefix_groups(b.h, place, log_p, least, b.gram))
        shape = [first, place - first, n, several + 2 * hot.astype(np.int64), low]
        return pack_suffixes((group % np.uint64(groups)).astype(np.int64), b.h, shape, k, t.column("__gl_block")[0].as_py())

    def deep_nodes(t: pa.Table) -> pa.Table:
        """To each block, the windows of its suffixes that a smaller id has too, with the least id."""
        return _back(*repeats(*unpack_suffixes(t), k))

    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cover(t: pa.Table, back: pa.Table) -> pa.Table:
        m = t.num_rows
        texts, kept, runs = [], [], []
        words, removed = np.zeros(m, np.int64), np.zeros(m, np.int64)
        if m:
            t = in_order(t)
            b = Block(t, k)
            texts, words = b.texts, b.counts
            gone = np.zeros(len(b.h) + 1, np.int64)
            if back.num_rows and len(b.first):
                hits = [c.astype(np.int64) for c in _unpack(back, HITS)[1]]
                hot = hits[1] >= 128
                hits[1] &= 127
                for kind, first, n in ((~hot, b.first, b.n), (hot, b.windows, np.ones(len(b.windows), np.int64))):
                    place, each, at, long, low = (c[kind] for c in hits)
                    if not len(place):
                        continue
                    n1, n2 = b.digests(place, each)
                    order = np.argsort(n1, kind="stable")
                    n1, n2, at, long, low = n1[order], n2[order], at[order], long[order], low[order]
                    d1, d2 = b.digests(first, n)
                    lo = np.searchsorted(n1, d1)
                    count = np.searchsorted(n1, d1, side="right") - lo
                    some, x = np.repeat(np.arange(len(d1)), count), _ranges(lo, count)
                    fits = (n2[x] == d2[some]) & (low[x] < b.ids[b.doc[first[some]]])
                    some, x = some[fits], x[fits]
                    np.add.at(gone, first[some] + at[x], 1)
                    np.add.at(gone, first[some] + at[x] + long[x] - 1 + k, -1)
            gone = np.cumsum(gone[:-1]) > 0
            end = 0
            for text, n in zip(b.texts, b.counts.tolist(), strict=True):
                mask, own = gone[end : end + n], (text or b"").split()
                end += n
                runs.append([])
                if mask.any():
                    removed[len(kept)] = np.count_nonzero(mask)
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                    runs[-1] = [{"start": int(i), "end": int(j)} for i, j in edge.reshape(-1, 2)]
                    own = [own[i] for i in np.flatnonzero(~mask)]
                kept.append(b" ".join(own))
        plain = pa.array(texts, pa.binary())
        plain = plain if fields[text_name].dataType == T.BinaryType() else plain.view(pa.string())
        own = [plain if c == text_name else t.column(c) for c in names]
        return pa.table([*own, pa.array(kept, pa.binary()).view(pa.string()), pa.array(words), pa.array(removed), pa.array(runs, spans)], names=[*names, *added])

    span_type = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([
        *[fields[c] for c in names], T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("removed", span_type),
    ])
    again = dealt.applyInArrow(C.grouped(anchors), ROWS).groupBy("bucket").applyInArrow(C.grouped(repeated), ROWS)
    parts = dealt.cogroup(again.groupBy("block")).applyInArrow(C.cogrouped(suffixes), ROWS)
    nodes = parts.groupBy("bucket").applyInArrow(C.grouped(deep_nodes), ROWS)
    return dealt.cogroup(nodes.groupBy("block")).applyInArrow(C.cogrouped(cover), schema)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs`, columns unchanged, with repeats cut out of the texts; documents left empty go.

    Texts that lose nothing, null and empty ones included, stay as they are; a column n_chars is
    renewed where a text has changed.
    """
    out = mark_repeats(docs, id_col, text_col, min_words).where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    changed = F.col("n_removed") > 0
    cols = []
    for f in docs.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name == text_col:
            c = F.when(changed, F.col("kept")).otherwise(c)
        elif f.name == "n_chars":
            c = F.when(changed, F.length("kept")).otherwise(c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return out.select(*cols)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mark_repeats` of `documents`, with the digest of the words left."""
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = mark_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(C.octets("kept"), 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
low AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
gone AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(i, i + 13))))) AS g FROM win JOIN low USING (s) WHERE m < doc_id GROUP BY doc_id),
kept AS (SELECT w.doc_id, ws, coalesce(g, []) AS g FROM w LEFT JOIN gone USING (doc_id)),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
cut AS (SELECT doc_id, unnest(g) AS i FROM gone),
left_over AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM pos ANTI JOIN cut USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(g)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM kept LEFT JOIN left_over USING (doc_id)
"""
