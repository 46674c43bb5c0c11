"""Byte-level BPE by corpus-level merge replay.

A block of documents is the corpus: its distinct words (matches of the split pattern) stand in one
flat chain of symbols, an inverted index leads from the token a pair would make to the positions of
that pair, and the merges are replayed in rank order over all words at once; a merge touches its
two neighbours only. Words are independent, so blocks need no exchange, memory is bounded by a
block, and a lost executor costs its blocks alone.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelight.llm import common as C

#: Rank files are shipped to the workers whole; larger ones are refused.
MAX_RANKS_BYTES = 64 << 20


#: Units whose ids a worker remembers before it starts anew with the next batch.
CACHE_UNITS = 300_000

#: Bytes of distinct words that one replay takes, and pairs looked up at once.
REPLAY_BYTES, LOOKUP = 1 << 20, 1 << 18

# Fixed value: the split pattern of the GPT-2 family. Before a single space between other characters a match of
# it always ends, as only an optional leading space of a match can take it up.
FAMILY = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNIT = re.compile(r"(?<=\S)(?= \S)")
_TWO = re.compile(r"\s\s")
_ONE = np.ones(1, bool)


def units(text: str) -> list[str]:
    """Pieces of a text, mostly words, that the split pattern can take one by one.

    All but the first lack the single space before them.
    """
    if text[0] != " " and text[-1] != " " and not _TWO.search(text):
        return text.split(" ")
    first, *rest = _UNIT.split(text)
    return [first, *(x[1:] for x in rest)]


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class MergeReplay:
    """Encodes sets of distinct words under `ranks`, which must hold every single byte."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.n_ranks = max(ranks.values()) + 1
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, made = [], []
        for token, r in ranks.items():  # all pairs of tokens that make a token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.made = np.array([*keys, 0], np.int64)[[*order, -1]], np.array([*made, -1], np.int32)[[*order, -1]]
        self.keys[-1] = np.iinfo(np.int64).max

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that a and b make, or -1."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        made = self.made[at]
        made[self.keys[at] != key] = -1  # keys with an end mark are negative and never found
        return made

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit integers."""
        out: list = [None] * len(words)
        which = []
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is None:
                which.append(i)
            else:
                out[i] = whole.to_bytes(4, "little")
        at, room = 0, REPLAY_BYTES
        for i, word in enumerate(which):
            room -= len(words[word])
            if room <= 0 or i == len(which) - 1:
                self._replay(words, which[at : i + 1], out)
                at, room = i + 1, REPLAY_BYTES
        return out

    def _replay(self, words: list[bytes], which: list[int], out: list) -> None:
        """Put the ids of those words into out."""
        raw = [words[i] for i in which]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
        stops = np.cumsum(sizes) - 1  # a -1 ends each word
        buf = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8)
        n = len(buf)
        tok = np.full(n + 1, -1, np.int32)
        tok[:n] = self.byte[buf]
        tok[stops] = -1
        starts = np.concatenate(([0], stops[:-1] + 1))
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        prv[starts] = nxt[n] = prv[n] = n  # tok[n] is -1 as well
        now = np.full(n + 1, -1, np.int32)  # rank of the pair that begins here
        for at in range(0, n, LOOKUP):
            to = min(n, at + LOOKUP)
            now[at:to] = self.pair(tok[at:to], tok[at + 1 : to + 1])
        first = np.flatnonzero(now >= 0)
        first = first[np.argsort(now[first], kind="stable")]
        cuts = np.searchsorted(now[first], np.arange(self.n_ranks + 1)).tolist()
        later: dict[int, list[int]] = {}

        def merge(p: np.ndarray, r) -> tuple[np.ndarray, np.ndarray]:
            """Join each p (ascending) and its right neighbour; ranks and positions of the new pairs."""
            q = nxt[p]
            tok[p], tok[q], now[q] = r, -2, -1
            z = nxt[q]
            nxt[p], prv[z] = z, p
            left = prv[p]
            if len(p) > 1:
                left = left[np.concatenate((_ONE, left[1:] != p[:-1]))]  # else p has the same pair
            at = np.concatenate((p, left))
            now[at] = made = self.pair(tok[at], tok[nxt[at]])
            new = made >= 0
            return made[new], at[new]

        def finish(word: int) -> None:
            """A pair of lower rank has come up: this word's next merges go before the others'."""
            while True:
                chain = [int(starts[word])]
                while tok[nxt[chain[-1]]] >= 0:
                    chain.append(int(nxt[chain[-1]]))
                ready = [(int(now[x]), x) for x in chain if now[x] >= 0]
                if not ready:
                    return
                r, x = min(ready)
                merge(np.array([x]), r)

        for r in range(self.n_ranks):
            lo, hi = cuts[r], cuts[r + 1]
            if r in later:
                p = np.array(later.pop(r))
                if lo < hi:
                    p = np.concatenate((first[lo:hi], p))
                p.sort()
            elif lo < hi:
                p = first[lo:hi]
            else:
                continue
            p = p[now[p] == r]
            if not len(p):
                continue
            if len(p) > 1 and (nxt[p[:-1]] == p[1:]).any():
                keep, last = [], -1  # runs of one pair over itself: every second one, from the left
                for x in p.tolist():
                    if x != last:
                        keep.append(x)
                        last = int(nxt[x])
                p = np.array(keep)
            ranks, at = merge(p, r)
            if len(ranks) and ranks.min() < r:
                for word in np.unique(np.searchsorted(stops, at[ranks < r])).tolist():
                    finish(word)
                ranks, at = ranks[ranks > r], at[ranks > r]
            for x, y in zip(ranks.tolist(), at.tolist(), strict=True):
                if x in later:
                    later[x].append(y)
                else:
                    later[x] = [y]
        kept = np.flatnonzero(tok[:n] >= 0)
        ids = tok[kept].astype("<u4").tobytes()
        to = (np.searchsorted(kept, stops) * 4).tolist()
        at = 0
        for i, end in zip(which, to, strict=True):
            out[i] = ids[at:end]
            at = end


_IDS = [T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())]
_BYTES = T.StructField("decoded", T.BinaryType())


def _ranks_of(spark: SparkSession, ranks_path: str):
    with open(ranks_path, "rb") as f:
        data = f.read(MAX_RANKS_BYTES + 1)
    if len(data) > MAX_RANKS_BYTES:
        raise ValueError(f"{ranks_path} is over {MAX_RANKS_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`docs` with n_tokens (long) and token_ids (binary: little-endian unsigned 32-bit ids).

    Each match of `pattern` is encoded by itself and without special tokens; text that no match holds is
    left out. Texts are taken word by word where `pattern` is FAMILY, and whole otherwise. A null or empty text
    has no tokens. Columns of these names in `docs` are replaced; rows, repeated ones too, stay one
    to one and other columns are passed through. An empty table gives an empty result.
    """
    base = C.replace_columns(docs, ["n_tokens", "token_ids"])
    return base.mapInArrow(_encoding(_ranks_of(docs.sparkSession, ranks_path), pattern, text_col), T.StructType([*base.schema.fields, *_IDS]))


def _encoding(held, pattern: str, text_col: str):
    """The function that appends n_tokens and token_ids to batches."""

    def run(batches):
        replay, split = MergeReplay(read_ranks(held.value)), regex.compile(pattern)
        cut = units if pattern == FAMILY else lambda text: [text]  # of other patterns nothing is known
        known: dict[str, bytes] = {}
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            heads: set[str] = set()
            fresh: set[str] = set()
            if len(known) > CACHE_UNITS:
                known.clear()
            for part in C.text_slices(batch, text_col):
                for text in part.column(at).to_pylist():
                    if text:
                        first, *rest = cut(text)
                        heads.add(first)
                        fresh.update(rest)
            new = [u for u in fresh if u not in known]
            pieces = [split.findall(" " + u) for u in new] + [split.findall(u) for u in heads]
            distinct = list({w for ws in pieces for w in ws})
            code = dict(zip(distinct, replay.encode([w.encode() for w in distinct]), strict=True))
            ids = [b"".join(map(code.__getitem__, ws)) for ws in pieces]
            known.update(zip(new, ids))
            starts = dict(zip(heads, ids[len(new) :], strict=True))
            del fresh, new, pieces, distinct, code, ids, heads
            for part in C.text_slices(batch, text_col):
                blobs = []
                for text in part.column(at).to_pylist():
                    if text:
                        first, *rest = cut(text)
                        blobs.append(starts[first] + b"".join(map(known.__getitem__, rest)))
                    else:
                        blobs.append(b"")
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([len(b) // 4 for b in blobs], pa.int64()), pa.array(blobs, pa.binary())],
                    names=[*part.schema.names, "n_tokens", "token_ids"],
                )

    return run


def bpe_decode(encoded: DataFrame, ranks_path: str, ids_col: str = "token_ids") -> DataFrame:
    """`encoded` with decoded (binary): the bytes of the tokens in a row; null ids give no bytes.

    Ids outside the ranks raise. A column named decoded is replaced; other columns are kept.
    """
    base = C.replace_columns(encoded, ["decoded"])
    return base.mapInArrow(_decoding(_ranks_of(encoded.sparkSession, ranks_path), ids_col), T.StructType([*base.schema.fields, _BYTES]))


def _decoding(held, ids_col: str):
    """The function that appends decoded to batches."""

    def run(batches):
        tokens = {i: t for t, i in read_ranks(held.value).items()}
        for batch in batches:
            for part in C.text_slices(batch, ids_col):
                blobs = part.column(part.schema.get_field_index(ids_col)).to_pylist()
                out = [b"".join(map(tokens.__getitem__, np.frombuffer(b, "<u4").tolist())) if b else b"" for b in blobs]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, "decoded"])

    return run


def bpe_round_trip(docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """`docs` with n_tokens, token_ids and decoded: bpe_decode(bpe_encode()) in one worker a task.

    Cases as for those two.
    """
    held = _ranks_of(docs.sparkSession, ranks_path)
    base = C.replace_columns(docs, ["n_tokens", "token_ids", "decoded"])
    encode, decode = _encoding(held, pattern, text_col), _decoding(held, "token_ids")
    return base.mapInArrow(C.streaming(lambda batches: decode(encode(batches))), T.StructType([*base.schema.fields, *_IDS, _BYTES]))


def tokenizer() -> tuple[str, str]:
    """The rank file and split pattern of the registered query."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`bpe_round_trip` of `documents`, with digests of the ids and of the bytes they decode to."""
    path, pattern = tokenizer()
    docs = C.table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_round_trip(docs, path, pattern).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
