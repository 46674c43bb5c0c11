"""Hard negatives for anchors, by branch and bound in ball trees; exact.

Rows are dealt to shards, and each task grows a ball tree over its shard: a node has a centre and a radius
around its rows. For an anchor q all inner products in a node lie between q.centre - |q| radius and
q.centre + |q| radius. A node is left out where the upper bound is strictly beneath what an anchor still needs
(its k-th score so far, or the lower end of its window) or the lower bound is over the window's upper end.

There are two searches over the same shards. The first finds an anchor's positives, its best rows of the
same label; the second, for each positive, the best rows of other labels with scores in a window relative
to the positive's.

Vectors are made integers first, so scores are exact, and ties can be decided.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatelight.llm import common as C

#: Bytes of a shard's vectors and of a block's anchors, in double precision.
SHARD_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20
#: Rows of a leaf; shards of the labels.
LEAF, LABELS = 64, 64
#: Scaled components up to this size keep inner products of 2**17 of them within a long.
LARGEST = 1 << 23
NONE = -np.iinfo(np.int64).max  # can be negated


class BallTree:
    """Nodes in arrays: rows[begin:end] of the reordered table, centre, radius, and the two children."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        self.order = np.lexsort((ids,))
        self.begin, self.end, self.left, self.right = [], [], [], []
        centres, radii, todo = [], [], [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            at = len(self.begin)
            if parent >= 0:
                (self.left, self.right)[side][parent] = at
            own = x[self.order[a:b]]
            centre = own.mean(axis=0)
            off = np.sqrt(np.square(own - centre).sum(axis=1))
            far = int(off.argmax())
            for field, value in ((self.begin, a), (self.end, b), (self.left, -1), (self.right, -1)):
                field.append(value)
            centres.append(centre)
            radii.append(off[far])
            if b - a > leaf:
                # halves along the line through two ends of the ball; equal rows are split anyhow, to bound a leaf
                other = own[int(np.square(own - own[far]).sum(axis=1).argmax())]
                half = np.argsort(own @ (other - own[far]), kind="stable")
                self.order[a:b] = self.order[a:b][half]
                mid = (a + b) // 2
                todo += [(mid, b, at, 1), (a, mid, at, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.ids, self.labels, self.x = ids[self.order], labels[self.order], x[self.order]
        self.visited = 0  # rows times anchors that were multiplied

    def search(self, q: np.ndarray, qids: np.ndarray, qlabels: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids), anchors x windows x k, of the best rows whose score lies in [low, high] (anchors x windows).

        `same` takes rows of the anchor's own label, other than those of its id; else rows of other labels
        count. Places without a row have the score NONE.
        """
        n, lanes = low.shape
        best, best_ids = np.full((n, lanes, k), NONE), np.zeros((n, lanes, k), np.int64)
        if not len(self.x) or not n:
            return best, best_ids
        exact = float(np.abs(self.x).max(initial=0)) * float(np.abs(q).max(initial=0)) * q.shape[1] < 2**52
        mid, reach = q @ self.centres.T, np.linalg.norm(q, axis=1)[:, None] * self.radii[None, :]
        slack = 1e-9 * (np.abs(mid) + reach) + 1e-6
        upper, lower = mid + reach + slack, mid - reach - slack
        todo = [(0, np.arange(n))]
        while todo:
            node, some = todo.pop()
            # windows that still need something as high as this node's best, and begin no later than its worst
            need = np.maximum(low[some], best[some, :, k - 1].astype(float))
            wanted = (upper[some, node, None] >= need) & (lower[some, node, None] <= high[some])
            some = some[wanted.any(axis=1)]
            if not len(some):
                continue
            left, right = self.left[node], self.right[node]
            if left >= 0:
                # the child that more anchors point at comes first, so that the k-th scores rise early
                first, second = (left, right) if np.median(mid[some, left] - mid[some, right]) >= 0 else (right, left)
                todo += [(second, some), (first, some)]
                continue
            rows = slice(self.begin[node], self.end[node])
            x, ids, labels = self.x[rows], self.ids[rows], self.labels[rows]
            self.visited += len(some) * len(ids)
            score = (q[some] @ x.T).astype(np.int64) if exact else q[some].astype(np.int64) @ x.astype(np.int64).T
            fits = labels[None, :] == qlabels[some, None]
            fits = fits & (ids[None, :] != qids[some, None]) if same else ~fits
            for lane in range(lanes):
                floor = np.maximum(low[some, lane], best[some, lane, k - 1])
                ok = fits & (score >= floor[:, None]) & (score <= high[some, lane, None])
                hit = np.flatnonzero(ok.any(axis=1))
                if not len(hit):
                    continue
                own = some[hit]
                s = np.concatenate((best[own, lane], np.where(ok[hit], score[hit], NONE)), axis=1)
                i = np.concatenate((best_ids[own, lane], np.broadcast_to(ids, (len(hit), len(ids)))), axis=1)
                top = np.lexsort((i, -s), axis=1)[:, :k]  # higher scores first, ties by smaller id
                best[own, lane], best_ids[own, lane] = np.take_along_axis(s, top, 1), np.take_along_axis(i, top, 1)
        return best, best_ids


def scaled(vec: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision."""
    return F.transform(vec.cast("array<double>"), lambda x: F.floor(F.lit(float(scale)) * x).cast("double"))


def usable(vec: Column, scale: int) -> Column:
    """Whether all components are finite numbers, and small enough for exact scores."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < float(LARGEST))) & (F.size(vec) < (1 << 17))


def _matrix(t: pa.Table) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks])
    return flat.reshape(t.num_rows, -1)


def _numpy(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _search(rows: DataFrame, anchors: DataFrame, shards: dict, blocks: int, k: int, same: bool) -> DataFrame:
    """(anchor_id, lane, id, score): of each shard the best k for each anchor and window.

    `anchors` has id, label, v and windows, an array of structs (low, high). A shard goes to each block of anchors
    and an anchor to each shard that may hold rows for it.
    """
    labels, subs = shards["labels"], shards["subs"]
    block = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)).cast("int")
    sub = F.pmod(F.xxhash64("id", F.lit(6)), F.lit(subs)).cast("int")
    left = rows.select("d", F.pmod("label", F.lit(labels)).alias("l"), sub.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), "id", "label", "v")
    own = F.pmod("label", F.lit(labels))
    # where a shard of labels holds but one, an anchor of that label finds no other there
    to = F.array(own) if same else F.sequence(F.lit(0).cast("long"), F.lit(labels - 1).cast("long"))
    if not same and shards["pure"]:
        to = F.filter(to, lambda x: x != own)
    right = anchors.select("d", F.explode(to).alias("l"), block.alias("b"), "id", "label", "v", "windows")
    right = right.select("d", "l", F.explode(F.sequence(F.lit(0), F.lit(subs - 1))).alias("s"), "b", "id", "label", "v", "windows")

    def run(t: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["anchor_id", "lane", "id", "score"]
        if not t.num_rows or not asks.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=names)
        tree = BallTree(_numpy(t, "id"), _numpy(t, "label"), _matrix(t))
        lows, highs, windows = [], [], asks.column("windows").combine_chunks()
        count = pa.compute.list_value_length(windows).to_numpy()
        flat = windows.flatten()
        at = np.repeat(np.arange(len(count)), count), np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        lows, highs = np.full((len(count), count.max(initial=1)), np.inf), np.full((len(count), count.max(initial=1)), -np.inf)
        lows[at], highs[at] = flat.field("low").to_numpy(), flat.field("high").to_numpy()
        best, ids = tree.search(_matrix(asks), _numpy(asks, "id"), _numpy(asks, "label"), lows, highs, k, same)
        a, lane, place = np.nonzero(best != NONE)
        return pa.table([pa.array(_numpy(asks, "id")[a]), pa.array(lane, pa.int32()), pa.array(ids[a, lane, place]), pa.array(best[a, lane, place])], names=names)

    keys = ["d", "l", "s", "b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(C.cogrouped(run), "anchor_id long, lane int, id long, score long")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (50, 95, 100), scale: int = 256,
                   id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of floor(scale * component). An anchor's positives are its best other rows
    of the same label; for each of them the best rows of other labels are returned whose score s has
    window[0] * p <= window[2] * s <= window[1] * p, p being the positive's score. Ties go to smaller ids.

    Both tables have id_col, vec_col and label_col; other columns aren't read. Rows with a null id, label or
    vector, with null or non-finite components, or with scaled components of 2**23 and more, take no part. Of
    rows with one id the least by label and vector counts, among anchors too, which needn't be among the
    rows. Vectors of different lengths never meet. Empty tables give no rows, as do anchors without
    positives and positives without rows in their window.
    """

    def taken(df: DataFrame) -> DataFrame:
        v = F.col(vec_col)
        fine = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.when(usable(v, scale), scaled(v, scale)).alias("v")).dropna()
        one = fine.groupBy("id").agg(F.min(F.struct("label", "v")).alias("x"))
        return one.select("id", "x.*", F.size("x.v").alias("d"))

    base, ask = taken(rows), taken(anchors)
    bytes_of = F.sum(F.col("d").cast("long") * 8 + 64)
    sizes = base.groupBy("d", F.pmod("label", F.lit(LABELS)).alias("l")).agg(bytes_of.alias("b"), F.min("label").alias("least"), F.max("label").alias("most"))
    largest, pure = sizes.agg(F.max("b"), F.every(F.col("least") == F.col("most"))).first()
    least, most = base.agg(F.min("label"), F.max("label")).first()
    # few small labels are shards of their own; others share LABELS of them
    labels = int(most) + 1 if least is not None and least >= 0 and most < LABELS else LABELS
    shards = {"labels": labels, "subs": C.n_parts(largest or 0, shard_bytes), "pure": bool(pure)}
    blocks = C.n_parts(ask.agg(bytes_of).first()[0] or 0, block_bytes)
    any_score = F.array(F.struct(F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high")))
    first = _search(base, ask.withColumn("windows", any_score), shards, blocks, positives, True)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id"))
    found = first.withColumn("lane", rank - 1).where(F.col("lane") < positives)
    found = C.materialize(found.select("anchor_id", "lane", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    # the least and the largest integer scores of a window
    p = F.col("positive_score")
    low, high = F.ceil(p * window[0] / window[2]), F.floor(p * window[1] / window[2])
    least_, most_ = F.when(low * window[2] < p * window[0], low + 1).otherwise(low), F.when(high * window[2] > p * window[1], high - 1).otherwise(high)
    windows = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("lane", least_.cast("double").alias("low"), most_.cast("double").alias("high")))).alias("w"))
    windows = windows.select(F.col("anchor_id").alias("w_id"), F.transform("w", lambda x: F.struct(x["low"].alias("low"), x["high"].alias("high"))).alias("windows"))
    second = _search(base, ask.join(windows, F.col("id") == F.col("w_id")).drop("w_id"), shards, blocks, negatives, False)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "lane").orderBy(F.desc("score"), "id"))
    best = second.withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = best.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(found, ["anchor_id", "lane"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`hard_negatives` over `embeddings`: anchors are the rows whose vec_id is divisible by 50; where it is divisible by 7
    the label is the next one of ten."""
    rows = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, rows.where(F.col("vec_id") % 50 == 0))


OP13_SQL = """
WITH fine AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x) OR abs(256 * CAST(x AS DOUBLE)) >= 8388608]) = 0),
flat AS (SELECT id, x.label AS label, x.v AS v FROM (SELECT id, min(struct_pack(label := label, v := v)) AS x FROM fine GROUP BY id)),
scores AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s
  FROM flat a JOIN flat b ON a.id % 50 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id AS positive_id, s AS p FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5),
pairs AS (
  SELECT q.anchor_id, q.positive_id, n.id AS negative_id, q.p AS positive_score, n.s AS negative_score,
    row_number() OVER (PARTITION BY q.anchor_id, q.positive_id ORDER BY n.s DESC, n.id) AS rank
  FROM positives q JOIN scores n ON n.anchor_id = q.anchor_id AND NOT n.same AND 50 * q.p <= 100 * n.s AND 100 * n.s <= 95 * q.p)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM pairs WHERE rank <= 3
"""
