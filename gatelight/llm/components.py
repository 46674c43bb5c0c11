"""Distributed connected components over an edge table; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelight.llm import common as C


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge: root is the least node reachable from it.

    `edges` has a and b of one type; nulls and loops are dropped, repeated edges count once. Large-star
    and small-star steps in turn keep the number of edges from growing, and take a number of rounds that
    grows with the logarithm of the longest path. Each round is written to the shared folder, and the
    one before deleted. Nothing but two counts goes to the driver.

    A hub's minimum is pre-aggregated. In the joins its edges stand behind an exchange of their own, as
    do the minima, so that the adaptive planner can split a hub among tasks.
    """
    now = edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    now = C.materialize(now)
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        # large star: u's larger neighbours go to the least of u and its neighbours
        least = _apart(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("lo"), F.least("u", "v").alias("m")), "lo")
        large = now.join(least, "lo").select("hi", F.col("m").alias("lo")).distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(_apart(low, "hi"), "hi").select(F.col("lo").alias("x"), "m").where("x <> m").select(F.col("x").alias("hi"), F.col("m").alias("lo"))
        new = C.materialize(small.union(low.select("hi", F.col("m").alias("lo"))).distinct())
        if _same(now, new):
            C.discard(new)
            break
        C.discard(now)
        now = new
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select("lo", F.col("lo").alias("root")).distinct())


def _apart(df: DataFrame, key: str) -> DataFrame:
    """`df` behind an exchange that doesn't serve a join on `key`, which thus gets its own."""
    return df.repartition(F.xxhash64(key))


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether both hold as many edges with the same hash sums."""
    sums = [F.count("*"), *(F.sum(F.pmod(F.xxhash64("hi", "lo", F.lit(k)), F.lit(1 << 40))) for k in (1, 2))]
    return tuple(a.agg(*sums).first()) == tuple(b.agg(*sums).first())
