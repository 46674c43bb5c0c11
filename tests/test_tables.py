"""Table functions against the expressions and window passes they stand beside."""

import random

from pyspark.sql import functions as F

from gatelight.functions import tables
from gatelight.operators import windows as W


def test_windows_like_the_expression(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 0, -3, 1, 799, 800, 801, rng.randint(1, 6000)])) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, n int")
    for win, hop, least in ((800, 400, 350), (10, 3, 1), (100, 100, 100), (50, 70, 20)):
        want = df.select("k", F.explode(W.sliding(F.col("n"), win, hop, least)).alias("w")).select("k", "w.start", "w.end")
        assert sorted(map(tuple, tables.windows_of(df, F.col("n"), ["k"], win, hop, least).collect())) == sorted(map(tuple, want.collect()))


def test_islands_like_the_window_passes(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", "c"]), rng.randint(0, 400), True) for _ in range(150)] + [(None, 5, True), (None, 6, True), ("d", 9, True), ("d", None, True)]
    df = spark.createDataFrame(rows, "k string, at long, on boolean")
    got = sorted(map(str, tables.islands_of(df, "k", "at", 4).collect()))
    want = W.islands(df.where("at IS NOT NULL"), "k", "at", "on", 4)
    assert got == sorted(map(str, want.select("k", "first", "last", "frames").collect()))


def test_table_functions_in_sql(spark):
    tables.register(spark, "string")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 9), ("b", 4)], "k string, at long")
    got = spark.sql("SELECT * FROM gl_islands(gap => 3, row => TABLE(SELECT k, at FROM {df}) PARTITION BY k ORDER BY at)", df=df).collect()
    assert sorted(map(tuple, got)) == [("a", 1, 2, 2), ("a", 9, 9, 1), ("b", 4, 4, 1)]
    assert [tuple(r) for r in spark.sql("SELECT w.* FROM VALUES (10), (0) t(n), LATERAL gl_windows(t.n, 4, 4, 2) w ORDER BY 1").collect()] == [(0, 4), (4, 8), (8, 10)]
    assert tables.islands_of(df.limit(0), "k", "at", 3).collect() == []
