"""Keyed state, ledgers and line numbers: restarts, failures and repeated batches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from gatelight import commands
from gatelight.config import RunConfig
from gatelight.operators import relational
from gatelight.sources import ledger, records
from gatelight.streaming import state

DECISION = "uid string, decision string, wav string, at long"


def put(spark, folder, rows, schema=DECISION):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(query):
    q = query.start()
    q.awaitTermination()
    return q


# ---- appending ----
def test_new_keys_are_appended_once_and_the_target_is_not_read(spark, tmp_path):
    src, target, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k long, v string"
    known = spark.createDataFrame([(100, "old")], schema)
    append = lambda: run(state.append_new(spark.readStream.schema(schema).parquet(src), target, cp, ["k"], lambda df: df.withColumn("n", F.length("v")), known))
    put(spark, src, [(1, "a"), (1, "b"), (2, "cc"), (100, "x")], schema)
    append()
    put(spark, src, [(2, "zz"), (3, "ddd"), (100, "y")], schema)
    append()
    rows = state.batches(spark, target, "k long, v string, n int").collect()
    assert sorted(r.k for r in rows) == [1, 2, 3]
    # the target is only written: without it the next batch goes on
    moved = tmp_path / "moved"
    (tmp_path / "out").rename(moved)
    put(spark, src, [(3, "again"), (4, "e")], schema)
    append()
    assert [r.k for r in state.batches(spark, target, "k long, v string, n int").collect()] == [4]


def test_a_batch_that_fails_before_its_commit_is_not_doubled(spark, tmp_path):
    """Written, but cut off before the stream noted it: the batch runs again and leaves its rows as they are."""
    src, target, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = "k long, v string"
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    put(spark, src, [(1, "a"), (2, "b")], schema)
    calls = []

    def fails(df):
        calls.append(1)
        if len(calls) == 1:  # cut off while the rows are written
            df.write.mode("overwrite").parquet(f"{target}/batch=0/partial")
            raise ValueError("lost")
        return df

    with pytest.raises(Exception, match="lost"):
        run(state.append_new(stream(), target, cp, ["k"], fails))
    assert state.batches(spark, target, schema).count() == 0
    run(state.append_new(stream(), target, cp, ["k"], fails))
    assert sorted(r.k for r in state.batches(spark, target, schema).collect()) == [1, 2] and len(calls) == 2
    # the stream forgets that it has committed batch 0
    for p in (tmp_path / "cp" / "commits").glob("*0*"):
        p.unlink()
    run(state.append_new(stream(), target, cp, ["k"], fails))
    assert sorted(r.k for r in state.batches(spark, target, schema).collect()) == [1, 2] and len(calls) == 2


# ---- withdrawing ----
def test_changed_decisions_withdraw_their_results(spark, tmp_path):
    """Two changes and a restart: what the stream withdraws is what the batch form finds stale."""
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    rng, at, done, want, got = random.Random(3), 0, {}, [], []
    for step in range(3):
        rows = []
        for uid in rng.sample("abcdefghij", 7):
            at += 1
            decision = rng.choice(["accept", "reject"])
            rows.append((uid, decision, rng.choice(["x.wav", "y.wav", None]) if decision == "accept" else None, at))
        put(spark, src, rows)
        current = spark.createDataFrame(rows, DECISION)
        if done:
            before = spark.createDataFrame([(u, *d) for u, d in done.items()], "uid string, decision string, wav string")
            want += sorted((r.uid, r.decision, r.wav or "") for r in relational.stale(before, current, "uid", ["decision", "wav"]).collect())
        done |= {u: (d, w) for u, d, w, _ in rows}
        stream = state.withdrawals(spark.readStream.schema(DECISION).parquet(src), ["uid"], ["decision", "wav"], "at")
        run(state.append_batches(stream, out, cp, lambda df: df))
        rows = state.batches(spark, out, "uid string, action string, decision string, wav string").collect()
        now = sorted((r.uid, r.decision, r.wav or "") for r in rows if r.action == "withdraw")
        for x in got:
            now.remove(x)
        got += now
    assert want and got == want
    tasks = {}
    for r in rows:
        key = (r.uid, r.decision, r.wav)
        tasks[key] = tasks.get(key, 0) + (1 if r.action == "task" else -1)
    assert {k for k, n in tasks.items() if n} == {(u, *d) for u, d in done.items()}  # what stands is the last decision


def test_changes_within_one_batch_count_in_their_order(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    put(spark, src, [("a", "reject", None, 3), ("a", "accept", "x", 1), ("a", "accept", "x", 2), ("b", None, None, 1), ("b", None, None, 2)])
    run(state.append_batches(state.withdrawals(spark.readStream.schema(DECISION).parquet(src), ["uid"], ["decision", "wav"], "at"), out, cp, lambda df: df))
    rows = state.batches(spark, out, "uid string, action string, decision string, wav string").collect()
    assert [(r.action, r.decision, r.wav) for r in rows if r.uid == "a"] == [("task", "accept", "x"), ("withdraw", "accept", "x"), ("task", "reject", None)]
    assert [(r.action, r.decision) for r in rows if r.uid == "b"] == [("task", None)]


def test_idle_keys_are_forgotten(spark, tmp_path):
    """One batch a start: with timers in processing time a stream doesn't come to an end by itself."""
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for at in (1, 2, 3):
        put(spark, src, [("a", "accept", None, at)] if at != 2 else [("b", "accept", None, at)])
        stream = state.withdrawals(spark.readStream.schema(DECISION).parquet(src), ["uid"], ["decision"], "at", idle_ms=1)
        run(state.append_batches(stream, out, cp, lambda df: df).trigger(once=True))
    rows = state.batches(spark, out, "uid string, action string, decision string").where("uid = 'a'").collect()
    assert [r.action for r in rows] == ["task", "task"]  # the second is a first one again


# ---- chunks ----
def test_work_goes_on_after_two_chunks(spark, tmp_path):
    tasks = spark.range(100).select(F.col("id").alias("uid"), (F.col("id") * 2).alias("x"))
    out, ran = str(tmp_path / "out"), []

    def work(df):
        ran.append(df.count())
        return df.withColumn("y", F.col("x") + 1)

    assert ledger.in_chunks(tasks, ["uid"], 5, out, work, "v1", most=2) is None
    assert len(ran) == 2 and len(ledger.ledger(spark, out, 5)) == 2
    got = ledger.in_chunks(tasks, ["uid"], 5, out, work, "v1")
    assert len(ran) == 5 and sum(ran) == 100  # the open chunks only
    assert sorted((r.uid, r.y) for r in got.select("uid", "y").collect()) == [(i, 2 * i + 1) for i in range(100)]
    assert ledger.in_chunks(tasks, ["uid"], 5, out, work, "v1").count() == 100 and len(ran) == 5
    changed = tasks.withColumn("x", F.when(F.col("uid") == 7, -1).otherwise(F.col("x")))
    got = ledger.in_chunks(changed, ["uid"], 5, out, work, "v1")
    assert len(ran) == 6 and got.where("uid = 7").first().y == 0 and got.count() == 100  # one chunk has other tasks
    assert ledger.in_chunks(changed, ["uid"], 5, out, work, "v2").count() == 100 and len(ran) == 11


def test_a_chunk_that_fails_stays_open(spark, tmp_path):
    tasks, out = spark.range(40).select(F.col("id").alias("uid")), str(tmp_path / "out")

    def fails(df):
        return df.withColumn("y", F.when(F.col("uid") == 11, F.raise_error(F.lit("lost"))).otherwise(F.lit("done")))

    with pytest.raises(Exception, match="lost"):
        ledger.in_chunks(tasks, ["uid"], 4, out, fails)
    done = len(ledger.ledger(spark, out, 4))
    assert done < 4
    assert ledger.in_chunks(tasks, ["uid"], 4, out, lambda df: df.withColumn("y", F.lit("done"))).count() == 40


def test_no_tasks(spark, tmp_path):
    none = spark.range(0).select(F.col("id").alias("uid"))
    assert ledger.in_chunks(none, ["uid"], 3, str(tmp_path / "out"), lambda df: df).count() == 0


def test_recognize_in_chunks(spark, tmp_path):
    texts = spark.createDataFrame([(f"u{i}", "zh", "打开空调", "打开空调" if i % 2 else "关空调") for i in range(30)], "uid string, lang string, ref string, asr_text string")
    plain = commands.COMMANDS["recognize"](RunConfig(), {"texts": texts})
    chunked = commands.COMMANDS["recognize"](RunConfig(chunks=4, out_dir=str(tmp_path)), {"texts": texts})
    assert sorted(map(tuple, plain["rows"].collect())) == sorted(map(tuple, chunked["rows"].select(plain["rows"].columns).collect()))
    assert [tuple(r) for r in plain["summary"].collect()] == [tuple(r) for r in chunked["summary"].collect()]


# ---- line numbers ----
def test_lines_are_numbered_over_files_and_splits(spark, tmp_path):
    """Files cut into many splits: numbers follow file names and places, whatever the cuts."""
    rng, want = random.Random(5), []
    for name in ("b.jsonl", "a.jsonl", "c.jsonl", "empty.jsonl"):
        lines = []
        for _ in range(0 if name == "empty.jsonl" else rng.randint(300, 900)):
            lines.append(json.dumps({"uid": f"u{rng.randrange(50)}", "ok": rng.choice([True, False, None]), "x": "y" * rng.randrange(200)}))
            if rng.random() < 0.1:
                lines.append(rng.choice(["", "  "]))
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if name != "c.jsonl" else ""))
        want.append((name, [json.loads(x) for x in lines if x.strip()]))
    flat = [r for _, rows in sorted(want) for r in rows]
    schema = "uid string, ok boolean, x string"
    for size in ("4k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            rows = records.read_jsonl(spark, str(tmp_path), schema, ordinal="n")
            got = {r.n: (r.uid, r.ok, r.x) for r in rows.collect()}
            last = {r.uid: r.n for r in records.enrolment_index(rows, "n").collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == {i: (r["uid"], r["ok"], r["x"]) for i, r in enumerate(flat)}
        assert last == {r["uid"]: i for i, r in enumerate(flat) if r["ok"] is not False}


def test_numbered_lines_of_nothing(spark, tmp_path):
    got = records.read_jsonl(spark, str(tmp_path / "none"), "uid string", missing_ok=True, ordinal="n")
    assert got.columns == ["uid", "n"] and got.count() == 0
    (tmp_path / "bad.jsonl").write_text('{"uid": "a"}\n{broken\n')
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "uid string", ordinal="n").collect()
