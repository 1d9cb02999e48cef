"""Work queue (replay, stream, restart), upload ledger and log rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from roadsift.operators import ledger, logs
from roadsift.streaming import work_queue
from roadsift.streaming.work_queue import Queue

HOUR = 3_600_000_000


def test_queue_by_hand():
    q = Queue(lease=10, most_attempts=2)
    assert q.apply("submit", 1, 0, 11, None) == 11 and q.apply("submit", 2, 0, 12, None) == 12
    assert q.apply("claim", 3, 1, None, 7) == 11 and q.apply("claim", 4, 2, None, 8) == 12 and q.apply("claim", 5, 2, None, 9) is None
    assert q.apply("beat", 6, 10, None, 7) == 11 and q.apply("beat", 7, 10, None, 5) is None and q.apply("done", 8, 11, None, 5) is None  # only the holder counts
    assert q.apply("claim", 9, 15, None, 9) == 12  # 8's lease ended at 12, and 12 is the oldest waiting
    assert q.apply("fail", 10, 16, None, 9) == 12 and q.counts() == (0, 1, 0, 1)  # two attempts: it has failed
    assert q.apply("claim", 11, 40, None, 9) == 11  # 7's lease ended at 20
    assert q.apply("done", 12, 41, None, 9) == 11 and q.counts() == (0, 0, 1, 1) and not q.held and not q.waiting
    assert q.apply("submit", 13, 50, 13, None) == 13 and q.apply("submit", 14, 50, 14, None) == 14
    q.apply("claim", 15, 51, None, 1)
    q.apply("fail", 16, 52, None, 1)
    assert q.apply("claim", 17, 53, None, 2) == 13  # an item comes back to its old place


def operations(seed=0, n=300):
    rng = random.Random(seed)
    rows, at = [], 0
    for k in range(n):
        at += rng.randrange(HOUR)
        rows.append((k % 3, k, at, rng.choice(["submit", "submit", "claim", "claim", "beat", "done", "fail"]), k, rng.randrange(3)))
    return rows


SCHEMA = "queue long, number long, at long, op string, item long, worker long"


def plain(rows, lease):
    queues, out = {}, {}
    for queue, number, at, op, item, worker in sorted(rows, key=lambda r: (r[2], r[1])):
        q = queues.setdefault(queue, Queue(lease))
        out[number] = (q.apply(op, number, at, item, worker), *q.counts())
    return out


def test_replay_in_order_whatever_the_partitions(spark):
    rows = operations()
    df = spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(1)).repartition(7)
    got = {r["number"]: (r["item"], r["waiting"], r["leased"], r["done"], r["failed"]) for r in work_queue.replay(df, 4 * HOUR).collect()}
    assert got == plain(rows, 4 * HOUR)
    assert work_queue.replay(df.limit(0)).count() == 0


def test_stream_goes_on_after_a_restart_and_reaps_by_timer(spark, tmp_path):
    """Three files as batches, a stop after the second: the states are those of the replay, and the state of finished items is gone."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = operations(1, 237)
    rows += [(k % 3, k, rows[-1][2] + 1, "claim", k, 1) for k in range(237, 240)]  # held when the operations end
    (tmp_path / "in").mkdir()

    late = [(9, 1000 + k, 400 * HOUR + k, "submit", k, 0) for k in range(2)]  # time goes on in another queue

    def put(k):
        part = spark.createDataFrame([r for r in rows if r[1] // 80 == k] + late[k - 3 : k - 2] * (k > 2), SCHEMA).withColumn("time", F.timestamp_micros("at"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run(_):
        kind = spark.read.parquet(str(tmp_path / "in")).schema
        source = spark.readStream.schema(kind).parquet(str(tmp_path / "in")).withWatermark("time", "1 second")
        found = []
        query = work_queue.stream(source, 4 * HOUR).writeStream.foreachBatch(lambda df, _: found.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        return found

    try:
        put(0)
        put(1)
        first = run("a")
        put(2)
        second = run("b")  # another query object on the same checkpoint
        put(3)
        third = run("c")
        put(4)
        third += run("d")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = plain(rows, 4 * HOUR)
    got = {r["number"]: (r["item"], r["waiting"], r["leased"], r["done"], r["failed"]) for r in first + second if r["op"] != "reap"}
    assert set(got) == set(want)
    assert {n: g[3:] for n, g in got.items()} == {n: w[3:] for n, w in want.items()} and got == want
    reaped = {r["queue"]: r for r in third if r["op"] == "reap"}
    assert reaped and all(r["leased"] == 0 and r["queue"] < 3 for r in reaped.values())


def test_ledger_by_hand(spark):
    rows = [("a", 1, 0, 5), ("a", 2, 0, 5), ("a", 3, 5, 4), ("a", 4, 8, 3), ("a", 5, 20, 1), ("a", 6, 9, 100), ("a", 7, 9, 0), ("a", 8, None, 3), ("b", 1, 3, 2), ("b", 2, 0, 3), (None, 1, 0, 2)]
    df = spark.createDataFrame(rows, "k string, n int, o long, l long").repartition(3)
    got = {(r["k"], r["n"]): (r["status"], r["size_after"]) for r in ledger.accepted(df, "k", ["n"], "o", "l", most=50).collect()}
    assert [got["a", n] for n in range(1, 9)] == [("accepted", 5), ("duplicate", 5), ("accepted", 9), ("conflict", 9), ("conflict", 9), ("too_large", 9), ("invalid", 9), ("invalid", 9)]
    assert got["b", 1] == ("conflict", 0) and got["b", 2] == ("accepted", 3) and got[None, 1] == ("accepted", 2)
    totals = spark.createDataFrame([("a", 30), ("b", 5), ("c", 4), ("d", 0)], "k string, t long")
    cover = {r["k"]: tuple(r)[1:] for r in ledger.coverage(df.filter("l < 50 or l is null"), totals, "k", "o", "l", "t").collect()}
    assert cover == {"a": (12, 2, 2, 11, False), "b": (5, 1, 0, 5, True), "c": (0, 0, 1, 0, False), "d": (0, 0, 0, 0, True)}


@pytest.mark.parametrize("seed", [0, 1])
def test_ranges_equal_sets_of_bytes(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(4), rng.randrange(60), rng.randrange(-1, 7)) for _ in range(80)]
    merged = ledger.ranges(spark.createDataFrame(rows, "k int, o long, l long"), "k", "o", "l")
    totals = spark.createDataFrame([(k, 50) for k in range(4)], "k int, t long")
    holes = ledger.missing(merged, totals, "k", "t").collect()
    for k in range(4):
        there = {p for q, o, n in rows if q == k for p in range(o, o + n)}
        own = sorted((r["start"], r["stop"]) for r in merged.collect() if r["k"] == k)
        assert {p for a, b in own for p in range(a, b)} == there and all(b < c for (_, b), (c, _) in zip(own, own[1:], strict=False))
        assert {p for r in holes if r["k"] == k for p in range(r["start"], r["stop"])} == set(range(50)) - there


def test_log_rules_by_hand(spark):
    rules = [(r"out of memory", "memory"), (r"no GPU", "gpu"), (r"missing \w+", "missing file")]
    text = {
        "newest": "no GPU found\nmissing weights\nmore\n\n",
        "first_rule": "no GPU: out of memory",
        "tail": "start\n  skip: MODEL_X1 at /opt/a/b.bin or C:\\x\\y failed  \n \n",
        "old": "no GPU\n" + "\n".join(f"line {k}" for k in range(40)),
        "edge": "no GPU\n" + "\n".join(f"line {k}" for k in range(39)),
        "long": "x" * 400,
    }
    df = spark.createDataFrame([(k, t, 3 if k == "long" else 0) for k, t in text.items()] + [("empty", "", 1), ("null", None, 1)], "k string, t string, c int")
    lines = logs.lines_of(df, "k", "t").join(df.select("k", "c"), "k")
    got = {r["k"]: (r["reason"], r["by_rule"]) for r in logs.reasons(lines, "k", rules, "c", [(r"MODEL_[A-Z0-9_]+", "the model")]).collect()}
    assert got == {
        "newest": ("missing file", True), "first_rule": ("memory", True), "tail": ("the model at … or … failed", False), "old": ("line 39", False), "edge": ("gpu", True), "long": ("failed (code 3): " + "x" * 160, False),
    }
    assert {r["reason"] for r in logs.reasons(lines.drop("c"), "k", []).filter("k = 'newest'").collect()} == {"more"}
