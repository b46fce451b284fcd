"""Command logs, replay, channels and ranges."""

import random

import pytest
from pyspark.sql import functions as F

from quarryset.sources import oplog, ranges
from quarryset.sources.tables import live, manifest, save_sorted
from quarryset.streaming import pubsub, replay


def test_log_round_trip(spark, tmp_path):
    ops = [(1, 0, ["SET", "k", "välue"]), (2, 0, ["LPUSH", "l", ""]), (3, 2, ["DEL", "k", "l"])]
    df = spark.createDataFrame(ops, "seq int, db int, argv array<string>")
    lines = oplog.lines(df).orderBy("seq").collect()
    (tmp_path / "a.log").write_bytes(b"".join(bytes(r.line) for r in lines) + b"*2\r\n$3\r\nGET\r\n$5\r\ncut")
    got = oplog.read(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.db, r.argv) for r in got] == [(db, argv) for _, db, argv in ops]
    oplog.write(df, str(tmp_path / "log"))
    assert sorted((r.db, r.argv) for r in oplog.read(spark, str(tmp_path / "log" / "part-*")).collect()) == sorted((db, argv) for _, db, argv in ops)


def test_broken_log():
    with pytest.raises(ValueError):
        list(oplog.parse(b"hello\r\n"))
    assert list(oplog.parse(b"")) == []


LOG = [["SET", "n", "1"], ["INCR", "n"], ["INCRBY", "n", "x"], ["LPUSH", "n", "a"], ["RPUSH", "l", "a", "b", "c"], ["RPOPLPUSH", "l", "m"], ["LPOP", "m"], ["SADD", "s", "x", "x"], ["SMOVE", "s", "t", "x"], ["ZADD", "z", "1", "a", "2", "b"], ["ZINCRBY", "z", "3", "a"], ["HSET", "h", "f", "1"], ["HINCRBY", "h", "f", "2"], ["SET", "e", "v", "PX", "5"], ["GET", "e"], ["GET", "e"], ["EXPIRE", "n", "1"], ["PTTL", "n"], ["DEL", "n", "l", "nope"], ["WHAT"]]
REPLIES = ["OK", "2", "ERR value is not a number or out of range", "WRONGTYPE", "3", "c", "c", "1", "1", "2", "4.0", "1", "3", "OK", "v", None, "1", "1000", "2", "ERR unknown command what"]
TIMES = [100 + i for i in range(14)] + [115, 120, 121, 121, 122, 123]


def commands(spark):
    return spark.createDataFrame([(i, 0, t, argv) for i, (t, argv) in enumerate(zip(TIMES, LOG, strict=True))], "seq long, db int, ts_ms long, argv array<string>")


def test_replay(spark):
    assert [r.reply for r in replay.replay(commands(spark)).orderBy("seq").collect()] == REPLIES


def test_stream_replays_as_batch(spark, tmp_path):
    rng = random.Random(3)
    log = []
    for i in range(120):
        k = f"k{rng.randrange(4)}"
        log.append((i, rng.randrange(2), 1000 + i, rng.choice([["INCR", "n" + k], ["RPUSH", k, str(i)], ["LPOP", k], ["RPOPLPUSH", k, "k0"], ["SET", "s" + k, str(i)], ["GET", "s" + k]])))
    df = spark.createDataFrame(log, "seq long, db int, ts_ms long, argv array<string>")
    want = sorted(map(tuple, replay.replay(df).collect()))
    for part in range(3):
        df.filter((F.col("seq") >= part * 40) & (F.col("seq") < part * 40 + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = replay.replay_stream(stream).writeStream.format("memory").queryName("replayed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("replayed").collect())) == want


def test_deliveries(spark):
    msgs = spark.createDataFrame([(1, "news.a"), (2, "other")], "id int, channel string")
    subs = spark.createDataFrame([("news.*", 1), ("news.a", 2), ("*", 3), ("news.a", 2)], "pattern string, subscriber long")
    assert sorted((r.id, r.receivers) for r in pubsub.receivers(msgs, subs, "id").collect()) == [(1, 3), (2, 1)]
    assert {r.channel: r.n for r in pubsub.numsub(subs).collect()}["news.a"] == 1


def test_windows_on_a_stream(spark, tmp_path):
    ev = spark.createDataFrame([(1, "2024-01-01 00:10:00"), (2, "2024-01-01 00:50:00"), (3, "2024-01-01 03:00:00")], "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    ev.coalesce(1).write.parquet(str(tmp_path / "e"))
    s = pubsub.tumbling(spark.readStream.schema(ev.schema).parquet(str(tmp_path / "e")), "ts", "1 hour", late="10 minutes")
    q = s.writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("hours").collect()) == [1, 2]


def test_ranges(spark):
    r = spark.createDataFrame([("a", 0, 10), ("a", 12, 5), ("a", 100, 5), ("a", 3, 2), ("b", 12, 1), ("b", 50, 0)], "segment string, start long, length long")
    assert sorted(map(tuple, ranges.coalesce(r, 4).select("segment", "start", "stop", "n").collect())) == [("a", 0, 17, 3), ("a", 100, 105, 1), ("b", 12, 13, 1)]


def test_sorted_storage(spark, tmp_path):
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    save_sorted(docs, str(tmp_path / "d"))
    seg = manifest(spark.read.parquet(str(tmp_path / "d"))).orderBy("least").collect()
    assert sum(s.rows for s in seg) == 100
    assert all(a.greatest < b.least for a, b in zip(seg, seg[1:], strict=False))
    assert live(docs, spark.range(10).withColumnRenamed("id", "doc_id")).count() == 90


def test_transactions_and_watches(spark):
    log = [("a", ["WATCH", "k"]), ("b", ["SET", "k", "1"]), ("a", ["MULTI"]), ("a", ["INCR", "k"]), ("a", ["EXEC"]), ("a", ["MULTI"]), ("b", ["SET", "k", "5"]), ("a", ["INCR", "k"]), ("a", ["LPUSH", "k", "x"]), ("a", ["GET", "k"]), ("a", ["EXEC"]), ("a", ["EXEC"]), ("a", ["MULTI"]), ("a", ["SET", "k", "9"]), ("a", ["DISCARD"]), ("b", ["GET", "k"]), ("a", ["WATCH", "k"]), ("b", ["GET", "k"]), ("a", ["MULTI"]), ("a", ["EXEC"])]
    df = spark.createDataFrame([(i, 0, 100, c, argv) for i, (c, argv) in enumerate(log)], "seq long, db int, ts_ms long, client string, argv array<string>")
    got = [r.reply for r in replay.replay(df).orderBy("seq").collect()]
    assert got == ["OK", "OK", "OK", "QUEUED", None, "OK", "OK", "QUEUED", "QUEUED", "QUEUED", '[6, "WRONGTYPE", "6"]', "ERR EXEC without MULTI", "OK", "QUEUED", "OK", "6", "OK", "6", "OK", "[]"]


def test_running_totals(spark):
    from quarryset.operators.ordering import running_total

    df = spark.createDataFrame([(i * 7 % 101, i % 5) for i in range(101)], "k int, v int").repartition(6)
    got = {r.k: r.t for r in running_total(df, ["k"], "v", "t").collect()}
    rows, total = sorted((r.k, r.v) for r in df.collect()), 0
    for k, v in rows:
        assert got[k] == total
        total += v


def test_a_hot_key_spreads_over_partitions(spark):
    from quarryset.operators.ordering import accumulated

    df = spark.createDataFrame([("hot", i, i % 3) for i in range(400)] + [(f"k{i}", 0, 1) for i in range(9)] + [(None, 1, 2), (None, 2, None)], "key string, o int, v int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.key, r.o): (r.t, r.n) for r in accumulated(df, "key", ["o"], "v", "t", "n").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 411 and got[None, 2] == (2, 2) and got["k3", 0] == (1, 1)
    total = 0
    for i in range(400):
        total += i % 3
        assert got["hot", i] == (total, 399)
