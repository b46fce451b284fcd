"""Channels and subscriptions, blocking reads, watches and sessions, as queries over logs.

All of them work on static and streaming inputs unless said otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryset.functions.text import glob_to_regex
from quarryset.operators.ordering import accumulated


def deliveries(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Messages (channel, ...) for each subscriber of (pattern, subscriber), once per pattern.

    Patterns without wildcards are joined by equality; only real patterns are matched one by one.
    Subscriptions are the static side.
    """

    @F.pandas_udf("string")
    def to_regex(patterns: pd.Series) -> pd.Series:
        return patterns.map(lambda p: None if p is None else glob_to_regex(p))

    wild = F.col("pattern").rlike(r"[*?\[\\]")
    exact = messages.join(subscriptions.filter(~wild).distinct(), F.col("channel") == F.col("pattern"))
    by_pattern = subscriptions.filter(wild).distinct().withColumn("_r", to_regex("pattern"))
    matched = messages.join(by_pattern, F.expr("channel rlike _r")).drop("_r")
    return exact.unionByName(matched)


def receivers(messages: DataFrame, subscriptions: DataFrame, message_id: str) -> DataFrame:
    """(message id, receivers): how many deliveries each message had, 0 included (static input)."""
    n = deliveries(messages, subscriptions).groupBy(message_id).agg(F.count(F.lit(1)).alias("_n"))
    return messages.select(message_id).join(n, message_id, "left").select(message_id, F.coalesce("_n", F.lit(0)).alias("receivers"))


def numsub(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.groupBy(F.col("pattern").alias("channel")).agg(F.count_distinct("subscriber").alias("n"))


def channels(subscriptions: DataFrame, pattern: str | None = None) -> DataFrame:
    """Channels with subscribers; subscriptions that are patterns aren't channels."""
    out = subscriptions.filter(~F.col("pattern").rlike(r"[*?\[\\]")).select(F.col("pattern").alias("channel")).distinct()
    return out if pattern is None else out.filter(F.col("channel").rlike(glob_to_regex(pattern)))


def numpat(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.filter(F.col("pattern").rlike(r"[*?\[\\]")).agg(F.count_distinct("pattern", "subscriber").alias("n"))


def notifications(oplog: DataFrame, now_db: str = "db") -> DataFrame:
    """(channel, message) of keyspace and keyevent notifications for commands that write."""
    cmd = F.lower(F.get("argv", F.lit(0)))
    events = F.create_map(*[F.lit(x) for pair in (("set", "set"), ("del", "del"), ("expire", "expire"), ("rename", "rename_from"), ("lpush", "lpush"), ("rpush", "rpush"), ("sadd", "sadd"), ("zadd", "zadd"), ("hset", "hset")) for x in pair])
    rows = oplog.withColumn("_e", F.try_element_at(events, cmd)).filter("_e is not null and size(argv) > 1")
    return rows.select(F.explode(F.array(F.struct(F.concat(F.lit("__keyspace@"), now_db, F.lit("__:"), F.get("argv", F.lit(1))).alias("channel"), F.col("_e").alias("message")), F.struct(F.concat(F.lit("__keyevent@"), now_db, F.lit("__:"), F.col("_e")).alias("channel"), F.get("argv", F.lit(1)).alias("message")))).alias("n")).select("n.channel", "n.message")


def blocking_pops(pushes: DataFrame, pops: DataFrame) -> DataFrame:
    """The n-th pop of a key gets its n-th push (key, seq, value), as long as it waits (static).

    Columns: key, seq of the pop, value. Without a push the value is null.
    """
    a = accumulated(pushes.select("key", "seq", "value"), "key", ["seq"], None, "_n").drop("seq")
    b = accumulated(pops.select("key", "seq"), "key", ["seq"], None, "_n")
    return b.join(a, ["key", "_n"], "left").select("key", "seq", "value")


def watch_conflicts(watches: DataFrame, writes: DataFrame) -> DataFrame:
    """Watches (client, key, seq, exec_seq) with `aborted`: whether any client wrote the key in
    between (static)."""
    w = writes.select("key", F.col("seq").alias("_at"), F.lit(0).alias("_o"), F.col("seq").alias("_w"), *[F.lit(None).cast(f.dataType).alias(f"_{f.name}") for f in watches.schema.fields])
    a = watches.select("key", F.col("exec_seq").alias("_at"), F.lit(-1).alias("_o"), F.lit(None).cast("bigint").alias("_w"), *[F.col(f).alias(f"_{f}") for f in watches.columns])
    # the latest write before EXEC tells whether any lies in between, without pairs of watches and writes
    order = ["_at", "_o", "_w", "_client", "_seq"]
    last = accumulated(w.unionByName(a), "key", order, "_w", "_last", op="max").filter("_o = -1")
    return last.select(*[F.col(f"_{f}").alias(f) for f in watches.columns], F.coalesce(F.col("_last") > F.col("_seq"), F.lit(False)).alias("aborted"))


def sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """(key, start, stop, n): bursts of events with no more than a gap between them."""
    s = events.groupBy(key, F.session_window(ts, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("stop"))
    return s.select(key, F.col("_w.start").alias("start"), "stop", "n")


def tumbling(events: DataFrame, ts: str, width: str, *by: str, late: str | None = None) -> DataFrame:
    """Counts by window; with `late` a watermark drops what comes later than that (streams)."""
    rows = events.withWatermark(ts, late) if late else events
    return rows.groupBy(F.window(ts, width).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), *by, "n")


def latencies(log: DataFrame, *by: str) -> DataFrame:
    """Median, 95th and 99th percentile of the durations there are (a value that occurs)."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by duration)")
    return log.filter("duration is not null").groupBy(*by).agg(p(0.5).cast("bigint").alias("p50"), p(0.95).cast("bigint").alias("p95"), p(0.99).cast("bigint").alias("p99"))


def slowlog_len(log: DataFrame, at_least_us: int = 0) -> DataFrame:
    return log.filter(F.col("duration") >= at_least_us).agg(F.count(F.lit(1)).alias("n"))


def slowlog_reset(log: DataFrame, node: str | None = None) -> DataFrame:
    """An empty log, or the log without the entries of one node."""
    return log.limit(0) if node is None else log.filter(~F.col("node").eqNullSafe(F.lit(node)))


def monitor(oplog: DataFrame) -> DataFrame:
    """(ts_ms, line): each command as a monitor shows it, its texts quoted (also on a stream)."""
    quoted = F.transform("argv", lambda a: F.concat(F.lit('"'), F.regexp_replace(a, r'(["\\])', r"\\$1"), F.lit('"')))
    stamp = F.concat(F.floor(F.col("ts_ms") / 1000).cast("string"), F.lit("."), F.lpad((F.col("ts_ms") % 1000 * 1000).cast("string"), 6, "0"))
    return oplog.filter("size(argv) > 0").select("ts_ms", F.concat(stamp, F.lit(" ["), F.col("db").cast("string"), F.lit("] "), F.array_join(quoted, " ")).alias("line"))


def expirations(keys: DataFrame, since_ms: int, now_ms: int) -> DataFrame:
    """(channel, message) of keys whose time ran out in (since, now]."""
    gone = keys.filter((F.col("expire_at_ms") > since_ms) & (F.col("expire_at_ms") <= now_ms))
    return _both(gone, F.col("db").cast("string"), F.col("key"), F.lit("expired"))


def evictions(keys: DataFrame, dropped: DataFrame) -> DataFrame:
    """(channel, message) of keys dropped for space; `dropped` is what `keyspace.evict` returns."""
    gone = keys.join(dropped.select("key"), "key", "left_semi")
    return _both(gone, F.col("db").cast("string"), F.col("key"), F.lit("evicted"))


def _both(rows: DataFrame, db, key, event) -> DataFrame:
    pair = F.array(F.struct(F.concat(F.lit("__keyspace@"), db, F.lit("__:"), key).alias("channel"), event.alias("message")), F.struct(F.concat(F.lit("__keyevent@"), db, F.lit("__:"), event).alias("channel"), key.alias("message")))
    return rows.select(F.explode(pair).alias("n")).select("n.channel", "n.message")


def slowest(log: DataFrame, k: int, at_least_us: int = 0) -> DataFrame:
    return log.filter(F.col("duration") >= at_least_us).orderBy(F.desc("duration"), "node", "id").limit(k)
