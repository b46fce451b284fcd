"""Ordered replay of a command log: one state per database, as a stream or as a batch.

`Keyspace` applies commands in order in plain Python; it holds what one group of keys holds. Logs
whose commands touch single keys are grouped by key, which scales with the number of keys; logs
with commands on several keys (RPOPLPUSH, RENAME, MSET, EXEC) are grouped by database.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Commands that touch no key but their first.
SINGLE = ("set", "setnx", "getset", "append", "incrby", "decrby", "incr", "decr", "del", "lpush", "rpush", "lpop", "rpop", "sadd", "srem", "hset", "hdel", "hincrby", "zadd", "zincrby", "zrem", "expire", "pexpireat", "persist")
#: Commands that write nothing.
READS = ("get", "exists", "pttl", "llen")
OUT = "group string, seq bigint, reply string"


class Keyspace:
    """Keys of all types. The clock is the command's own time; an expired key is absent."""

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.data: dict[str, list] = state.get("data", {})  # key: [kind, value, expire_at_ms]
        self.version: dict[str, int] = state.get("version", {})  # writes so far, of watched keys only
        self.clients: dict[str, dict] = state.get("clients", {})  # open transactions and watches

    def state(self) -> dict:
        return {"data": self.data, "version": self.version, "clients": self.clients}

    def command(self, client: str, argv: list[str], now: int):
        """The reply to a command of a client, transactions included.

        MULTI queues what follows; EXEC runs it at once, without another client's commands between,
        and replies with the list of replies, or null if a watched key was written since (by
        anyone). An error in a queue doesn't undo the rest.
        """
        name = argv[0].lower()
        mine = self.clients.setdefault(client, {"queue": None, "watch": {}})
        try:
            if name == "multi":
                if mine["queue"] is not None:
                    return "ERR MULTI calls can not be nested"
                mine["queue"] = []
                return "OK"
            if name in ("exec", "discard"):
                if mine["queue"] is None:
                    return f"ERR {name.upper()} without MULTI"
                queue, watch = mine["queue"], mine["watch"]
                mine["queue"], mine["watch"] = None, {}
                if name == "discard":
                    return "OK"
                if any(self.version.get(k, 0) != v for k, v in watch.items()):
                    return None
                return json.dumps([self.apply(a, now) for a in queue])
            if name == "watch" and mine["queue"] is None:
                for k in argv[1:]:
                    mine["watch"][k] = self.version.setdefault(k, 0)
                return "OK"
            if name == "unwatch":
                mine["watch"] = {}
                return "OK"
            if mine["queue"] is not None:
                mine["queue"].append(argv)
                return "QUEUED"
            return self.apply(argv, now)
        finally:
            if mine["queue"] is None and not mine["watch"]:
                self.clients.pop(client, None)
                self.version = {k: v for k, v in self.version.items() if any(k in c["watch"] for c in self.clients.values())}

    def _get(self, key: str, kind: str, now: int, make=None):
        slot = self.data.get(key)
        if slot and slot[2] is not None and slot[2] <= now:
            del self.data[key]
            slot = None
        if slot is None:
            if make is None:
                return None
            slot = self.data[key] = [kind, make(), None]
        if slot[0] != kind:
            raise TypeError("WRONGTYPE")
        return slot

    def _tidy(self, key: str) -> None:
        if key in self.data and self.data[key][0] != "string" and not self.data[key][1]:
            del self.data[key]

    def apply(self, argv: list[str], now: int):
        """The command's reply; errors are texts that start with ERR or WRONGTYPE."""
        name, args = argv[0].lower(), list(argv[1:])
        if self.version and name not in READS:
            for k in args:
                if k in self.version:
                    self.version[k] += 1
        try:
            return getattr(self, f"c_{name}")(now, *args)
        except TypeError as e:
            return str(e) if "WRONGTYPE" in str(e) else f"ERR arguments of {name}"
        except AttributeError:
            return f"ERR unknown command {name}"
        except ValueError:
            return "ERR value is not a number or out of range"

    def c_set(self, now, key, value, *flags):
        flags, ttl, only = [f.lower() for f in flags], None, None
        while flags:
            f = flags.pop(0)
            if f in ("ex", "px"):
                ttl = int(flags.pop(0)) * (1000 if f == "ex" else 1)
            elif f in ("nx", "xx"):
                only = f
        there = key in self.data and not (self.data[key][2] is not None and self.data[key][2] <= now)
        if (only == "nx" and there) or (only == "xx" and not there):
            return None
        self.data[key] = ["string", value, None if ttl is None else now + ttl]
        return "OK"

    def c_setnx(self, now, key, value):
        return 1 if self.c_set(now, key, value, "nx") else 0

    def c_get(self, now, key):
        slot = self._get(key, "string", now)
        return slot[1] if slot else None

    def c_getset(self, now, key, value):
        old = self.c_get(now, key)
        self.data[key] = ["string", value, None]
        return old

    def c_append(self, now, key, value):
        slot = self._get(key, "string", now, str)
        slot[1] += value
        return len(slot[1].encode())

    def c_incrby(self, now, key, by):
        slot = self._get(key, "string", now, lambda: "0")
        n = int(slot[1]) + int(by)
        if not -(2**63) <= n < 2**63:
            raise ValueError
        slot[1] = str(n)
        return n

    def c_decrby(self, now, key, by):
        return self.c_incrby(now, key, -int(by))

    def c_incr(self, now, key):
        return self.c_incrby(now, key, 1)

    def c_decr(self, now, key):
        return self.c_incrby(now, key, -1)

    def c_mset(self, now, *pairs):
        for k, v in zip(pairs[::2], pairs[1::2], strict=True):
            self.c_set(now, k, v)
        return "OK"

    def c_del(self, now, *keys):
        return sum(self.c_exists(now, k) and self.data.pop(k) is not None for k in keys)

    def c_exists(self, now, key):
        slot = self.data.get(key)
        return int(bool(slot) and (slot[2] is None or slot[2] > now))

    def c_rename(self, now, old, new):
        if not self.c_exists(now, old):
            return "ERR no such key"
        self.data[new] = self.data.pop(old)
        return "OK"

    def c_expire(self, now, key, seconds):
        return self.c_pexpireat(now, key, now + int(seconds) * 1000)

    def c_pexpireat(self, now, key, at):
        if not self.c_exists(now, key):
            return 0
        self.data[key][2] = int(at)
        return 1

    def c_persist(self, now, key):
        if not self.c_exists(now, key) or self.data[key][2] is None:
            return 0
        self.data[key][2] = None
        return 1

    def c_pttl(self, now, key):
        if not self.c_exists(now, key):
            return -2
        return -1 if self.data[key][2] is None else self.data[key][2] - now

    def _push(self, now, key, values, left):
        slot = self._get(key, "list", now, list)
        for v in values:
            slot[1].insert(0, v) if left else slot[1].append(v)
        return len(slot[1])

    def c_lpush(self, now, key, *values):
        return self._push(now, key, values, True)

    def c_rpush(self, now, key, *values):
        return self._push(now, key, values, False)

    def _pop(self, now, key, at):
        slot = self._get(key, "list", now)
        value = slot[1].pop(at) if slot else None
        self._tidy(key)
        return value

    def c_lpop(self, now, key):
        return self._pop(now, key, 0)

    def c_rpop(self, now, key):
        return self._pop(now, key, -1)

    def c_rpoplpush(self, now, source, target):
        value = self._pop(now, source, -1)
        if value is not None:
            self._push(now, target, [value], True)
        return value

    def c_llen(self, now, key):
        slot = self._get(key, "list", now)
        return len(slot[1]) if slot else 0

    def c_sadd(self, now, key, *members):
        slot = self._get(key, "set", now, dict)
        n = len(slot[1])
        slot[1].update(dict.fromkeys(members, 1))
        return len(slot[1]) - n

    def c_srem(self, now, key, *members):
        slot = self._get(key, "set", now)
        n = sum(slot[1].pop(m, None) is not None for m in members) if slot else 0
        self._tidy(key)
        return n

    def c_smove(self, now, source, target, member):
        if not self.c_srem(now, source, member):
            return 0
        self.c_sadd(now, target, member)
        return 1

    def c_hset(self, now, key, field, value):
        slot = self._get(key, "hash", now, dict)
        new = field not in slot[1]
        slot[1][field] = value
        return int(new)

    def c_hdel(self, now, key, *fields):
        slot = self._get(key, "hash", now)
        n = sum(slot[1].pop(f, None) is not None for f in fields) if slot else 0
        self._tidy(key)
        return n

    def c_hincrby(self, now, key, field, by):
        slot = self._get(key, "hash", now, dict)
        slot[1][field] = str(int(slot[1].get(field, 0)) + int(by))
        return int(slot[1][field])

    def c_zadd(self, now, key, *pairs):
        slot = self._get(key, "zset", now, dict)
        n = len(slot[1])
        slot[1].update({m: float(s) for s, m in zip(pairs[::2], pairs[1::2], strict=True)})
        return len(slot[1]) - n

    def c_zincrby(self, now, key, by, member):
        slot = self._get(key, "zset", now, dict)
        slot[1][member] = slot[1].get(member, 0.0) + float(by)
        return slot[1][member]

    def c_zrem(self, now, key, *members):
        slot = self._get(key, "zset", now)
        n = sum(slot[1].pop(m, None) is not None for m in members) if slot else 0
        self._tidy(key)
        return n


def run(commands: list[tuple[int, int, str, list[str]]], keyspace: Keyspace) -> list[tuple[int, str | None]]:
    """Replies to (seq, ts_ms, client, argv), in the order of seq. An empty command is an error."""
    out = []
    for seq, now, client, argv in sorted(commands, key=lambda c: c[0]):
        reply = keyspace.command(client, argv, now) if argv else "ERR empty command"
        out.append((seq, None if reply is None else str(reply)))
    return out


def grouped(oplog: DataFrame) -> DataFrame:
    """Adds `group`: the database, and the key too where only single-key commands occur in it is up
    to the caller, who may pass a log that already has the column."""
    out = oplog if "group" in oplog.columns else oplog.withColumn("group", F.col("db").cast("string"))
    client = F.col("client").cast("string") if "client" in oplog.columns else F.lit("")
    return out.select("group", "seq", "ts_ms", F.coalesce(client, F.lit("")).alias("client"), "argv")


def replay(oplog: DataFrame) -> DataFrame:
    """(group, seq, reply) of a log (group or db, seq, ts_ms, argv, and client if there are several),
    each group in order (batch)."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = run([(int(r.seq), int(r.ts_ms), r.client, list(r.argv)) for r in rows.itertuples()], Keyspace())
        return pd.DataFrame({"group": key[0], "seq": [s for s, _ in got], "reply": [r for _, r in got]})

    return grouped(oplog).groupBy("group").applyInPandas(one, OUT)


def replay_stream(oplog: DataFrame) -> DataFrame:
    """The same for a stream: the state of a group is kept between micro-batches."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys = Keyspace(json.loads(state.get[0]) if state.exists else {})
        rows = [(int(r.seq), int(r.ts_ms), r.client, list(r.argv)) for b in batches for r in b.itertuples()]
        got = run(rows, keys)
        state.update((json.dumps(keys.state()),))
        yield pd.DataFrame({"group": key[0], "seq": [s for s, _ in got], "reply": [r for _, r in got]})

    return grouped(oplog).groupBy("group").applyInPandasWithState(one, OUT, "keys string", "append", GroupStateTimeout.NoTimeout)
