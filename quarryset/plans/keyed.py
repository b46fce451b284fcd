"""Queries on keyed structures: strings, lists, sets, sorted sets, hashes, keys, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarryset.functions import bits, text
from quarryset.functions.distance import haversine
from quarryset.operators import hashes, keyspace, lists, sets, sketches, sorting, strings, zsets
from quarryset.plans.register import registry
from quarryset.sources import ranges
from quarryset.sources.tables import load, live
from quarryset.streaming import pubsub

QUERIES, SQL, query = registry()

# ---- sorted sets: prices of parts by brand; best values of users by event type


def _prices(s, d):
    return load(s, d, "part").select(F.col("p_brand").alias("key"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("member"), F.col("p_retailprice").alias("score"))


_PRICES = "p as (select p_brand as key, lpad(cast(p_partkey as varchar), 9, '0') as member, p_retailprice as score from part)"
_RANKED = "r as (select *, row_number() over (partition by key order by score, member) - 1 as rank, row_number() over (partition by key order by score desc, member desc) - 1 as back, count(*) over (partition by key) as card from p)"


def _z(s, d, kind):
    e = load(s, d, "events").filter(F.col("event_type") == kind)
    return e.groupBy(F.col("user_id").alias("member")).agg(F.max("value").alias("score"))


def _zsql(kind, table):
    return f"{table} as (select user_id as member, max(value) as score from events where event_type = '{kind}' group by user_id)"


@query("select event_type as key, user_id as member, arg_max(value, event_id) as score from events group by 1, 2")
def zadd_last(s, d):
    return zsets.zadd(load(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq")))


def _ops(s, d):
    return load(s, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), F.col("value").alias("score"), F.col("event_id").alias("seq"))


@query("""with e as (select event_type as key, user_id as member, arg_min(value, event_id) as score from events where event_id < 3000 group by 1, 2),
n as (select event_type as key, user_id as member, arg_min(value, event_id) as score from events where event_id >= 3000 group by 1, 2)
select * from e union all select * from n where not exists (select 1 from e where e.key = n.key and e.member = n.member)""")
def zadd_nx(s, d):
    e = zsets.zadd(_ops(s, d).filter("seq < 3000"), only="nx")
    return zsets.zadd(_ops(s, d).filter("seq >= 3000"), e, only="nx")


@query("""with e as (select event_type as key, user_id as member, arg_max(value, event_id) as score from events where event_id < 300 group by 1, 2),
n as (select event_type as key, user_id as member, arg_max(value, event_id) as score from events where event_id >= 300 group by 1, 2)
select e.key, e.member, coalesce(n.score, e.score) as score from e left join n on e.key = n.key and e.member = n.member""")
def zadd_xx(s, d):
    return zsets.zadd(_ops(s, d).filter("seq >= 300"), zsets.zadd(_ops(s, d).filter("seq < 300")), only="xx")


@query("select l_suppkey as key, l_partkey as member, sum(l_quantity) as score from lineitem group by 1, 2")
def zincrby(s, d):
    return zsets.zincrby(load(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member"), F.col("l_quantity").alias("score")))


@query(f"with {_PRICES}, {_RANKED} select key, member, score, rank from r where rank between 2 and 9")
def zrange(s, d):
    return zsets.zrange(_prices(s, d), 2, 9)


@query(f"with {_PRICES}, {_RANKED} select key, member, score, rank from r where rank >= card - 5 and rank <= card - 2")
def zrange_negative(s, d):
    return zsets.zrange(_prices(s, d), -5, -2)


@query(f"with {_PRICES}, {_RANKED} select key, member, score, back as rank from r where back <= 4")
def zrevrange(s, d):
    return zsets.zrange(_prices(s, d), 0, 4, reverse=True)


@query(f"with {_PRICES}, {_RANKED} select key, member, score, rank from r")
def zrank(s, d):
    return zsets.zrank(_prices(s, d))


@query(f"with {_PRICES}, {_RANKED} select key, member, score, back as rank from r")
def zrevrank(s, d):
    return zsets.zrank(_prices(s, d), reverse=True)


@query(f"with {_PRICES} select key, member, score from p where member = '000000042'")
def zscore(s, d):
    return _prices(s, d).filter("member = '000000042'")


@query(f"with {_PRICES} select key, count(*) as n from p group by key")
def zcard(s, d):
    return zsets.zcard(_prices(s, d))


@query(f"with {_PRICES} select key, count(*) filter (where score > 950 and score <= 1000) as n from p group by key")
def zcount(s, d):
    return zsets.zcount(_prices(s, d), "(950", 1000)


@query(f"with {_PRICES}, h as (select *, row_number() over (partition by key order by score, member) as i from p where score >= 920) select key, member, score from h where i between 3 and 7")
def zrangebyscore(s, d):
    return zsets.zrangebyscore(_prices(s, d), 920, "+inf", 2, 5)


@query(f"with {_PRICES}, h as (select *, row_number() over (partition by key order by score desc, member desc) as i from p where score < 1000) select key, member, score from h where i <= 5")
def zrevrangebyscore(s, d):
    return zsets.zrangebyscore(_prices(s, d), "-inf", "(1000", 0, 5, reverse=True)


@query(f"with {_PRICES} select key, member, score from p where member >= '000000010' and member < '000000900'")
def zrangebylex(s, d):
    return zsets.zrangebylex(_prices(s, d), "[000000010", "(000000900")


@query(f"with {_PRICES}, h as (select *, row_number() over (partition by key order by score desc, member desc) as i from p where member > '000000010') select key, member, score from h where i <= 3")
def zrevrangebylex(s, d):
    return zsets.zrangebylex(_prices(s, d), "(000000010", "+", 0, 3, reverse=True)


@query(f"with {_PRICES} select key, count(*) filter (where member >= '000000100') as n from p group by key")
def zlexcount(s, d):
    return zsets.zlexcount(_prices(s, d), "[000000100", "+")


@query(f"with {_PRICES} select key, member, score from p where member not in (select lpad(cast(l_partkey as varchar), 9, '0') from lineitem where l_quantity = 1)")
def zrem(s, d):
    gone = load(s, d, "lineitem").filter("l_quantity = 1").select(F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("member"))
    p = _prices(s, d)
    return zsets.zrem(p, p.join(gone.distinct(), "member", "left_semi"))


@query(f"with {_PRICES} select key, member, score from p where not (score >= 900 and score < 1000)")
def zremrangebyscore(s, d):
    return zsets.zremrangebyscore(_prices(s, d), 900, "(1000")


@query(f"with {_PRICES} select key, member, score from p where not (member > '000000500')")
def zremrangebylex(s, d):
    return zsets.zremrangebylex(_prices(s, d), "(000000500", "+")


@query(f"with {_PRICES}, {_RANKED} select key, member, score from r where not (rank >= 0 and rank <= card - 11)")
def zremrangebyrank(s, d):
    return zsets.zremrangebyrank(_prices(s, d), 0, -11)


def _store(kind, weights, fold, both):
    expr = {"sum": "sum(score * w)", "min": "min(score * w)", "max": "max(score * w)"}[fold]
    sql = f"""with {_zsql('click', 'a')}, {_zsql('view', 'b')}, {_zsql('error', 'c')},
    u as (select *, {weights[0]}::double as w from a union all select *, {weights[1]}::double as w from b where member % 3 <> 0 union all select *, {weights[2]}::double as w from c where member % 2 = 0)
    select member, round({expr}, 6) as score from u group by member {'having count(*) = 3' if both else ''}"""

    def run(s, d):
        parts = [_z(s, d, "click"), _z(s, d, "view").filter("member % 3 <> 0"), _z(s, d, "error").filter("member % 2 = 0")]
        return zsets.zstore(parts, weights, fold, both).withColumn("score", F.round("score", 6))

    query(sql, kind)(run)


for _fold in ("sum", "min", "max"):
    _store(f"zunionstore_{_fold}", [1.0, 1.0, 1.0], _fold, False)
    _store(f"zinterstore_{_fold}", [1.0, 1.0, 1.0], _fold, True)
_store("zunionstore_weights", [2.0, 3.0, -1.0], "sum", False)
_store("zinterstore_weights", [2.0, 3.0, -1.0], "sum", True)

# ---- sets: parts of suppliers

_SETS = "t as (select distinct l_suppkey as key, l_partkey as member from lineitem)"


def _parts(s, d):
    return load(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_partkey").alias("member")).distinct()


@query(f"with {_SETS} select distinct member from t where key in (1, 2, 3)")
def sunion(s, d):
    return sets.sunion(_parts(s, d), [1, 2, 3])


@query(f"with {_SETS} select member from t where key = 1 intersect select member from t where key = 2")
def sinter(s, d):
    return sets.sinter(_parts(s, d), [1, 2])


@query(f"with {_SETS} select member from t where key = 1 except select member from t where key in (2, 3)")
def sdiff(s, d):
    return sets.sdiff(_parts(s, d), [1, 2, 3])


@query(f"with {_SETS} select distinct cast(-1 as bigint) as key, member from t where key in (4, 5)")
def sunionstore(s, d):
    return sets.sunion(_parts(s, d), [4, 5]).select(F.lit(-1).cast("bigint").alias("key"), "member")


@query(f"with {_SETS} select cast(-1 as bigint) as key, member from t where key = 4 and member in (select member from t where key = 5)")
def sinterstore(s, d):
    return sets.sinter(_parts(s, d), [4, 5]).select(F.lit(-1).cast("bigint").alias("key"), "member")


@query(f"with {_SETS} select cast(-1 as bigint) as key, member from t where key = 4 and member not in (select member from t where key = 5)")
def sdiffstore(s, d):
    return sets.sdiff(_parts(s, d), [4, 5]).select(F.lit(-1).cast("bigint").alias("key"), "member")


@query(f"with {_SETS} select key, count(*) as n from t group by key")
def scard(s, d):
    return sets.scard(_parts(s, d))


@query(f"with {_SETS} select member from t where key = 7")
def smembers(s, d):
    return sets.smembers(_parts(s, d), 7)


@query(f"with {_SETS} select p_partkey as member, cast(9 as bigint) as key, exists (select 1 from t where t.key = 9 and t.member = p_partkey) as found from part")
def sismember(s, d):
    return sets.sismember(_parts(s, d), load(s, d, "part").select(F.col("p_partkey").alias("member"), F.lit(9).cast("bigint").alias("key")))


@query(f"with {_SETS}, m as (select min(member) as m from t where key = 1) select distinct case when key = 1 and member = (select m from m) then 2 else key end as key, member from t")
def smove(s, d):
    p = _parts(s, d)
    m = p.filter("key = 1").agg(F.min("member")).first()[0]
    return sets.smove(p, 1, 2, m)


@query(f"with {_SETS} select key, member from t union select s_suppkey as key, cast(-5 as bigint) as member from supplier")
def sadd(s, d):
    return sets.sadd(_parts(s, d), load(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit(-5).cast("bigint").alias("member")))


@query(f"with {_SETS} select key, member from t where member not in (select p_partkey from part where p_size < 10)")
def srem(s, d):
    p = _parts(s, d)
    return sets.srem(p, p.join(load(s, d, "part").filter("p_size < 10").select(F.col("p_partkey").alias("member")), "member", "left_semi"))


@query(f"with {_SETS} select member from t where key = 3 order by md5(member || '/42'), member limit 5")
def srandmember(s, d):
    return sets.srandmember(_parts(s, d), 3, 5, 42)


@query(f"""with {_SETS}, m as (select member, row_number() over (order by member) as i, count(*) over () as n from (select distinct member from t where key = 3)),
g as (select cast('0x' || substr(md5(i || '/42'), 1, 12) as bigint) as h from (select unnest(range(40)) as i)) select member from g join m on m.i = g.h % m.n + 1""")
def srandmember_repeats(s, d):
    return sets.srandmember(_parts(s, d), 3, -40, 42)


@query(f"with {_SETS} select key, member from t where not (key = 3 and member in (select member from t where key = 3 order by md5(member || '/42'), member limit 4))")
def spop(s, d):
    return sets.spop(_parts(s, d), 3, 4, 42)


# ---- lists: order priorities of customers, in the order of keys

_LISTS = "l as (select o_custkey as key, o_orderkey as pos, o_orderpriority as value from orders), x as (select *, row_number() over (partition by key order by pos) - 1 as i, count(*) over (partition by key) as len from l)"


def _orders(s, d):
    return load(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))


@query(f"with {_LISTS} select key, i, value from x where i between 1 and 3")
def lrange(s, d):
    return lists.lrange(_orders(s, d), 1, 3)


@query(f"with {_LISTS} select key, i, value from x where i >= greatest(len - 3, 0) and i <= len - 1")
def lrange_negative(s, d):
    return lists.lrange(_orders(s, d), -3, -1)


@query(f"with {_LISTS} select key, value from x where i = len - 2")
def lindex(s, d):
    return lists.lindex(_orders(s, d), -2)


@query(f"with {_LISTS} select key, count(*) as n from l group by key")
def llen(s, d):
    return lists.llen(_orders(s, d))


@query(f"with {_LISTS} select key, i - 1 as pos, value from x where i >= 1 and i <= len - 2")
def ltrim(s, d):
    return lists.ltrim(_orders(s, d), 1, -2)


@query(f"with {_LISTS}, y as (select *, row_number() over (partition by key, value order by pos desc) as n from l) select key, row_number() over (partition by key order by pos) - 1 as pos, value from y where not (value = '1-URGENT' and n <= 2)")
def lrem(s, d):
    return lists.lrem(_orders(s, d), -2, "1-URGENT")


@query(f"with {_LISTS} select key, i as pos, case when i = 2 then 'changed' else value end as value from x")
def lset(s, d):
    return lists.lset(_orders(s, d), 2, "changed")


@query(f"""with {_LISTS}, f as (select key, min(pos) as pos from l where value = '5-LOW' group by key),
u as (select key, pos, 1 as o, value from l union all select key, pos, 0 as o, 'new' as value from f)
select key, row_number() over (partition by key order by pos, o) - 1 as pos, value from u""")
def linsert(s, d):
    return lists.linsert(_orders(s, d), "5-LOW", "new")


@query(f"with {_LISTS} select key, pos, value from x where i > 0")
def lpop(s, d):
    return lists.pop(_orders(s, d), left=True)


@query(f"with {_LISTS} select key, pos, value from x where i < len - 1")
def rpop(s, d):
    return lists.pop(_orders(s, d), left=False)


def _pushed(left, only):
    sql = f"""with {_LISTS}, e as (select key, min(pos) as lo, max(pos) as hi from l group by key),
    n as (select c_custkey as key, c_mktsegment as value from customer) select * from l union all
    select n.key, {'coalesce(lo, 0) - 1' if left else 'coalesce(hi, -1) + 1'} as pos, value from n {'join' if only else 'left join'} e on n.key = e.key"""

    def run(s, d):
        new = load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"), F.lit(0).alias("seq"))
        return lists.push(_orders(s, d), new, left, only)

    query(sql, ("l" if left else "r") + "push" + ("x" if only else ""))(run)


for _left in (True, False):
    for _only in (True, False):
        _pushed(_left, _only)


@query(f"""with {_LISTS}, t as (select pos, value from x where key = (select min(key) from l) and i = len - 1)
select key, pos, value from l where not (key = (select min(key) from l) and pos = (select pos from t))
union all select (select max(key) from l) as key, (select min(pos) from l where key = (select max(key) from l)) - 1 as pos, value from t""")
def rpoplpush(s, d):
    o = _orders(s, d)
    a, b = o.agg(F.min("key"), F.max("key")).first()
    return lists.rpoplpush(o, a, b).withColumn("key", F.col("key").cast("bigint"))


# ---- hashes: columns of customers

_HASH = "h as (select c_custkey as key, unnest(['name', 'nation', 'segment']) as field, unnest([c_name, cast(c_nationkey as varchar), c_mktsegment]) as value from customer)"


def _hash(s, d):
    c = load(s, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return hashes.from_columns(c, "c_custkey", ["name", "nation", "segment"])


@query(f"with {_HASH} select key, string_agg(field || '=' || value, ';' order by field) as fields from h group by key")
def hgetall(s, d):
    h = hashes.hgetall(_hash(s, d))
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return h.select("key", F.array_join(pairs, ";").alias("fields"))


@query(f"with {_HASH} select key, value from h where field = 'segment'")
def hget(s, d):
    return hashes.hget(_hash(s, d), "segment")


@query(f"with {_HASH}, w as (select distinct o_custkey as key, unnest([0, 1]) as i, unnest(['nation', 'missing']) as field from orders) select w.key, w.i, w.field, h.value from w left join h on w.key = h.key and w.field = h.field")
def hmget(s, d):
    return hashes.hmget(_hash(s, d), load(s, d, "orders").select(F.col("o_custkey").alias("key")), ["nation", "missing"])


@query(f"with {_HASH} select key, count(*) as n from h group by key")
def hlen(s, d):
    return hashes.hlen(_hash(s, d))


@query(f"with {_HASH} select key, cast(strlen(value) as bigint) as n from h where field = 'name'")
def hstrlen(s, d):
    return hashes.hstrlen(_hash(s, d), "name")


@query(f"with {_HASH} select key, cast(value as bigint) + 5 as value from h where field = 'nation'")
def hincrby(s, d):
    return hashes.hincrby(_hash(s, d), "nation", 5)


@query(f"with {_HASH} select key, cast(value as double) + 0.5 as value from h where field = 'nation'")
def hincrbyfloat(s, d):
    return hashes.hincrby(_hash(s, d), "nation", 0.5)


@query(f"with {_HASH} select key, field, value from h where field <> 'segment' or key not in (select o_custkey from orders)")
def hdel(s, d):
    return hashes.hdel(_hash(s, d), load(s, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("segment").alias("field")).distinct())


@query(f"with {_HASH} select distinct o_custkey as key, 'name' as field, o_custkey in (select key from h where field = 'name') as found from orders")
def hexists(s, d):
    return hashes.hexists(_hash(s, d), load(s, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("name").alias("field")).distinct())


@query(f"""with {_HASH}, n as (select o_custkey as key, 'segment' as field, arg_max(o_orderpriority, o_orderkey) as value from orders group by 1)
select * from n union all select * from h where not exists (select 1 from n where n.key = h.key and n.field = h.field)""")
def hset(s, d):
    return hashes.hset(_hash(s, d), load(s, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("segment").alias("field"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq")))


@query(f"""with {_HASH}, n as (select o_custkey as key, 'first' as field, arg_min(o_orderpriority, o_orderkey) as value from orders group by 1) select * from h union all select * from n""")
def hsetnx(s, d):
    o = load(s, d, "orders").select(F.col("o_custkey").alias("key"), F.explode(F.array(F.lit("first"), F.lit("segment"))).alias("field"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq"))
    c = load(s, d, "customer").select(F.col("c_custkey").alias("key"))
    return hashes.hsetnx(_hash(s, d), o.join(c, "key", "left_semi"))


# ---- strings


@query("select doc_id, cast(coalesce(strlen(text), 0) as bigint) as n from documents")
def strlen(s, d):
    return load(s, d, "documents").select("doc_id", strings.strlen(F.col("text")).alias("n"))


@query("select p_partkey, substr(p_name, 3, 4) as a, substr(p_name, greatest(length(p_name) - 3, 1), 3) as b from part")
def getrange(s, d):
    v = F.col("p_name").cast("binary")
    return load(s, d, "part").select("p_partkey", text.byte_range(v, 2, 5).cast("string").alias("a"), text.byte_range(v, -4, -2).cast("string").alias("b"))


@query("select p_partkey, 'sX' || substr(p_name, 3) as v from (select p_partkey, 's' || substr(p_name, 2) as p_name from part)")
def setrange(s, d):
    v = text.overwrite(F.col("p_name").cast("binary"), 0, F.lit("sX"))
    return load(s, d, "part").select("p_partkey", v.cast("string").alias("v"))


@query("select user_id as key, string_agg(event_type, '' order by event_id) as value from events group by user_id")
def append(s, d):
    return strings.append(load(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq")))


@query("select user_id as key, event_id as seq, lag(event_type) over (partition by user_id order by event_id) as old from events")
def getset(s, d):
    return strings.getset(load(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq")))


@query("select l_suppkey as key, seq, cast(sum(sum(l_linenumber)) over (partition by l_suppkey order by seq) as bigint) as value from (select *, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber as seq from lineitem) group by l_suppkey, seq")
def incr_running(s, d):
    """Rows of one key that fall on one moment are one increment by their sum."""
    rows = load(s, d, "lineitem").select(F.col("l_suppkey").alias("key"), F.expr("l_orderkey * 1000000 + l_partkey * 10 + l_linenumber").alias("seq"), F.col("l_linenumber").cast("bigint").alias("delta"))
    return strings.running(rows.groupBy("key", "seq").agg(F.sum("delta").alias("delta")))


@query("select coalesce(c_custkey, k) as key, coalesce(c_nationkey, 0) + coalesce(v, 0) as value from customer full join (select o_custkey as k, count(*) as v from orders group by 1) on c_custkey = k")
def incrby(s, d):
    e = load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("string").alias("value"))
    return strings.incrby(e, load(s, d, "orders").select(F.col("o_custkey").alias("key"), F.lit(1).cast("bigint").alias("delta")))


_NOW = 1704153600000  # 2024-01-02 00:00:00 UTC
_MS = "(epoch_us(ts) // 1000)"


def _writes(s, d):
    return load(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.when(F.col("event_type") != "click", F.lit(7200000)).cast("bigint").alias("ttl_ms"))


@query(f"select user_id as key, arg_max(event_type, event_id) as value, case when arg_max(event_type, event_id) = 'click' then null else max_by({_MS}, event_id) + 7200000 end as expire_at_ms from events group by user_id")
def set_with_expiry(s, d):
    return strings.set_last(_writes(s, d))


@query("select c_custkey as key, c_mktsegment as value from customer where c_custkey % 2 = 0 union all select o_custkey as key, arg_min(o_orderpriority, o_orderkey) as value from orders where o_custkey % 2 = 1 or o_custkey not in (select c_custkey from customer) group by 1")
def setnx(s, d):
    e = load(s, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return strings.setnx(e, load(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq")))


@query("select c_custkey as key, coalesce(v, c_mktsegment) as value from customer left join (select o_custkey as k, arg_max(o_orderpriority, o_orderkey) as v from orders group by 1) on k = c_custkey")
def set_xx(s, d):
    e = load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return strings.setxx(e, load(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("seq")))


@query("select n_name as key, cast(n_regionkey as varchar) as value from nation union all select r_name as key, 'region' as value from region")
def msetnx(s, d):
    e = load(s, d, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    new = load(s, d, "region").select(F.col("r_name").alias("key"), F.lit("region").alias("value"))
    clash = load(s, d, "nation").select(F.col("n_name").alias("key"), F.lit("never").alias("value"))
    return strings.msetnx(strings.msetnx(e, new), clash)


@query("select o_orderkey as i, o_custkey as key, c_name as value from orders left join (select * from customer where c_nationkey < 12) on o_custkey = c_custkey")
def mget(s, d):
    e = load(s, d, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    return strings.mget(e, load(s, d, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_custkey").alias("key")))


# ---- bits


@query("select p_partkey, cast(sum(bit_count(ascii(substr(p_name, cast(i as bigint), 1)))) as bigint) as n from part, lateral (select unnest(generate_series(1, length(p_name))) as i) group by p_partkey")
def bitcount(s, d):
    return load(s, d, "part").select("p_partkey", bits.bitcount(F.col("p_name")).alias("n"))


@query("""select p_partkey, cast(instr(b, '1') - 1 as bigint) as one, cast(instr(b, '0') - 1 as bigint) as zero, cast(instr(substr(b, 9, 16), '1') + 7 as bigint) as second_one,
cast(instr(substr(b, length(b) - 7, 8), '1') + length(b) - 9 as bigint) as last_one, cast((ascii(p_name) >> 6) & 1 as integer) as bit1
from (select p_partkey, p_name, string_agg(lpad(bin(ascii(substr(p_name, cast(i as bigint), 1))), 8, '0'), '' order by i) as b from part, lateral (select unnest(generate_series(1, length(p_name))) as i) group by p_partkey, p_name)""")
def bitpos(s, d):
    v = F.col("p_name").cast("binary")
    return load(s, d, "part").select("p_partkey", bits.bitpos(v, 1).alias("one"), bits.bitpos(v, 0).alias("zero"), bits.bitpos(v, 1, 1, 2).alias("second_one"), bits.bitpos(v, 1, -1).alias("last_one"), bits.getbit(v, 1).cast("int").alias("bit1"))


def _bitop(op, fold):
    # names of one length, so that bytes are columns in SQL
    sql = f"""with t as (select event_type as key, lpad(cast(event_id as varchar), 9, '0') as v from events),
    b as (select key, i, cast({fold}(ascii(substr(v, i, 1))) as bigint) as b from t, (select unnest([1, 2, 3, 4, 5, 6, 7, 8, 9]) as i) group by key, i)
    select key, upper(string_agg(lpad(hex(b), 2, '0'), '' order by i)) as value from b group by key"""

    def run(s, d):
        t = load(s, d, "events").select(F.col("event_type").alias("key"), F.lpad(F.col("event_id").cast("string"), 9, "0").cast("binary").alias("value"))
        return bits.bitop(t, "key", "value", op).select("key", F.hex("value").alias("value"))

    query(sql, f"bitop_{op}")(run)


for _op, _fold in (("and", "bit_and"), ("or", "bit_or"), ("xor", "bit_xor")):
    _bitop(_op, _fold)


@query("select r_regionkey, upper(string_agg(lpad(hex(255 - ascii(substr(r_name, cast(i as bigint), 1))), 2, '0'), '' order by i)) as v from region, lateral (select unnest(generate_series(1, length(r_name))) as i) group by r_regionkey")
def bitop_not(s, d):
    return load(s, d, "region").select("r_regionkey", F.hex(bits.bitnot(F.col("r_name").cast("binary"))).alias("v"))


# ---- keys: customers' names, alive for as long as their balance says

_KEYS = f"k as (select c_name as key, c_mktsegment as type, cast(c_nationkey % 3 as integer) as db, case when c_custkey % 3 = 0 then null else cast({_NOW} + c_nationkey * 1000 - 12000 as bigint) end as expire_at_ms from customer)"


def _keys(s, d):
    return load(s, d, "customer").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("type"), (F.col("c_nationkey") % 3).alias("db"), F.when(F.col("c_custkey") % 3 != 0, F.lit(_NOW) + F.col("c_nationkey") * 1000 - 12000).cast("bigint").alias("expire_at_ms"))


_ALIVE = f"(expire_at_ms is null or expire_at_ms > {_NOW})"


@query(f"with {_KEYS} select key from k where {_ALIVE} and key glob 'Customer#0000000[1-3]?'")
def keys_glob(s, d):
    return keyspace.keys_like(_keys(s, d), "Customer#0000000[1-3]?", _NOW)


@query(f"with {_KEYS} select key from k where {_ALIVE} and key like 'Customer#00000001%'")
def keys_prefix(s, d):
    return keyspace.keys_like(_keys(s, d), "Customer#00000001*", _NOW)


@query(f"with {_KEYS} select key from k where {_ALIVE} and key > 'Customer#000000040' order by key limit 25")
def scan_page(s, d):
    return keyspace.scan(_keys(s, d), "Customer#000000040", 25, _NOW)


@query(f"with {_KEYS}, w as (select 'Customer#' || lpad(cast(p_partkey as varchar), 9, '0') as key from part) select w.key, k.key is not null as found, coalesce(k.type, 'none') as type from w left join k on w.key = k.key and {_ALIVE}")
def exists(s, d):
    asked = load(s, d, "part").select(F.concat(F.lit("Customer#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("key"))
    return keyspace.exists(_keys(s, d), asked, _NOW)


@query(f"with {_KEYS} select count(*) as n from k where {_ALIVE}")
def dbsize(s, d):
    return keyspace.dbsize(_keys(s, d), _NOW)


@query(f"with {_KEYS} select key from k where {_ALIVE} order by md5(key || '/5'), key limit 1")
def randomkey(s, d):
    return keyspace.randomkey(_keys(s, d), _NOW, 5)


@query(f"with {_KEYS} select key, case when not {_ALIVE} then -2 when expire_at_ms is null then -1 else expire_at_ms - {_NOW} end as ttl_ms from k union all select 'missing' as key, cast(-2 as bigint) as ttl_ms")
def ttl(s, d):
    k = _keys(s, d)
    return keyspace.ttl(k, k.select("key").unionByName(k.select(F.lit("missing").alias("key"))), _NOW)


@query(f"with {_KEYS} select key, type, db, case when db = 1 then null else expire_at_ms end as expire_at_ms from k")
def persist(s, d):
    k = _keys(s, d)
    return keyspace.persist(k, k.filter("db = 1"))


@query(f"with {_KEYS} select key, type, db, case when db = 2 then {_NOW} + 777 else expire_at_ms end as expire_at_ms from k")
def expire(s, d):
    k = _keys(s, d)
    return keyspace.expire(k, k.filter("db = 2").select("key", F.lit(_NOW + 777).alias("at_ms"), F.lit(1).alias("seq")))


@query(f"with {_KEYS} select key, type, db, expire_at_ms from k where not {_ALIVE}")
def expired(s, d):
    return _keys(s, d).filter(~keyspace.alive(_NOW)).select("key", "type", "db", "expire_at_ms")


@query(f"with {_KEYS} select * from k where type <> 'BUILDING'")
def del_keys(s, d):
    k = _keys(s, d)
    return keyspace.delete(k, k.filter("type = 'BUILDING'"))


@query(f"with {_KEYS} select case when key = 'Customer#000000003' then 'renamed' else key end as key, type, db, expire_at_ms from k")
def rename(s, d):
    return keyspace.rename(_keys(s, d), "Customer#000000003", "renamed")


@query(f"with {_KEYS} select * from k")
def renamenx_taken(s, d):
    return keyspace.rename(_keys(s, d), "Customer#000000003", "Customer#000000004", only_new=True)


@query(f"with {_KEYS} select key, type, case when key = 'Customer#000000005' then (db + 7) else db end as db, expire_at_ms from k")
def move(s, d):
    k = _keys(s, d)
    db = load(s, d, "customer").filter("c_name = 'Customer#000000005'").select((F.col("c_nationkey") % 3)).first()[0]
    return keyspace.move(k, "Customer#000000005", db, db + 7)


@query(f"with {_KEYS} select db, count(*) as keys, count(expire_at_ms) as expires, coalesce(cast(floor(avg(expire_at_ms - {_NOW})) as bigint), 0) as avg_ttl from k where {_ALIVE} group by db")
def info_keyspace(s, d):
    return keyspace.info(_keys(s, d), _NOW)


@query(f"with {_KEYS} select * from k where db <> 1")
def flushdb(s, d):
    return keyspace.flush(_keys(s, d), 1)


@query(f"""with {_KEYS}, l as (select k.*, length(type) as size from k where {_ALIVE}),
o as (select key, coalesce(sum(size) over (order by expire_at_ms, key rows between unbounded preceding and 1 preceding), 0) as before from l where expire_at_ms is not null)
select key from o where before < (select sum(size) - 4000 from l)""")
def evict_volatile_ttl(s, d):
    k = _keys(s, d).withColumn("size", F.length("type")).withColumn("last_ms", F.lit(0))
    return keyspace.evict(k, 4000, "volatile-ttl", _NOW)


# ---- sorting by external keys


@query("select s_suppkey as element, n_name as get_0 from supplier left join nation on s_nationkey = n_nationkey order by s_acctbal desc, s_suppkey desc limit 10 offset 5")
def sort_by_external(s, d):
    sup = load(s, d, "supplier")
    w = sup.select(F.concat(F.lit("weight_"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_acctbal").cast("string").alias("value"))
    g = sup.join(load(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.concat(F.lit("nation_"), F.col("s_suppkey").cast("string")).alias("key"), F.col("n_name").alias("value"))
    return sorting.sort_by(sup.select(F.col("s_suppkey").alias("element")), w, "weight_*", {"nation_*": g}, descending=True, offset=5, count=10)


@query("select distinct p_name as element from part order by p_name limit 12")
def sort_alpha(s, d):
    return sorting.sort_by(load(s, d, "part").select(F.col("p_name").alias("element")).distinct(), alpha=True, count=12)


@query("select o_orderkey as element from orders order by o_totalprice, o_orderkey limit 20")
def sort_limit(s, d):
    o = load(s, d, "orders")
    w = o.select(F.concat(F.lit("w:"), F.col("o_orderkey").cast("string")).alias("key"), F.col("o_totalprice").cast("string").alias("value"))
    return sorting.sort_by(o.select(F.col("o_orderkey").alias("element")), w, "w:*", count=20)


# ---- sketches


@query("select event_type as key, true as close from events group by 1")
def pfcount(s, d):
    e = load(s, d, "events")
    exact = e.groupBy(F.col("event_type").alias("key")).agg(F.count_distinct("user_id").alias("x"))
    return sketches.pfcount(sketches.pfadd(e, "event_type", "user_id")).join(exact, "key").select("key", (F.abs(F.col("n") - F.col("x")) <= 0.05 * F.col("x")).alias("close"))


@query("select 'all' as key, true as close")
def pfmerge(s, d):
    e = load(s, d, "events")
    exact = e.agg(F.count_distinct("event_id").alias("x"))
    m = sketches.pfcount(sketches.pfmerge(sketches.pfadd(e, "event_type", "event_id"), "all"))
    return m.crossJoin(exact).select("key", (F.abs(F.col("n") - F.col("x")) <= 0.05 * F.col("x")).alias("close"))


@query("select 'seen' as key, true as none_missed, true as few_false")
def bloom(s, d):
    li, p = load(s, d, "lineitem").select(F.lit("seen").alias("key"), F.col("l_partkey").alias("item")).distinct(), load(s, d, "part")
    f = sketches.bloom_add(li, "key", "item", 200_000, 0.01)
    both = li.select("key", "item").unionByName(p.select(F.lit("seen").alias("key"), (-1 - F.col("p_partkey")).alias("item")))
    got = sketches.bloom_exists(f, both, "key", "item", 200_000, 0.01)
    return got.groupBy("key").agg(F.bool_and(F.col("found") | (F.col("item") < 0)).alias("none_missed"), (F.avg(F.when(F.col("item") < 0, F.col("found").cast("double"))) < 0.03).alias("few_false"))


# ---- logs, channels, streams


@query("select event_id, 1 + cast(event_type in ('click', 'view') as bigint) + cast(event_type like '%r%' as bigint) as receivers from events")
def pubsub_receivers(s, d):
    e = load(s, d, "events").select("event_id", F.col("event_type").alias("channel"))
    subs = s.createDataFrame([("click", 1), ("view", 1), ("*", 2), ("*r*", 3)], "pattern string, subscriber long")
    return pubsub.receivers(e, subs, "event_id")


@query("""with a as (select event_type as key, value, row_number() over (partition by event_type order by event_id) as n from events where event_id % 2 = 0),
b as (select event_type as key, event_id as seq, row_number() over (partition by event_type order by event_id) as n from events where event_id % 2 = 1)
select b.key, b.seq, a.value from b left join a on a.key = b.key and a.n = b.n""")
def blpop_pairs(s, d):
    e = load(s, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), "value")
    return pubsub.blocking_pops(e.filter("seq % 2 = 0"), e.filter("seq % 2 = 1"))


@query("""with w as (select user_id as client, user_id % 50 as key, event_id as seq, event_id + 40 as exec_seq from events where event_type = 'view'),
x as (select user_id % 50 as key, event_id as seq from events where event_type = 'purchase')
select client, key, seq, exec_seq, exists (select 1 from x where x.key = w.key and x.seq > w.seq and x.seq < w.exec_seq) as aborted from w""")
def watch_conflicts(s, d):
    e = load(s, d, "events")
    w = e.filter("event_type = 'view'").select(F.col("user_id").alias("client"), (F.col("user_id") % 50).alias("key"), F.col("event_id").alias("seq"), (F.col("event_id") + 40).alias("exec_seq"))
    return pubsub.watch_conflicts(w, e.filter("event_type = 'purchase'").select((F.col("user_id") % 50).alias("key"), F.col("event_id").alias("seq")))


@query("""with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 2 hour then 0 else 1 end as new from events),
i as (select *, sum(new) over (partition by user_id order by ts) as i from g)
select user_id, min(ts) as start, max(ts) as stop, count(*) as n from i group by user_id, i""")
def session_counts(s, d):
    return pubsub.sessions(load(s, d, "events"), "user_id", "ts", "2 hours")


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def tumbling_counts(s, d):
    return pubsub.tumbling(load(s, d, "events"), "ts", "1 hour", "event_type")


@query("select node, id, duration from slowlog where duration >= 1000000 order by duration desc, node, id limit 50")
def slowlog_get(s, d):
    return pubsub.slowest(load(s, d, "slowlog"), 50, 1_000_000).select("node", "id", "duration")


@query("""with e as (select lower(command[1]) as c, command[2] as k from slowlog where len(command) > 1 and lower(command[1]) in ('set', 'del', 'zadd', 'hset'))
select '__keyspace@0__:' || k as channel, c as message from e union all select '__keyevent@0__:' || c as channel, k as message from e""")
def notifications(s, d):
    return pubsub.notifications(load(s, d, "slowlog").select(F.lit("0").alias("db"), F.col("command").alias("argv")))


@query("""with r as (select l_suppkey as segment, l_orderkey * 100 + l_linenumber as start, l_orderkey * 100 + l_linenumber + cast(l_quantity as bigint) as stop from lineitem),
m as (select *, max(stop) over (partition by segment order by start, stop rows between unbounded preceding and 1 preceding) as reach from r),
i as (select *, sum(case when reach is null or start - reach > 500 then 1 else 0 end) over (partition by segment order by start, stop rows unbounded preceding) as i from m)
select segment, min(start) as start, max(stop) as stop, count(*) as n from i group by segment, i""")
def coalesce_ranges(s, d):
    r = load(s, d, "lineitem").select(F.col("l_suppkey").alias("segment"), F.expr("l_orderkey * 100 + l_linenumber").alias("start"), F.col("l_quantity").cast("bigint").alias("length"))
    return ranges.coalesce(r, 500)


@query("select doc_id, n_patches from (select distinct doc_id, n_patches from doc_records) where doc_id not in (select doc_id from documents where http_status = 404)")
def tombstones(s, d):
    gone = load(s, d, "documents").filter("http_status = 404")
    return live(load(s, d, "doc_records").select("doc_id", "n_patches").distinct(), gone)


@query("select n_nationkey, round(2.0 * 6372797.560856 * asin(sqrt(power(sin(radians(n_regionkey * 7 - n_nationkey) / 2), 2) + cos(radians(n_nationkey)) * cos(radians(n_regionkey * 7)) * power(sin(radians(n_nationkey * 3) / 2), 2))), 2) as metres from nation")
def geo_distance(s, d):
    n = load(s, d, "nation")
    k, r = F.col("n_nationkey").cast("double"), F.col("n_regionkey").cast("double")
    return n.select("n_nationkey", F.round(haversine(k, k * 0.0, r * 7.0, k * 3.0), 2).alias("metres"))


@query(f"with {_HASH} select field from h where key = 7")
def hkeys(s, d):
    return hashes.hkeys(_hash(s, d), 7)


@query(f"with {_HASH} select value from h where key = 7")
def hvals(s, d):
    return hashes.hvals(_hash(s, d), 7)


@query(f"with {_HASH} select field, value from h where key = 7 and field > 'name' and field like '%a%' order by field limit 1")
def hscan(s, d):
    return hashes.hscan(_hash(s, d), 7, "name", 1, "*a*")


@query(f"with {_SETS} select member from t where key = 3 and member > 50 order by member limit 10")
def sscan(s, d):
    return sets.sscan(_parts(s, d), 3, 50, 10)


@query(f"with {_PRICES} select key, member, score from p where key = 'Brand#2' and (score > 905 or (score = 905 and member > '000000050')) order by score, member limit 10")
def zscan(s, d):
    return zsets.zscan(_prices(s, d), "Brand#2", (905.0, "000000050"), 10)


@query("""with e as (select event_type as key, user_id as member, arg_max(value, event_id) as score from events where event_id < 300 group by 1, 2),
n as (select event_type as key, user_id as member, arg_max(value, event_id) as score from events where event_id >= 300 group by 1, 2)
select n.key, count(*) filter (where e.score is null) as added, count(*) filter (where e.score is null or e.score <> n.score) as changed from n left join e on e.key = n.key and e.member = n.member group by n.key""")
def zadd_changed(s, d):
    return zsets.zadd_changed(_ops(s, d).filter("seq >= 300"), zsets.zadd(_ops(s, d).filter("seq < 300")))


@query("select p_partkey, chr(cast(ascii(p_name) | 64 as integer)) || substr(p_name, 2) as v from part")
def setbit(s, d):
    return load(s, d, "part").select("p_partkey", bits.setbit(F.col("p_name").cast("binary"), 1, 1).cast("string").alias("v"))


@query("select c_custkey as key, c_mktsegment as value from customer where c_custkey not in (select s_suppkey from supplier) union all select s_suppkey as key, s_name as value from supplier")
def mset(s, d):
    e = load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return strings.mset(e, load(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value")))


@query("select distinct event_type as channel from events where event_type like '%i%'")
def pubsub_channels(s, d):
    e = load(s, d, "events").select(F.col("event_type").alias("pattern"), F.col("user_id").alias("subscriber"))
    return pubsub.channels(e.unionByName(e.withColumn("pattern", F.lit("x*i*"))), "*i*")


@query("select node, cast(quantile_disc(duration, 0.5) as bigint) as p50, cast(quantile_disc(duration, 0.95) as bigint) as p95, cast(quantile_disc(duration, 0.99) as bigint) as p99 from slowlog where duration is not null group by node")
def latency_percentiles(s, d):
    return pubsub.latencies(load(s, d, "slowlog"), "node")


@query("select user_id as key, count(*) as n, cast(sum(case when event_type = 'purchase' then 1 else 0 end) as bigint) as bought from events group by user_id having count(*) > 0")
def replayed_counters(s, d):
    """A log of INCR commands, replayed in order; the last reply of each counter is its value."""
    from quarryset.streaming import replay

    e = load(s, d, "events").select(F.col("user_id").cast("string").alias("group"), (F.col("event_id") * 2).alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.array(F.lit("INCRBY"), F.lit("n"), F.lit("1")).alias("argv"), "event_type")
    b = e.withColumn("seq", F.col("seq") + 1).withColumn("argv", F.array(F.lit("INCRBY"), F.lit("bought"), F.when(F.col("event_type") == "purchase", "1").otherwise("0")))
    out = replay.replay(e.drop("event_type").unionByName(b.drop("event_type")))
    last = out.groupBy("group", (F.col("seq") % 2).alias("_k")).agg(F.max_by(F.col("reply").cast("bigint"), "seq").alias("v"))
    return last.groupBy(F.col("group").cast("bigint").alias("key")).agg(F.max(F.when(F.col("_k") == 0, F.col("v"))).alias("n"), F.max(F.when(F.col("_k") == 1, F.col("v"))).alias("bought"))


# ---- variants of the operators above


@query(f"with {_KEYS} select case when key = 'Customer#000000003' then 'fresh' else key end as key, type, db, expire_at_ms from k")
def renamenx(s, d):
    return keyspace.rename(_keys(s, d), "Customer#000000003", "fresh", only_new=True)


@query("select c_custkey as key, c_mktsegment as value from customer where c_custkey = 11")
def get(s, d):
    return strings.get(load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value")), 11)


@query("select coalesce(c_custkey, k) as key, round(coalesce(c_acctbal, 0) + coalesce(v, 0), 2) as value from customer full join (select o_custkey as k, sum(o_totalprice) as v from orders group by 1) on c_custkey = k")
def incrbyfloat(s, d):
    c = load(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("string").alias("value"))
    return strings.incrbyfloat(c, load(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_totalprice").alias("delta"))).select("key", F.round("value", 2).alias("value"))


@query(f"with {_KEYS} select count(*) as n from k where key < 'Customer#000000010'")
def del_count(s, d):
    k = _keys(s, d)
    return keyspace.deleted(k, k.filter("key < 'Customer#000000010'").select("key").unionByName(k.limit(0).select("key")))


@query(f"with {_SETS} select key, member from t union all select 999 as key, member from t where key = 3")
def dump_restore(s, d):
    p = _parts(s, d)
    return keyspace.restore(p, keyspace.dump(p, 3), 999)


@query(f"with {_SETS} select member from t where key = 3 and member > 50 and cast(member as varchar) like '%1%' order by member limit 10")
def sscan_match(s, d):
    return sets.sscan(_parts(s, d), 3, 50, 10, "*1*")


@query(f"with {_PRICES} select key, member, score from p where key = 'Brand#2' and member like '%7' order by score, member limit 10")
def zscan_match(s, d):
    return zsets.zscan(_prices(s, d), "Brand#2", None, 10, "*7")


@query("select row_number() over (order by p_name) - 1 as pos, 'sorted' as key, p_name as value from (select distinct p_name from part order by p_name limit 12)")
def sort_store(s, d):
    e = load(s, d, "part").select(F.col("p_name").alias("element")).distinct()
    return sorting.store(sorting.sort_by(e, alpha=True, count=12), "sorted")


@query(f"""with {_LISTS}, f as (select key, min(pos) as p from l where value = '1-URGENT' group by key),
e as (select key, pos, 1 as o, value from l union all select key, p, 2 as o, 'new' as value from f) select key, row_number() over (partition by key order by pos, o) - 1 as pos, value from e""")
def linsert_after(s, d):
    return lists.linsert(_orders(s, d), "1-URGENT", "new", before=False)


@query("select event_type as channel, count(distinct user_id) as n from events group by 1")
def pubsub_numsub(s, d):
    return pubsub.numsub(load(s, d, "events").select(F.col("event_type").alias("pattern"), F.col("user_id").alias("subscriber")))


@query("select count(distinct user_id) as n from events")
def pubsub_numpat(s, d):
    return pubsub.numpat(load(s, d, "events").select(F.concat(F.lit("all*"), F.col("event_type").substr(1, 0)).alias("pattern"), F.col("user_id").alias("subscriber")))


@query("select count(*) as n from slowlog where duration >= 10000")
def slowlog_len(s, d):
    return pubsub.slowlog_len(load(s, d, "slowlog"), 10_000)


@query(f"""with {_KEYS}, x as (select key, db from k where expire_at_ms <= {_NOW} and expire_at_ms > 0)
select '__keyspace@' || db || '__:' || key as channel, 'expired' as message from x union all select '__keyevent@' || db || '__:expired' as channel, key as message from x""")
def expired_events(s, d):
    return pubsub.expirations(_keys(s, d), 0, _NOW)


def _evict(policy: str, order: str, only: str):
    @query(f"""with {_KEYS}, l as (select k.*, length(type) as size, ascii(substr(key, length(key), 1)) as last_ms from k where {_ALIVE}),
    o as (select key, coalesce(sum(size) over (order by {order}, key rows between unbounded preceding and 1 preceding), 0) as before from l where {only})
    select key from o where before < (select sum(size) - 4000 from l)""", f"evict_{policy.replace('-', '_')}")
    def run(s, d):
        k = _keys(s, d).withColumn("size", F.length("type")).withColumn("last_ms", F.ascii(F.substring("key", -1, 1)))
        return keyspace.evict(k, 4000, policy, _NOW, 9)


for _policy, _order, _only in (("allkeys-lru", "last_ms", "true"), ("volatile-lru", "last_ms", "expire_at_ms is not null"), ("allkeys-random", "md5(key || '/9')", "true"), ("volatile-random", "md5(key || '/9')", "expire_at_ms is not null")):
    _evict(_policy, _order, _only)


@query("select c_custkey as ts_ms, printf('%d.%03d000 [%d] \"SET\" \"%s\" \"%s\"', c_custkey // 1000, c_custkey % 1000, c_nationkey, c_name, c_mktsegment) as line from customer")
def monitor(s, d):
    ops = load(s, d, "customer").select(F.col("c_custkey").alias("ts_ms"), F.col("c_nationkey").alias("db"), F.array(F.lit("SET"), "c_name", "c_mktsegment").alias("argv"))
    return pubsub.monitor(ops)
