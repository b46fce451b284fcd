"""Golden cases, edge cases and random models of the keyed structures."""

import random

import pytest
from pyspark.sql import functions as F

from quarryset.functions import bits, text
from quarryset.operators import hashes, keyspace, lists, sets, sketches, sorting, strings, zsets


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*(cols or df.columns)).collect()), key=repr)


def z(spark, items):
    return spark.createDataFrame([("k", m, float(s)) for m, s in items.items()], "key string, member string, score double")


def m(spark, items):
    return spark.createDataFrame([(k, float(v)) for k, v in items.items()], "member string, score double")


def test_zset_order_after_update(spark):
    ops = spark.createDataFrame([("z", "x", 10.0, 1), ("z", "y", 20.0, 2), ("z", "z", 30.0, 3), ("z", "y", 1.0, 4), ("z", None, 1.0, 5), ("z", "w", float("nan"), 6)], "key string, member string, score double, seq int")
    got = zsets.zrange(zsets.zadd(ops), 0, -1).orderBy("rank").collect()
    assert [r.member for r in got] == ["y", "x", "z"]


@pytest.mark.parametrize(
    ("kw", "want"),
    [
        ({}, {"a": 1, "b": 3, "d": 3, "c": 5}),
        ({"weights": [2.0, 3.0]}, {"a": 2, "b": 7, "d": 9, "c": 12}),
        ({"aggregate": "min"}, {"a": 1, "b": 1, "c": 2, "d": 3}),
        ({"aggregate": "max"}, {"a": 1, "b": 2, "c": 3, "d": 3}),
        ({"intersect": True}, {"b": 3, "c": 5}),
        ({"intersect": True, "weights": [2.0, 3.0]}, {"b": 7, "c": 12}),
    ],
)
def test_zstore(spark, kw, want):
    got = zsets.zstore([m(spark, {"a": 1, "b": 2, "c": 3}), m(spark, {"b": 1, "c": 2, "d": 3})], **kw)
    assert {r.member: r.score for r in got.collect()} == want


def test_infinities_cancel_to_zero(spark):
    got = zsets.zstore([m(spark, {"x": float("inf")}), m(spark, {"x": float("-inf")})]).collect()
    assert got[0].score == 0.0


def test_bounds_are_distinct_for_open_and_infinite(spark):
    s = z(spark, {"a": 1, "b": 2, "c": 3, "d": float("inf")})
    assert [r[0] for r in rows(zsets.zrangebyscore(s, "(1", "(3"), "member")] == ["b"]
    assert zsets.zcount(s, "-inf", "+inf").first().n == 4
    assert zsets.zcount(s, "+inf", "-inf").first().n == 0
    assert [r[0] for r in rows(zsets.zrangebylex(s, "(a", "[c"), "member")] == ["b", "c"]
    assert zsets.zlexcount(s, "+", "-").first().n == 0


def test_random_ranges_agree_with_a_model(spark):
    rng = random.Random(5)
    items = {f"m{rng.randrange(40)}": rng.randrange(6) for _ in range(60)}
    order = sorted(items, key=lambda k: (items[k], k))
    df = z(spark, items).cache()
    for _ in range(12):
        a, b = rng.randrange(-45, 45), rng.randrange(-45, 45)
        n = len(order)
        lo, hi = (a + n if a < 0 else a), (b + n if b < 0 else b)
        want = [order[i] for i in range(n) if max(lo, 0) <= i <= hi]
        assert [r.member for r in zsets.zrange(df, a, b).orderBy("rank").collect()] == want
        kept = [k for k in order if k not in want]
        assert sorted(r.member for r in zsets.zremrangebyrank(df, a, b).collect()) == sorted(kept)


def test_set_algebra_with_missing_and_equal_keys(spark):
    s = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(5, 15)], "key string, member int")
    assert rows(sets.sinter(s, ["a", "b"])) == [(i,) for i in range(5, 10)]
    assert rows(sets.sinter(s, ["a", "nope"])) == []
    assert rows(sets.sdiff(s, ["a", "b"])) == [(i,) for i in range(5)]
    assert rows(sets.sdiff(s, ["a", "a"])) == []
    assert rows(sets.sdiff(s, ["nope", "a"])) == []
    assert sets.sunion(s, ["a", "b", "nope"]).count() == 15


def test_random_set_differences(spark):
    rng = random.Random(9)
    model = {k: {rng.randrange(30) for _ in range(rng.randrange(1, 25))} for k in "abcd"}
    s = spark.createDataFrame([(k, v) for k, vs in model.items() for v in vs], "key string, member int")
    assert {r.member for r in sets.sdiff(s, list("abcd")).collect()} == model["a"] - model["b"] - model["c"] - model["d"]
    assert {r.member for r in sets.sinter(s, list("ab")).collect()} == model["a"] & model["b"]


def test_random_members(spark):
    s = spark.createDataFrame([("a", i) for i in range(10)], "key string, member int")
    assert sets.srandmember(s, "a", 4, 1).distinct().count() == 4
    assert sets.srandmember(s, "a", 40, 1).count() == 10
    assert sets.srandmember(s, "a", -40, 1).count() == 40
    assert sets.spop(s, "a", 3, 1).count() == 7


def items(spark, values, key="l"):
    return spark.createDataFrame([(key, i * 10, v) for i, v in enumerate(values)], "key string, pos long, value string")


def listed(df):
    return [r.value for r in df.orderBy("pos").collect()]


def test_list_removal(spark):
    four = items(spark, ["value"] * 4)
    assert lists.lrem(four, 2, "value").count() == 2
    mixed = items(spark, list("abcabca"))
    assert listed(lists.lrem(mixed, 2, "a")) == list("bcbca")
    assert listed(lists.lrem(mixed, -2, "a")) == list("abcbc")
    assert listed(lists.lrem(mixed, 0, "a")) == list("bcbc")


def test_list_edits(spark):
    base = items(spark, list("abc"))
    assert listed(lists.linsert(base, "b", "x")) == list("axbc")
    assert listed(lists.linsert(base, "b", "x", before=False)) == list("abxc")
    assert listed(lists.linsert(base, "z", "x")) == list("abc")
    assert listed(lists.lset(base, -1, "z")) == list("abz")
    assert listed(lists.ltrim(base, 2, 1)) == []
    assert [r.value for r in lists.lrange(base, -100, 100).orderBy("i").collect()] == list("abc")
    new = spark.createDataFrame([("l", "p", 1), ("l", "q", 2), ("other", "r", 3)], "key string, value string, seq int")
    assert listed(lists.push(base, new, left=True, only_existing=True)) == list("qpabc")
    assert listed(lists.push(base, new, left=False).filter("key = 'l'")) == list("abcpq")
    assert listed(lists.rpoplpush(base, "l", "l")) == list("cab")


def test_hash_numbers(spark):
    h = spark.createDataFrame([("a", "n", "7"), ("b", "n", "text"), ("c", "n", str(2**63 - 1))], "key string, field string, value string")
    assert rows(hashes.hincrby(h, "n", 3)) == [("a", 10), ("b", 3), ("c", None)]
    assert rows(hashes.hincrby(h, "n", 0.5))[0] == ("a", 7.5)
    assert hashes.hgetall(h).filter("key = 'a'").first().fields == {"n": "7"}


@pytest.mark.parametrize(
    ("pattern", "yes", "no"),
    [("foo*", ["foo", "foobar"], ["fo", "xfoo"]), ("h?llo", ["hello", "h\nllo"], ["hllo"]), ("h[a-c]t", ["hat", "hct"], ["hdt"]), ("h[^a]t", ["hot"], ["hat"]), (r"a\*b", ["a*b"], ["axb"]), ("*", ["", "x"], []), ("a.b", ["a.b"], ["axb"]), ("[]]x", ["]x"], ["x"])],
)
def test_glob(spark, pattern, yes, no):
    df = spark.createDataFrame([(v,) for v in yes + no], "v string")
    assert sorted(r.v for r in df.filter(text.glob(F.col("v"), pattern)).collect()) == sorted(yes)


def test_prefix_globs_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([("abc",)], "v string").write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).filter(text.glob(F.col("v"), "ab*"))._jdf.queryExecution().toString()
    assert "StringStartsWith(v,ab)" in plan


def test_expiry_and_rename(spark):
    k = spark.createDataFrame([("a", "string", 100, 0), ("b", "string", None, 0), ("c", "list", 200, 1)], "key string, type string, expire_at_ms long, db int")
    assert rows(keyspace.visible(k, 100), "key") == [("b",), ("c",)]
    assert rows(keyspace.ttl(k, k, 150)) == [("a", -2), ("b", -1), ("c", 50)]
    assert rows(keyspace.rename(k, "c", "b")) == [("a", "string", 100, 0), ("b", "list", 200, 1)]
    assert rows(keyspace.rename(k, "nope", "b")) == rows(k)
    assert rows(keyspace.move(k, "a", 0, 1), "key", "db") == [("a", 1), ("b", 0), ("c", 1)]
    assert keyspace.scan(k, "a", 1, 0).first().key == "b"
    assert keyspace.flush(k).count() == 0


def test_bits(spark):
    df = spark.createDataFrame([(b"foobar",), (b"",), (b"\xff\xf0\x00",), (None,)], "v binary")
    got = df.select(bits.bitcount(F.col("v")).alias("n"), bits.bitpos(F.col("v"), 0).alias("z")).collect()
    assert [r.n for r in got] == [26, 0, 12, 0]
    assert got[2].z == 12
    g = spark.createDataFrame([("k", b"\xff"), ("k", b"\x0f\xf0")], "key string, v binary")
    assert {op: bytes(bits.bitop(g, "key", "v", op).first().v) for op in ("and", "or", "xor")} == {"and": b"\x0f\x00", "or": b"\xff\xf0", "xor": b"\xf0\xf0"}
    assert bytes(df.limit(1).select(text.overwrite(F.lit(b"ab"), 4, F.lit("x")).alias("v")).first().v) == b"ab\x00\x00x"


def test_sketches(spark):
    e = spark.createDataFrame([("k", i) for i in [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 10]], "key string, e int")
    assert sketches.pfcount(sketches.pfadd(e, "key", "e")).first().n == 10
    three = spark.createDataFrame([("x", v) for v in "abc"] + [("y", v) for v in "bcd"] + [("z", v) for v in "cde"], "key string, e string")
    assert sketches.pfcount(sketches.pfmerge(sketches.pfadd(three, "key", "e"), "all")).first().n == 5
    f = sketches.bloom_add(e, "key", "e", 1000, 0.01)
    asked = spark.createDataFrame([("k", 3), ("k", 999), ("none", 3)], "key string, e int")
    assert rows(sketches.bloom_exists(f, asked, "key", "e", 1000, 0.01)) == [("k", 3, True), ("k", 999, False), ("none", 3, False)]
    with pytest.raises(ValueError):
        sketches.bloom_size(0, 0.1)


def test_sort_by_missing_weights(spark):
    e = spark.createDataFrame([(1,), (2,), (3,)], "element int")
    w = spark.createDataFrame([("w_1", "5"), ("w_2", "no number")], "key string, value string")
    assert [r.element for r in sorting.sort_by(e, w, "w_*").collect()] == [2, 3, 1]


def test_strings(spark):
    w = spark.createDataFrame([("k", "a", 1, 1000, 500), ("k", "b", 2, 2000, None)], "key string, value string, seq int, ts_ms long, ttl_ms long")
    assert rows(strings.set_last(w)) == [("k", "b", None)]
    old = spark.createDataFrame([("k", "0")], "key string, value string")
    d = spark.createDataFrame([("k", 5), ("new", 1)], "key string, delta long")
    assert rows(strings.incrby(old, d)) == [("k", 5), ("new", 1)]
    assert strings.msetnx(old, spark.createDataFrame([("k", "x"), ("y", "z")], "key string, value string")).count() == 1


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "key string, member string, score double")
    assert zsets.zrange(none, 0, -1).count() == 0
    assert zsets.zstore([none.select("member", "score")] * 2, intersect=True).count() == 0
    assert lists.indexed(spark.createDataFrame([], "key string, pos long, value string")).count() == 0
    assert sets.sinter(none, ["a"]).count() == 0
