import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryset.llm import p3_percentiles as p3
from quarryset.llm import registry
from quarryset.runtime import Scratch
from tests.oracle import ROOT, differs


def test_exact_percentiles_over_many_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", int(v)) for v in rng.lognormal(8, 3, 4000)] + [("ties", 5)] * 300 + [("one", 7)] + [("two", 0), ("two", 10)] + [("big", 2**62), ("big", 1)]
    df = spark.createDataFrame(rows, "g string, value bigint").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.g: r for r in p3.percentiles(p3.sorted_counts(df, ["g"], Scratch(spark, "t")), ["g"]).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for g in ("hot", "ties", "one", "two", "big"):
        v = np.array([x for h, x in rows if h == g], float)
        assert got[g].n == len(v)
        for name, p in p3.PROBS.items():
            want = np.quantile(v, p)
            assert abs(got[g][name] - want) <= max(1e-3, 1e-12 * abs(want)), (g, name)


def test_merged_summaries_keep_their_stated_error(spark):
    rng = np.random.default_rng(2)
    rows = [(day, int(v)) for day in range(5) for v in rng.lognormal(5 + day, 2, 20_000)]
    df = spark.createDataFrame(rows, "day int, value bigint")
    kept = p3.summary(p3.sorted_counts(df, ["day"], Scratch(spark, "t")), ["day"])
    assert kept.count() < 5 * 2000
    r = p3.combine(kept.withColumn("span", F.lit("all")), ["day"], ["span"]).first()
    v = np.sort([x for _, x in rows])
    for name, p in p3.PROBS.items():
        h = np.ceil(p * len(v))
        lo, hi = np.searchsorted(v, r[name], "left") + 1, np.searchsorted(v, r[name], "right")
        off = max(0, lo - h, h - hi) / len(v)
        assert off <= r[f"{name}_err"] + 1e-9 <= 0.01, (name, off)


def test_what_counts(spark):
    rows = [("n", 1, "2026-05-01 23:59:59", 5, ["get", "k"]), ("n", 1, "2026-05-01 23:59:59", 5, ["get", "k"]), ("n", 2, "2026-05-01 00:00:00", -1, ["GET"]), ("n", 3, "2026-05-01 00:00:00", None, ["GET"]), ("n", 4, "2026-05-01 00:00:00", 0, ["Get"]), ("n", 5, "2026-05-01 00:00:00", 3, []), ("n", 6, "2026-05-01 00:00:00", 3, None), ("n", 7, None, 3, ["GET"]), ("n", 8, "2026-05-02 00:00:00", 3, [None]), ("n", 9, "2026-05-02 00:00:00", 3, [""])]
    df = spark.createDataFrame(rows, "node string, id int, ts string, duration bigint, command array<string>").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert sorted((r.verb, str(r.day), r.value) for r in p3.valid(df).collect()) == [("GET", "2026-05-01", 0), ("GET", "2026-05-01", 5)]
    none = p3.percentiles(p3.sorted_counts(p3.valid(df.limit(0)), ["verb", "day"], Scratch(spark, "t")), ["verb", "day"])
    assert none.count() == 0


@pytest.mark.skipif(not ROOT.exists(), reason="no test data here")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, name):
    assert differs(spark, name, registry.QUERIES[name], registry.SQL[name], str(ROOT / "sf0.001")) is None
