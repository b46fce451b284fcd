"""Vectors, payloads, codecs and text."""

import numpy as np
from pyspark.sql import functions as F

from quarryset.functions import distance, payload
from quarryset.operators import fulltext, ivf, maxsim, quantize, vectors
from quarryset.operators.ordering import accumulated
from quarryset.plans import planner
from quarryset.streaming import pubsub


def points(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")


def test_flat_search(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.0, 0.0, 1.0]), (4, None), (5, [1.0]), (6, [float("nan"), 0.0, 0.0])], "id long, vector array<float>")
    got = vectors.knn(p, [1.0, 0.0, 0.0], 2, "l2").collect()
    assert [r.id for r in got] == [1, 2] and got[0].score < 0.01
    assert vectors.knn(p, [1.0, 0.0, 0.0], 9).count() == 3


def test_zero_vector_has_cosine_zero(spark):
    p = points(spark, [[0, 0], [1, 0]])
    assert [(r.id, r.score) for r in vectors.knn(p, [1.0, 0.0], 5).collect()] == [(1, 1.0), (0, 0.0)]


def test_batch_agrees_with_join_and_keeps_ties(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 8)), 2)
    x[50:60] = x[0]
    p = points(spark, x).repartition(5)
    q = p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    for metric in ("cosine", "l2", "dot"):
        a = sorted(map(tuple, vectors.knn_batch(p, q, 7, metric).select("qid", "id", "rank").collect()))
        b = sorted(map(tuple, vectors.knn_join(p, q, 7, metric).select("qid", "id", "rank").collect()))
        assert a == b


def test_upsert_and_scroll(spark):
    p = spark.createDataFrame([("c", "1", 1), ("c", "2", 2)], "collection string, id string, v int")
    u = spark.createDataFrame([("c", "2", 20, 1), ("c", "2", 21, 2), ("c", "3", 3, 3)], "collection string, id string, v int, seq int")
    got = vectors.upsert(p, u)
    assert sorted(map(tuple, got.collect())) == [("c", "1", 1), ("c", "2", 21), ("c", "3", 3)]
    assert [r.id for r in vectors.scroll(got, 2, "1").collect()] == ["2", "3"]


def test_payload(spark):
    d = spark.createDataFrame([(1, '{"metadata": {"hash": "x"}, "n": 1}'), (2, '{"n": 1.0}'), (3, '{"n": "1"}'), (4, "broken{"), (5, None), (6, '{"n": null}')], "id int, payload string")
    ids = lambda c: sorted(r.id for r in d.filter(c).collect())
    assert ids(payload.matches(F.col("payload"), "metadata.hash", "x")) == [1]
    assert ids(payload.matches(F.col("payload"), "n", 1)) == [1, 2]
    assert ids(payload.matches(F.col("payload"), "n", "1")) == [3]
    assert ids(payload.present(F.col("payload"), "n")) == [1, 2, 3, 6]
    assert ids(payload.matches(F.col("payload"), "n", None)) == [6]
    assert ids(payload.condition(F.col("payload"), must=["n"], must_not=[("n", 1)])) == [3, 6]


def test_ivf_recall_and_no_loss(spark):
    rng = np.random.default_rng(1)
    centres = rng.uniform(-1, 1, size=(16, 16))
    x = centres[rng.integers(0, 16, 1500)] + rng.uniform(-0.2, 0.2, size=(1500, 16))
    p = points(spark, x).cache()
    config = ivf.IvfConfig(lists=16, probes=4, rounds=10)
    c = ivf.train(p, config)
    stored = ivf.assign(p, c)
    assert stored.count() == 1500 and stored.filter("list_id < 0").count() == 0
    q = p.filter("id % 20 = 0").select(F.col("id").alias("qid"), "vector")
    found, truth = ivf.search(stored, c, q, 10, config), vectors.knn_batch(p, q, 10)
    assert vectors.recall(found, truth).agg(F.avg("recall")).first()[0] >= 0.9
    assert planner.search(p, q, 10, config, c, rows=100_000).count() == found.count()


def test_pruned_by_list(spark, tmp_path):
    from quarryset.sources.tables import save_lists

    p = points(spark, np.eye(8))
    c = points(spark, np.eye(8)[:4]).select(F.col("id").cast("int").alias("list_id"), F.col("vector").cast("array<double>").alias("centroid"))
    save_lists(ivf.assign(p, c), str(tmp_path / "l"))
    q = p.filter("id = 1").select(F.col("id").alias("qid"), "vector")
    got = ivf.search(spark.read.parquet(str(tmp_path / "l")), c, q, 1, ivf.IvfConfig(probes=1))
    assert got.first().id == 1


def test_codecs(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8))
    p = points(spark, x).cache()
    r = quantize.sq8_train(p)
    back = np.array([v.decoded for v in quantize.sq8_decode(quantize.sq8_encode(p, r), r).orderBy("id").collect()])
    assert np.abs(back - x).max() <= (x.max(0) - x.min(0)).max() / 254
    book = quantize.pq_train(p, 2, 16, 8, rounds=3)
    coded = quantize.pq_assign(p, book, 2, 8)
    q = [float(v) for v in x[0]]
    by_table = quantize.pq_search(coded, quantize.pq_table(book, q, 2), 200).collect()
    centroid = {(b["sub"], b["code"]): np.array(b["centroid"]) for b in book.collect()}
    codes = {c.id: c.codes for c in coded.collect()}
    for row in by_table[:20]:
        direct = sum(((x[0].astype(np.float32)[s * 4 : s * 4 + 4] - centroid[s, codes[row.id][s]]) ** 2).sum() for s in range(2))
        assert abs(direct - row.score) < 1e-5


def test_maxsim_unit_example(spark):
    docs = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, 0.0]), (1, 1, [0.0, 1.0, 0.0, 0.0])], "doc_id long, patch_no int, vector array<float>")
    tokens = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "token int, vector array<float>")
    assert maxsim.maxsim(docs, tokens).first().score == 1.0
    assert abs(maxsim.maxsim(maxsim.decode(quantize.sq8_blocks(docs)), tokens).first().score - 1.0) < 0.01


def test_distances(spark):
    d = spark.range(1).select(distance.l2([0.0, 3.0], [4.0, 0.0]).alias("l2"), distance.dot([1.0, 2.0], [3.0, 4.0]).alias("dot"), distance.from_text(F.lit("1, 2.5,3")).alias("v")).first()
    assert (d.l2, d.dot, d.v) == (5.0, 11.0, [1.0, 2.5, 3.0])


def test_full_text(spark):
    docs = spark.createDataFrame([(1, "Red fox, red hen", "en"), (2, "The blue fox", "en"), (3, None, "de"), (4, "", None)], "id int, body string, lang string")
    index = fulltext.inverted(docs, "id", ["body"], ["lang"])
    ids = lambda **kw: sorted(r.doc_id for r in fulltext.search(index, **kw).collect())
    assert ids(must=["fox"]) == [1, 2]
    assert ids(must=["fox"], must_not=["red"]) == [2]
    assert ids(must=["lang:de"]) == [3]
    n = spark.createDataFrame([(4,)], "n int")
    assert fulltext.tfidf(index, n, ["red", "fox"], 5).first().doc_id == 1
    syn = spark.createDataFrame([("fox", 1), ("vixen", 1), ("hen", 2)], "term string, group_id int")
    assert sorted(r.term for r in fulltext.with_synonyms(spark.createDataFrame([("fox",)], "term string"), syn).collect()) == ["fox", "vixen"]


def test_trained_lists_recall(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=16) * 0.2]) for i in range(600)]
    p = spark.createDataFrame(rows, "id bigint, vector array<float>")
    queries = p.filter("id % 20 = 0").withColumnRenamed("id", "qid")
    truth = vectors.knn_batch(p, queries, 5)
    for codec in ("flat", "sq8", "pq"):
        config = ivf.IvfConfig(lists=12, probes=3, rounds=8, codec=codec)
        centroids = ivf.train(p, config)
        stored, decoder = ivf.encode(ivf.assign(p, centroids).select("id", "vector", "list_id"), config, 16, 4, 5)
        found = ivf.search(stored, centroids, queries, 5, config, decoder, oversample=12)
        assert vectors.recall(found, truth).agg({"recall": "avg"}).first()[0] >= 0.9, codec


def test_lists_of_unusable_vectors(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, []), (4, [1.0])], "id bigint, vector array<float>")
    c = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0])], "list_id int, centroid array<double>")
    assert {r.id: r.list_id for r in ivf.assign(p, c).collect()} == {1: 1, 2: -1, 3: -1, 4: -1}
    assert ivf.assign(p, c.limit(0)).filter("list_id <> -1").count() == 0


def test_query_texts():
    assert fulltext.parse("Red a|b -x @f:{T}") == (["red", "f:T"], ["a", "b"], ["x"])
    assert fulltext.parse("*") == ([], [], [])


def test_monitor_quotes(spark):
    ops = spark.createDataFrame([(1500, 2, ["SET", 'a"b', "c\\d"]), (1, 0, [])], "ts_ms bigint, db int, argv array<string>")
    assert [r.line for r in pubsub.monitor(ops).collect()] == ['1.500000 [2] "SET" "a\\"b" "c\\\\d"']


def test_running_values_of_a_hot_key_spread(spark):
    rows = spark.createDataFrame([("hot" if i % 10 else None if i % 20 else "cold", i, (i * 7) % 13 - 6) for i in range(2000)], "key string, seq int, x bigint")
    for op, exclusive in (("sum", False), ("sum", True), ("max", False), ("max", True)):
        got = {(r.key, r.seq): r.y for r in accumulated(rows, "key", ["seq"], "x", "y", op=op, exclusive=exclusive).collect()}
        seen = {}
        for r in sorted(rows.collect(), key=lambda r: r.seq):
            before = seen.get(r.key)
            after = (before or 0) + r.x if op == "sum" else r.x if before is None else max(before, r.x)
            assert got[r.key, r.seq] == ((before if before is not None else 0 if op == "sum" else None) if exclusive else after)
            seen[r.key] = after
    parts = accumulated(rows, "key", ["seq"], None, "n", "of")
    assert parts.filter("key = 'hot'").agg({"n": "max", "of": "max"}).first()[0] == 1800
    assert accumulated(rows.limit(0), "key", ["seq"], "x", "y").count() == 0
