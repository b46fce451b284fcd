import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryset.llm import p1_clusters, p2_neighbours, p4_subset, p5_history
from quarryset.llm.vectors import best, pack, point_vectors, top_k, unpack
from quarryset.runtime import Scratch
from tests.llm.data import DIRT, groups, tables


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.floats(-1e6, 1e6, width=32), min_size=5, max_size=5), min_size=1, max_size=20), st.integers(0, 6))
def test_packing_is_exact(rows, digits):
    x = np.round(np.array(rows, np.float32), digits).astype(np.float32)
    assert np.array_equal(unpack(pack(x)), x)
    both = np.concatenate([x, np.full((1, 5), 0.25, np.float32)])
    assert np.array_equal(unpack(pa.chunked_array([pack(both), pack(x)])), np.concatenate([both, x]))


def test_top_k_keeps_all_that_is_largest():
    rng = np.random.default_rng(0)
    s = np.round(rng.normal(size=(50, 700)), 1).astype(np.float32)
    r, c = top_k(s, 5)
    cos = np.round(s[r, c].astype(float) / 10, 6)
    rr, cc, _ = best(r, c, cos, c, 50, 5)
    for i in range(50):
        want = sorted(range(700), key=lambda j: (-s[i, j], j))[:5]
        assert list(cc[rr == i]) == want


def test_only_usable_vectors(spark):
    p, c = tables(spark, [*DIRT, ("a", 1, [1.0] * 8), ("a", 1, [1.0] * 8), ("b", 2, [1, 0, 0, 0])])
    assert sorted((r.space, r.id) for r in point_vectors(p, c).distinct().collect()) == [("a", 1), ("b", 2)]


def found_groups(spark, points):
    p, c = tables(spark, points)
    out = {}
    for r in p1_clusters.cluster(point_vectors(p, c)).collect():
        out.setdefault((r.space, r.group_id), set()).add(r.id)
    return out


def test_clusters(spark):
    rng = np.random.default_rng(4)
    data = groups(rng, [60, 12, 5, 4])
    rows = [("a", u, v) for u, v, _ in data]
    rows += rows[:7] + DIRT  # repeats count once
    rows += [("b", 500 + i, [1, 0, 0, 0]) for i in range(6)]  # copies are a group
    want = {}
    for u, _, g in data:
        want.setdefault(g, set()).add(u)
    got = found_groups(spark, rows)
    assert sorted(map(sorted, got.values())) == sorted([sorted(want[0]), sorted(want[1]), sorted(want[2]), list(range(500, 506))])
    assert all(gid == min(m) for (_, gid), m in got.items())


def test_no_clusters(spark):
    assert found_groups(spark, []) == {}
    assert found_groups(spark, DIRT) == {}


def test_typical_members(spark):
    m = spark.createDataFrame([("s", i, 0, 0.9 + i / 100) for i in range(7)], "space string, id bigint, group_id bigint, cosine double")
    r = p1_clusters.describe(m, 2).first()
    assert (r["size"], r.typical) == (7, [6, 5])


def test_hashed_features_keep_dense_vectors():
    x = np.arange(12, dtype=np.float32).reshape(2, 6)
    assert np.array_equal(p1_clusters.hashed_features([str(i) for i in range(6)], x, 6), x)
    assert abs(p1_clusters.hashed_features(["word"], np.ones((1, 1), np.float32), 4)).sum() == 1


def brute(points, k):
    rows = {(c, u): np.array(v, np.float32).astype(float) for c, u, v in points}
    out = {}
    for (c, u), v in rows.items():
        near = []
        for (d, w), x in rows.items():
            if c == d and w != u:
                near.append((-round(float(v @ x / np.linalg.norm(v) / np.linalg.norm(x)), 6), w))
        out[c, u] = [(w, -s) for s, w in sorted(near)[:k]]
    return out


def test_neighbours_with_copies_and_ties(spark):
    rng = np.random.default_rng(7)
    pts = [("a", i, np.round(rng.normal(size=8), 4)) for i in range(150)]
    pts += [("a", 200 + i, pts[3][2]) for i in range(14)]  # more copies than neighbours
    pts += [("b", 1000 + i, np.round(rng.normal(size=4), 4)) for i in range(3)]
    p, c = tables(spark, pts + DIRT + pts[:5])
    graph, nodes, members = p2_neighbours.build(point_vectors(p, c), Scratch(spark, "t"))
    got = {}
    for r in p2_neighbours.neighbours(graph, members, 8).distinct().collect():
        got.setdefault((r.space, r.id), []).append((-r.cosine, r.nbr))
    want = brute(pts, 8)
    for key, near in want.items():
        assert [(w, -s) for s, w in sorted(got.get(key, []))] == near, key


def test_graph_of_many_cells_and_search(spark, monkeypatch):
    rng = np.random.default_rng(8)
    pts = [("a", u, v) for u, v, _ in groups(rng, [700, 300, 40], noise=0.3)]
    monkeypatch.setattr(p2_neighbours, "CELL", 100)
    monkeypatch.setattr(p2_neighbours, "FINE", 20)
    p, c = tables(spark, pts)
    scratch = Scratch(spark, "t")
    vecs = scratch.write(point_vectors(p, c), "v")
    graph, nodes, members = p2_neighbours.build(vecs, scratch)
    got = {}
    for r in p2_neighbours.neighbours(graph, members, 8).collect():
        got.setdefault(r.id, set()).add(r.nbr)
    want = brute(pts, 8)
    recall = np.mean([len(got[u] & {w for w, _ in near}) / 8 for (_, u), near in want.items()])
    assert recall >= 0.9
    queries = vecs.filter("id % 20 = 0").selectExpr("space", "id as qid", "vec")
    found = {}
    for r in p2_neighbours.search(graph, vecs, queries, scratch, 8).collect():
        found.setdefault(r.qid, set()).add(r.id)
    assert np.mean([len(found[u] & {w for w, _ in want["a", u]}) / 8 for u in found]) >= 0.9


def test_registered_search_finds_copies_as_brute_force_does(spark, tmp_path):
    import __spark_entry__

    rng = np.random.default_rng(9)
    pts = [("a", i, np.round(rng.normal(size=8), 4)) for i in range(150)]
    pts += [("a", 200 + i, pts[3][2]) for i in range(14)]  # a query among more copies than are asked for
    pts += [("a", 300 + i, pts[20][2]) for i in range(3)] + [("a", 340, pts[7][2])]
    pts += [("b", 1000 + i, np.round(rng.normal(size=4), 4)) for i in range(3)]
    p, c = tables(spark, pts + DIRT + pts[:5])
    p.write.parquet(f"{tmp_path}/points.parquet")
    c.write.parquet(f"{tmp_path}/collections.parquet")
    got = {}
    for r in __spark_entry__.queries()["p2_search"](spark, str(tmp_path)).collect():
        got.setdefault((r.collection, r.qid), []).append((-r.cosine, r.uid))
    want = {q: near for q, near in brute(pts, 8).items() if q[1] % 20 == 0}
    assert {q: [(u, -s) for s, u in sorted(near)] for q, near in got.items()} == want


def test_empty_graph(spark):
    p, c = tables(spark, DIRT)
    graph, nodes, members = p2_neighbours.build(point_vectors(p, c), Scratch(spark, "t"))
    assert p2_neighbours.neighbours(graph, members, 8).count() == 0


def test_subset_covers_small_groups(spark):
    rng = np.random.default_rng(5)
    data = groups(rng, [400, 40, 6, 5])
    kind = {u: g for u, _, g in data}
    p, c = tables(spark, [("a", u, v) for u, v, _ in data] + DIRT)
    ids = p.selectExpr("collection as space", "uid as id", "payload")
    got = p4_subset.subset(ids, point_vectors(p, c), Scratch(spark, "t"), 8).collect()
    assert len({r.id for r in got}) == 8
    assert {kind[r.id] for r in got} == {0, 1, 2, 3}
    assert p4_subset.subset(ids, point_vectors(p, c), Scratch(spark, "t"), 10_000).count() == len(data)
    assert p4_subset.subset(ids.limit(0), point_vectors(p.limit(0), c), Scratch(spark, "t")).count() == 0


def test_payload_features():
    f = p4_subset.payload_features
    assert f(None) == ["none"] and f("{") == ["broken"] and f("[1]") == ["none"]
    assert f('{"lang": " DE "}') == f('{"lang": "de"}')
    assert f('{"a": {"b": ["x", 1]}}') == [".a.b:int", ".a.b=x", ".a.b[]"]


def test_farthest_first_on_repeats():
    x = np.eye(4, dtype=np.float32)[[0, 0, 0, 1]]
    picks, _ = p4_subset.farthest_first(x, np.array([3, 3, 3, 1]), 4)
    assert sorted(picks) == [0, 1, 2, 3] and list(picks[:2]) == [0, 3]


@pytest.mark.parametrize("bucket", [8000, 10])
def test_history_one_request_and_batches_agree_with_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(p5_history, "BUCKET", bucket)
    rng = np.random.default_rng(6)
    base = np.round(rng.normal(size=(120, 8)), 4)
    old = [("a", -1, v) for v in base[:80]] + [("a", -1, base[0])] * 30
    new = []
    for i in range(60):
        v = base[rng.integers(0, 120)] + (rng.normal(size=8) * rng.choice([0, 0.03, 0.2]))
        new.append(("a", i, np.round(v * rng.choice([1, 3]), 4)))
    new += [("a", 60 + i, new[i][2]) for i in range(10)] + [("b", 80, [1, 0, 0, 0]), ("b", 81, [2, 0, 0, 0])]
    p, c = tables(spark, old + DIRT)
    u, _ = tables(spark, new + [("a", 85, None)])
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    want = set()
    for space, seq, v in new:
        earlier = [x for s, q, x in old if s == space] + [x for s, q, x in new if s == space and q < seq]
        if any(unit(v) @ unit(x) >= 0.99 for x in earlier):
            want.add(seq)
    scratch = Scratch(spark, "t")
    hist, batch = point_vectors(p, c), point_vectors(u, c)
    one = p5_history.PivotHistory.begin(hist, scratch)
    one.append(hist)
    assert {r.id for r in one.repeats(batch).collect()} == want
    step = p5_history.PivotHistory.begin(hist, scratch)
    step.append(hist)
    got = set()
    for lo in range(0, 90, 30):
        part = batch.filter(f"id >= {lo} and id < {lo + 30}")
        got |= {r.id for r in step.repeats(part).collect()}
        step.append(part)
        step.compact()
    assert got == want


def test_parts_of_any_cell_are_bounded():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    x[:1000] = x[0]  # one direction can't be told apart
    x /= np.linalg.norm(x, axis=1)[:, None]
    part = p2_neighbours._split(x, np.arange(3000), 100)
    assert np.bincount(part).max() <= 200 and len(part) == 3000


def test_a_batch_reads_only_the_ranges_it_can_match(spark, monkeypatch):
    monkeypatch.setattr(p5_history, "PER_PIVOT", 100)
    rng = np.random.default_rng(2)
    data = [("a", i, np.round(rng.normal(size=8), 4)) for i in range(3000)]
    p, c = tables(spark, data)
    u, _ = tables(spark, [("a", 5000, data[7][2]), ("a", 5001, np.round(rng.normal(size=8), 4))])
    h = p5_history.PivotHistory.begin(point_vectors(p, c), Scratch(spark, "t"))
    h.append(point_vectors(p, c))
    visits = h.scratch.write(h.visits(point_vectors(u, c)), "visits")
    left = h.reached(visits)
    plan = left._jdf.queryExecution().explainString(left._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert "pivot" in pushed and "theta" in pushed
    assert left.count() < 1500
    assert {r.id for r in h.repeats(point_vectors(u, c)).collect()} >= {5000}


def test_history_may_be_empty(spark):
    p, c = tables(spark, [])
    u, _ = tables(spark, [("a", 1, [1.0] * 8), ("a", 2, [1.0] * 8)])
    h = p5_history.PivotHistory.begin(point_vectors(p, c), Scratch(spark, "t"))
    assert [r.id for r in h.repeats(point_vectors(u, c)).collect()] == [2]
