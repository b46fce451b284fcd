"""Small inputs with the kinds of dirt that the operators must take."""

import numpy as np

NAN = float("nan")
COLLECTIONS = [("a", 8), ("b", 4)]


def tables(spark, points, collections=COLLECTIONS):
    """(points, collections) from (collection, uid, vector) with a clashing extra column."""
    p = spark.createDataFrame([(c, str(u), u, None if v is None else [float(x) for x in v], "{}", "clash") for c, u, v in points], "collection string, id string, uid bigint, vector array<float>, payload string, name string")
    return p, spark.createDataFrame([(n, d, "cosine") for n, d in collections], "name string, dim int, metric string")


def groups(rng, sizes, dim=8, noise=0.08, start=0):
    """Points of tight groups around orthogonal directions, and their group."""
    out, uid = [], start
    axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    for g, n in enumerate(sizes):
        for _ in range(n):
            v = axes[g] + rng.normal(size=dim) * noise
            out.append((uid, np.round(v * rng.choice([1, 7, 0.1]), 5), g))
            uid += 1
    return out


DIRT = [("a", 900, None), ("a", 901, []), ("a", 902, [1.0] * 7), ("a", 903, [0.0] * 8), ("a", 904, [NAN] + [1.0] * 7), ("a", 905, [float("inf")] * 8), ("none", 906, [1.0] * 8), (None, 907, [1.0] * 8)]
