"""Neighbour descent, fuzzy weights and the layout against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.operators import manifold as N


def exact(rows, k):
    d = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k], d


def kept(rows, places, k=10):
    a, b = exact(rows, k)[0], exact(places, k)[0]
    return float(np.mean([len(set(x) & set(y)) / k for x, y in zip(a, b, strict=True)]))


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 32)) * 3
    return np.vstack([c + r.normal(size=(50, 32)) * r.uniform(0.5, 1.5) for c in centres])


def frame(spark, rows):
    return spark.createDataFrame([(i, x) for i, x in enumerate(rows.tolist())], "id long, v array<double>")


def test_recall(spark, planted, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    for rows in (planted, np.array([r.embedding for r in table], float)):
        near, d = exact(rows, 15)
        found = N.neighbour_graph(frame(spark, rows)).collect()
        assert len(found) == len({(r.id, r.neighbour) for r in found}) == 15 * len(rows)
        assert all(abs(r.distance - d[r.id, r.neighbour]) < 1e-9 for r in found)
        assert len({(i, j) for i, x in enumerate(near.tolist()) for j in x} & {(r.id, r.neighbour) for r in found}) >= 0.95 * near.size


def test_popular_point(spark):
    """A hub that is everybody's neighbour meets no more than 2k others in a round, and all edges stay."""
    r = np.random.default_rng(2)
    rows = r.normal(size=(300, 40))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[0] = 0
    found = N.neighbour_graph(frame(spark, rows), k=5).collect()
    assert sum(x.neighbour == 0 for x in found) > 290 and len(found) == 1500


def test_weights(spark):
    edges = [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 4.0), (1, 0, 1.0), (1, 2, 1.5), (1, 3, 3.0), (2, 1, 1.5), (2, 0, 2.0), (2, 3, 2.0), (3, 2, 2.0), (3, 1, 3.0), (3, 0, 4.0)]
    made = {(r.a, r.b): r.weight for r in N.fuzzy_weights(spark.createDataFrame(edges, "id long, neighbour long, distance double")).collect()}
    p = {}
    for i in range(4):
        own = [(b, d) for a, b, d in edges if a == i]
        least = min(d for _, d in own)
        low, high = 1e-6, 100.0
        for _ in range(200):
            s = (low + high) / 2
            low, high = (low, s) if sum(math.exp(-(d - least) / s) for _, d in own) > math.log2(3) else (s, high)
        p |= {(i, b): math.exp(-(d - least) / s) for b, d in own}
    assert made.keys() == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    assert all(abs(w - (p[a, b] + p[b, a] - p[a, b] * p[b, a])) < 1e-9 for (a, b), w in made.items())


def test_preserves_more_than_components(spark, planted):
    rows = frame(spark, planted)
    made = {r.id: (r.x0, r.x1) for r in N.reduce(rows, id_col="id", vector_col="v").collect()}
    centred = planted - planted.mean(0)
    flat = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert kept(planted, np.array([made[i] for i in range(len(planted))])) > kept(planted, flat) + 0.05


def test_copies_nulls_and_few(spark):
    kind = "k string, e array<float>"
    r = np.random.default_rng(3)
    rows = [(f"a{i:02d}", x) for i, x in enumerate(r.normal(size=(30, 4)).tolist())]
    rows += [(f"b{i:02d}", rows[0][1]) for i in range(40)] + [("n", None), rows[5], ("a06", [9.0, 9.0, 9.0, 9.0])]
    made = {x.k: (x.x0, x.x1) for x in N.reduce(spark.createDataFrame(rows, kind), id_col="k", vector_col="e", rounds=3).collect()}
    assert made.keys() == {k for k, v in rows if v} and len({made["a00"]} | {made[f"b{i:02d}"] for i in range(40)}) == 1
    assert N.reduce(spark.createDataFrame([], kind), id_col="k", vector_col="e").collect() == []
    one = N.reduce(spark.createDataFrame([("p", [1.0]), ("q", [1.0])], kind), id_col="k", vector_col="e").orderBy("k").collect()
    assert [tuple(x) for x in one] == [("p", 0.0, 0.0), ("q", 0.0, 0.0)]
    plan = N.neighbour_graph(spark.createDataFrame([("p", [1.0])], "id string, v array<double>"))
    assert plan.where(F.col("id").isNotNull()).count() == 0
