"""The adaptive octree and the joins and clusters built on it, against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointmill.operators import graph, octree, spatial

RNG = np.random.default_rng(11)
CLOUDS = {
    "uniform": RNG.random((400, 3)),
    "dense corner": np.concatenate([RNG.random((200, 3)), 0.5 + 1e-4 * RNG.random((200, 3))]),
    "one place": np.concatenate([np.tile([[0.25, 0.5, 0.75]], (120, 1)), RNG.random((40, 3))]),
    "far outlier": np.concatenate([RNG.random((150, 3)), [[1e6, -5.0, 0.0]]]),
    "line": np.column_stack([np.linspace(0, 1, 200), np.zeros(200), np.zeros(200)]),
    "few": RNG.random((3, 3)),
    "single": np.zeros((1, 3)),
}


def frame(spark, a):
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(a)), "x": a[:, 0], "y": a[:, 1], "z": a[:, 2]})).repartition(3)


def squares(a, b):
    d = a[:, None, :] - b[None, :, :]
    return d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2


@pytest.mark.parametrize("name", CLOUDS)
def test_leaves_split_until_they_hold_few(spark, name):
    a = CLOUDS[name]
    held, root = octree.leaves(frame(spark, a), capacity=10)
    rows = held.collect()
    assert sorted(r["id"] for r in rows) == list(range(len(a)))
    sizes, inside = {}, {}
    for r in rows:
        key = (r["level"], r["ix"], r["iy"], r["iz"])
        sizes[key] = sizes.get(key, 0) + 1
        w = root.side / 2 ** r["level"]
        assert all(o + i * w - 1e-6 <= v <= o + (i + 1) * w + 1e-6 for o, i, v in zip((root.x, root.y, root.z), key[1:], (r["x"], r["y"], r["z"]), strict=True))
        for up in range(r["level"]):
            above = (up, *(i >> (r["level"] - up) for i in key[1:]))
            inside[above] = inside.get(above, 0) + 1
    assert all(n <= 10 or key[0] == octree.DEPTH for key, n in sizes.items())
    # A cell was split only because it held too many, and no leaf lies in another one.
    assert all(n > 10 for n in inside.values()) and not set(sizes) & set(inside)


@pytest.mark.parametrize("name,apart", [*((n, False) for n in CLOUDS), ("one place", True)])
def test_nearest_points(spark, name, apart):
    a = CLOUDS[name]
    k = 4
    got = {}
    for r in spatial.knn(frame(spark, a), frame(spark, a), k, exclude_coincident=apart).collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    d = squares(a, a)
    for i in range(len(a)):
        ids = [j for j in np.lexsort((np.arange(len(a)), d[i])) if j != i and (d[i, j] > 0 or not apart)][:k]
        assert [j for _, j in sorted(got.get(i, []))] == ids


def test_nearest_with_a_number_for_each_query(spark):
    a = CLOUDS["dense corner"]
    queries = frame(spark, a).withColumn("k", (F.col("id") % 7 * 9).cast("int"))
    got = {}
    for r in spatial.knn(queries, frame(spark, a), "k").collect():
        got.setdefault(r["src"], []).append((r["rank"], r["dst"]))
    d = squares(a, a)
    for i in range(len(a)):
        order = [j for j in np.lexsort((np.arange(len(a)), d[i])) if j != i][: i % 7 * 9]
        assert [j for _, j in sorted(got.get(i, []))] == order


def test_queries_outside_and_invalid_points(spark):
    a, q = CLOUDS["uniform"], 7 + CLOUDS["few"]
    odd = spark.createDataFrame([(900, float("nan"), 0.0, 0.0), (901, None, 0.0, 0.0)], "id long, x double, y double, z double")
    got = spatial.knn(frame(spark, q).union(odd), frame(spark, a).union(odd), 2).collect()
    d = squares(q, a)
    want = {(i, int(j), n + 1) for i in range(len(q)) for n, j in enumerate([j for j in np.argsort(d[i]) if j != i][:2])}
    assert {(r["src"], r["dst"], r["rank"]) for r in got} == want
    empty = frame(spark, a).limit(0)
    assert spatial.knn(empty, frame(spark, a), 2).collect() == [] and spatial.knn(frame(spark, q), empty, 2).collect() == []


@pytest.mark.parametrize("name,radius,capacity", [("dense corner", 0.1, 16), ("dense corner", 0.00003, 16), ("one place", 0.5, 30), ("uniform", 0.5, 10**9), ("far outlier", 0.3, 20)])
def test_points_within_a_radius(spark, name, radius, capacity):
    a = CLOUDS[name]
    got = {(r["src"], r["dst"]) for r in spatial.radius_join(frame(spark, a), frame(spark, a), radius, capacity=capacity).collect()}
    d = squares(a, a)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(d < radius * radius)), strict=True))


def test_a_dense_cell_is_dealt_over_leaves(spark):
    """Half of the points in one cell of the radius: no key of the join holds more than the capacity, and each query goes only to leaves it can reach."""
    a = np.concatenate([RNG.random((1000, 3)) * 100, RNG.random((1000, 3)) * 0.99])
    p = frame(spark, a)
    coded = octree.deepest(p.withColumn("cell", F.lit(0)).where("id >= 1000"), (0.0, 0.0, 0.0), 1.0)
    held = octree.with_leaf(coded, octree.full_cells(coded, 50, "cell"), "cell").groupBy("level", *octree.CELL).count().collect()
    assert max(r["count"] for r in held) <= 50 and len(held) > 20
    got = spatial.radius_join(p, p, 1.0, capacity=50).groupBy("src").count().collect()
    want = (squares(a, a) < 1.0).sum(axis=1)
    assert {r["src"]: r["count"] for r in got} == {i: n for i, n in enumerate(want.tolist())}


@pytest.mark.parametrize("name,eps", [("uniform", 0.05), ("uniform", 0.11), ("dense corner", 0.04), ("one place", 0.0), ("line", 0.0051), ("far outlier", 3.0), ("single", 0.1)])
def test_dbscan_is_the_components_within_eps(spark, name, eps):
    a = CLOUDS[name]
    got = {r["node"]: r["component"] for r in graph.dbscan(frame(spark, a), eps=eps).collect()}
    up = list(range(len(a)))
    linked = squares(a, a) <= eps * eps
    changed = True
    while changed:
        new = [min(up[j] for j in np.flatnonzero(linked[i])) for i in range(len(a))]
        changed, up = new != up, new
    assert got == dict(enumerate(map(int, up)))


def test_near_cells_reads_points_not_pairs(spark, monkeypatch):
    """A cloud within eps: what is written grows with the points."""
    rows = []
    original = graph.materialize

    def counted(df, name):
        out = original(df, name)
        if name == "near":
            rows.append(out.count())
        return out

    monkeypatch.setattr(graph, "materialize", counted)
    a = RNG.random((3000, 3)) * 0.5
    found = graph.dbscan(frame(spark, a), eps=1.0)
    assert {r["component"] for r in found.collect()} == {0}
    assert sum(rows) <= 40 * len(a)


def test_cluster_tree_raises_on_a_cycle(spark):
    members = spark.createDataFrame([(i, 0, 0) for i in range(3)], "cell long, level int, component long")
    way = spark.createDataFrame([(0, 0.0, 1), (1, 1.0, 2), (2, 2.0, 0)], "node long, dist double, pred long")
    with pytest.raises(ValueError, match="cycle"):
        graph.cluster_tree(members, way)
    chain = spark.createDataFrame([(0, 0.0, None), *[(i, float(i), i - 1) for i in range(1, 50)]], "node long, dist double, pred long")
    parts = spark.createDataFrame([(i, i // 10, i // 10 * 10) for i in range(50)], "cell long, level int, component long")
    assert sorted(map(tuple, graph.cluster_tree(parts, chain).collect())) == [(0, 0, 0), *[(c, c // 10, c - 10) for c in range(10, 50, 10)]]
