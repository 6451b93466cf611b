"""Operators on shapes with known answers, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointmill.functions import geom
from pointmill.operators import contract, fit, graph, sample, skeleton, spatial, stats, surface
from pointmill.plans import pipelines


def cloud(spark, p):
    return spark.createDataFrame([(int(i), float(x), float(y), float(z)) for i, (x, y, z) in enumerate(p)], "id long, x double, y double, z double")


def test_point_plane_distances(spark):
    rows = [(1.0, 1.0, 1.0, -1.0, 1.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, -1.0, 0.0, 1.0, 0.0, 0.0), (1.0, 1.0, 1.0, -1.0, 0.0, 0.0, 0.0, math.sqrt(3) / 3), (1.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, x double, y double, z double, want double")
    got = df.select(geom.distance_to_plane(geom.vec("x", "y", "z"), F.struct("a", "b", "c", "d")).alias("g"), "want").collect()
    assert all(abs(r["g"] - r["want"]) < 1e-6 for r in got)


def brute_knn(p, k):
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i in range(len(p)) for j in np.lexsort((np.arange(len(p)), d[i]))[:k]}


@pytest.mark.parametrize("shape", ["uniform", "clustered", "line", "doubled"])
def test_knn_is_exact(spark, shape):
    rng = np.random.default_rng(3)
    p = {"uniform": rng.normal(size=(150, 3)), "clustered": np.r_[rng.normal(size=(100, 3)) * 0.01, rng.normal(size=(10, 3)) * 50], "line": np.c_[np.arange(60.0), np.zeros((60, 2))], "doubled": np.repeat(rng.integers(0, 3, size=(20, 3)).astype(float), 4, axis=0)}[shape]
    pts = cloud(spark, p)
    assert {(r["src"], r["dst"]) for r in spatial.knn(pts, pts, 4).collect()} == brute_knn(p, 4)


def test_knn_with_too_few_points(spark):
    pts = cloud(spark, [(0, 0, 0), (1, 0, 0)])
    assert {(r["src"], r["dst"]) for r in spatial.knn(pts, pts, 5).collect()} == {(0, 1), (1, 0)}
    assert spatial.knn(cloud(spark, [(0, 0, 0)]).where("id > 5"), pts, 2).count() == 0


def test_radius_join_plan_has_no_nested_loop(spark):
    pts = cloud(spark, np.random.default_rng(1).normal(size=(50, 3)))
    plan = spatial.radius_join(pts, pts, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_linearity_of_a_line_and_of_nothing(spark):
    p = np.c_[np.linspace(0, 1, 20), np.zeros((20, 2))]
    pts = cloud(spark, p)
    rows = stats.linearity(spatial.radius_join(pts, pts, 0.3), pts).collect()
    assert all(abs(r["sigma"] - 1) < 1e-9 and abs(abs(r["dx"]) - 1) < 1e-9 for r in rows)
    one = cloud(spark, [(1, 2, 3)])
    r = stats.linearity(spatial.radius_join(one, one, 0.3), one).first()
    assert r["sigma"] == 0.5 and r["dx"] is None


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(5)
    p = rng.normal(size=(40, 3)) * [3, 2, 1]
    pts = cloud(spark, p)
    e = spark.createDataFrame([(0, i) for i in range(40)], "src long, dst long")
    r = stats.linearity(e, pts, mode="pca").first()
    q = p - p[0]
    lam, vec = np.linalg.eigh(np.cov(q.T, bias=True))
    assert abs(r["sigma"] - lam[-1] / lam.sum()) < 1e-9
    assert abs(abs(np.dot([r["dx"], r["dy"], r["dz"]], vec[:, -1])) - 1) < 1e-6


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    e = spark.createDataFrame(path + star, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert {got[i] for i in range(301)} == {0} and {got[1000 + i] for i in range(200)} == {1000}


def test_shortest_paths_and_levels(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 5.0), (3, 4, 1.0)], "src long, dst long, weight double")
    d = graph.shortest_paths(e.union(e.select("dst", "src", "weight")), 0)
    assert {r["node"]: r["dist"] for r in d.collect()} == {0: 0.0, 1: 1.0, 2: 2.0}
    assert {r["node"]: r["level"] for r in graph.level_sets(d, 3).collect()} == {0: 0, 1: 1, 2: 2}


def test_medians_and_fits(spark):
    p = [(0, 0, 0), (4, 0, 0), (0, 4, 0), (4, 4, 0), (2, 2, 0)]
    g = cloud(spark, p).withColumn("g", F.lit(1))
    m = fit.l1_median(g, "g").first()
    assert abs(m["x"] - 2) < 1e-6 and abs(m["y"] - 2) < 1e-6
    t = np.linspace(0, 1.5, 30)
    c = cloud(spark, np.c_[3 + 2 * np.cos(t), 1 + 2 * np.sin(t), 0 * t]).withColumn("g", F.lit(1))
    r = fit.circle_fit(c, "g").first()
    assert abs(r["cx"] - 3) < 1e-6 and abs(r["cy"] - 1) < 1e-6 and abs(r["r"] - 2) < 1e-6
    assert fit.plane_fit(cloud(spark, [(1, 1, 1), (1, 1, 1)]).withColumn("g", F.lit(1)), "g").first()["a"] is None


def test_octree_of_negative_points(spark):
    p = cloud(spark, [(-1, -1, -1), (-2, -2, -2), (-2, -2, -2.0001)])
    assert sorted(r["n"] for r in sample.octree_downsample(p, depth=3).collect()) == [1, 2]


def test_empty_cloud(spark):
    none = cloud(spark, [(0, 0, 0)]).where("id > 0")
    assert sample.grid_downsample(none, cell_size=1.0).count() == 0
    assert sample.octree_downsample(none).count() == 0
    assert spatial.radius_join(none, none, 1.0).count() == 0
    assert graph.dbscan(none).count() == 0


def test_contraction_stays_inside_and_grows_linear(spark):
    rng = np.random.default_rng(2)
    t = rng.uniform(0, 10, 120)
    a = rng.uniform(0, 2 * math.pi, 120)
    pts = cloud(spark, np.c_[t, 0.5 * np.cos(a), 0.5 * np.sin(a)])
    seen = []
    out = contract.contract(pts, contract.ContractionParams(max_iterations=3), lambda i, s: seen.append(s["mean_sigma"])).collect()
    assert len(out) == 120 and max(math.hypot(r["y"], r["z"]) for r in out) <= 0.5 + 1e-9
    assert seen == sorted(seen) and len(seen) >= 2


def test_parameters_are_checked():
    with pytest.raises(ValueError):
        contract.ContractionParams(stop_sigma=10)
    with pytest.raises(ValueError):
        pipelines.KnnContractionParams(sample_num=1)
    a, b = pipelines.KnnContractionParams(), pipelines.KnnContractionParams(iter_num=11)
    assert pipelines.cache_key("x", a) == pipelines.cache_key("x", pipelines.KnnContractionParams()) != pipelines.cache_key("x", b)


def test_trace_follows_a_line(spark):
    n = 60
    rows = [(i, i / 10, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0) for i in range(n)]
    state = spark.createDataFrame(rows, "id long, x double, y double, z double, sigma double, dx double, dy double, dz double")
    b = skeleton.trace_branches(state, skeleton.ConnectionParams(diagonal_count=10)).collect()
    assert {r["branch"] for r in b} == {0}
    ids = [r["id"] for r in sorted(b, key=lambda r: r["step"])]
    assert ids == sorted(ids) or ids == sorted(ids, reverse=True)


def test_repair_joins_everything(spark):
    nodes = cloud(spark, [(0, 0, 0), (1, 0, 0), (1.5, 0, 0), (5, 0, 0), (6, 0, 0), (20, 0, 0)])
    e = spark.createDataFrame([(0, 1), (1, 2), (3, 4)], "a long, b long")
    assert sorted((r["a"], r["b"]) for r in skeleton.repair(nodes, e).collect()) == [(2, 3), (4, 5)]


def test_tube_surface_counts(spark):
    t = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (1, 0, 0.0, 0.0, 1.0), (2, 1, 0.0, 0.0, 2.0), (3, 1, 1.0, 0.0, 2.0)], "node long, parent long, x double, y double, z double")
    rings = surface.circles(t, surface.branch_radii(t))
    assert rings.count() == 3 * 12
    assert surface.triangles(t, rings).count() == 2 * 12 * 2
    assert {r["node"]: (r["depth"], r["size"], r["height"]) for r in surface.tree_measures(t).collect()} == {0: (0, 4, 2), 1: (1, 3, 1), 2: (2, 1, 0), 3: (2, 1, 0)}


def test_parents_in_a_cycle_raise(spark):
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node long, parent long")
    for walk in (graph.tree_depths, graph.ancestors):
        with pytest.raises(ValueError):
            walk(ring).collect()
    line = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3)], "node long, parent long")
    assert graph.ancestors(line, 1).where("node = 4").count() == 2 and graph.ancestors(line).where("node = 4").count() == 4
