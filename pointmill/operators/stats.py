"""Local and grouped statistics of points ``id, x, y, z``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from . import nearby
from .spatial import knn


def bounding_box(points: DataFrame) -> DataFrame:
    """One row: least and greatest coordinates, centre, half extents, diagonal and number of points."""
    box = points.agg(*[f(a).alias(f"{m}_{a}") for a in "xyz" for m, f in (("min", F.min), ("max", F.max))], F.count("*").alias("n"))
    centre = {f"center_{a}": (F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz"}
    half = {f"half_{a}": (F.col(f"max_{a}") - F.col(f"min_{a}")) / 2 for a in "xyz"}
    box = box.withColumns(centre | half)
    return box.withColumn("diagonal", 2 * F.sqrt(F.col("half_x") * F.col("half_x") + F.col("half_y") * F.col("half_y") + F.col("half_z") * F.col("half_z")))


def normalize(points: DataFrame, *, enabled: bool = True) -> DataFrame:
    """Moved to the middle of the box and scaled by its greatest side, which is taken to be at least 1e-7."""
    if not enabled:
        return points
    b = bounding_box(points).first()
    if not b["n"]:
        return points
    side = max(1e-7, 2 * max(b["half_x"], b["half_y"], b["half_z"]))
    return points.withColumns({a: (F.col(a) - b[f"center_{a}"]) / side for a in "xyz"})


def centroids(points: DataFrame, *keys: str) -> DataFrame:
    """The mean point of each group and its size."""
    return points.groupBy(*keys).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count("*").alias("n"))


def mean_neighbour_distance(points: DataFrame, k: int, *, every: int = 10, above: int = 1000) -> float:
    """Mean distance of the k nearest; of tables with more than ``above`` points only every ``every``-th id asks, which is what
    defines this statistic."""
    asks = points.where(F.col("id") % every == 0) if points.count() > above else points
    return knn(asks, points, k).agg(F.avg("dist")).first()[0] or 0.0


def voxelize(points: DataFrame, *, cell_size: float | None = None, ratio: float = 2.5) -> DataFrame:
    """Points with their voxel: ``ix, iy, iz`` and ``cell``. Without ``cell_size`` it is ``ratio`` times the mean distance of the three nearest.

    The grid begins one average length (the cell size, if given) below the box and its last cells are closed.
    """
    length = cell_size if cell_size else mean_neighbour_distance(points, 3)
    size = cell_size if cell_size else ratio * length
    b = bounding_box(points).first()
    if not b["n"] or not size:
        return points.withColumns({f"i{a}": F.lit(0).cast("long") for a in "xyz"}).withColumn("cell", F.lit(0).cast("long"))
    out = points
    for a in "xyz":
        half = b[f"half_{a}"] + length
        count = max(1, -int(-(2 * half) // size))
        out = out.withColumn(f"i{a}", geom.cell_index(F.col(a), F.lit(b[f"min_{a}"] - length), size, count))
    return out.withColumn("cell", geom.cell_id(F.col("ix"), F.col("iy"), F.col("iz")))


def voxel_members(voxels: DataFrame) -> DataFrame:
    """``cell, n, members``: the points of each voxel. Members are listed, so a voxel has to fit into a row."""
    return voxels.groupBy("cell").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("members"))


def _scatter(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Sums of products of the offsets of each point's neighbours."""
    p = points.select(F.col("id").alias("src"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    q = points.select(F.col("id").alias("dst"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    d = {a: F.col(f"q{a}") - F.col(f"p{a}") for a in "xyz"}
    joined = edges.select("src", "dst").join(p, "src").join(q, "dst")
    return joined.groupBy("src").agg(*[F.sum(d[a] * d[b]).alias(f"s{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")], *[F.sum(d[a]).alias(f"m{a}") for a in "xyz"], F.count("*").alias("n"))


def _reference_covariance() -> dict[str, Column]:
    """Covariance of the scatter matrix read as three observations."""
    rows = {"x": ("sxx", "sxy", "sxz"), "y": ("sxy", "syy", "syz"), "z": ("sxz", "syz", "szz")}
    mean = [(F.col(rows["x"][j]) + F.col(rows["y"][j]) + F.col(rows["z"][j])) / 3.0 for j in range(3)]
    apart = {a: [F.col(rows[a][j]) - mean[j] for j in range(3)] for a in "xyz"}
    return {f"c{a}{b}": (apart["x"][i] * apart["x"][j] + apart["y"][i] * apart["y"][j] + apart["z"][i] * apart["z"][j]) / 2.0 for (i, a), (j, b) in (((0, "x"), (0, "x")), ((0, "x"), (1, "y")), ((0, "x"), (2, "z")), ((1, "y"), (1, "y")), ((1, "y"), (2, "z")), ((2, "z"), (2, "z")))}


def _mean_covariance() -> dict[str, Column]:
    return {f"c{a}{b}": F.col(f"s{a}{b}") / F.col("n") - F.col(f"m{a}") * F.col(f"m{b}") / (F.col("n") * F.col("n")) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}


def _eigen(c: DataFrame, keep: list[str]) -> DataFrame:
    """Greatest eigenvalue and eigenvector of a symmetric matrix cxx..czz by the trigonometric closed form."""
    c = c.withColumn("q", (F.col("cxx") + F.col("cyy") + F.col("czz")) / 3.0)
    c = c.withColumn("p1", F.col("cxy") * F.col("cxy") + F.col("cxz") * F.col("cxz") + F.col("cyz") * F.col("cyz"))
    dx, dy, dz = (F.col(n) - F.col("q") for n in ("cxx", "cyy", "czz"))
    c = c.withColumn("p", F.sqrt((dx * dx + dy * dy + dz * dz + 2.0 * F.col("p1")) / 6.0))
    b = {n: (F.col(f"c{n}") - (F.col("q") if n[0] == n[1] else F.lit(0.0))) / F.nullif(F.col("p"), F.lit(0.0)) for n in ("xx", "xy", "xz", "yy", "yz", "zz")}
    det = b["xx"] * (b["yy"] * b["zz"] - b["yz"] * b["yz"]) - b["xy"] * (b["xy"] * b["zz"] - b["yz"] * b["xz"]) + b["xz"] * (b["xy"] * b["yz"] - b["yy"] * b["xz"])
    c = c.withColumn("phi", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / 2.0))) / 3.0)
    third = 2.0943951023931953
    c = c.withColumns({"l0": F.coalesce(F.col("q") + 2.0 * F.col("p") * F.cos("phi"), F.col("q")), "l2": F.coalesce(F.col("q") + 2.0 * F.col("p") * F.cos(F.col("phi") + third), F.col("q"))})
    c = c.withColumn("l1", 3.0 * F.col("q") - F.col("l0") - F.col("l2"))
    m = [[F.col("cxx"), F.col("cxy"), F.col("cxz")], [F.col("cxy"), F.col("cyy"), F.col("cyz")], [F.col("cxz"), F.col("cyz"), F.col("czz")]]
    one, two = ([[m[i][j] - (F.col(v) if i == j else F.lit(0.0)) for j in range(3)] for i in range(3)] for v in ("l1", "l2"))
    product = [[sum((one[i][k] * two[k][j] for k in range(1, 3)), one[i][0] * two[0][j]) for j in range(3)] for i in range(3)]
    columns = F.array_max(F.array(*[F.struct((product[0][j] * product[0][j] + product[1][j] * product[1][j] + product[2][j] * product[2][j]).alias("s"), product[0][j].alias("x"), product[1][j].alias("y"), product[2][j].alias("z")) for j in range(3)]))
    c = c.withColumn("big", columns)
    size = F.nullif(F.sqrt("big.s"), F.lit(0.0))
    return c.select(*keep, "l0", "l1", "l2", *[(F.col(f"big.{a}") / size).alias(f"d{a}") for a in "xyz"])


def linearity(edges: DataFrame, points: DataFrame, *, mode: str = "reference") -> DataFrame:
    """``id, sigma, dx, dy, dz, k``: how line-like each point's neighbours ``edges(src, dst)`` are, 1 for a line, and along which way.

    ``mode="reference"`` takes the eigenvalues of the covariance of the scatter matrix's three rows. Three observations have at most
    two eigenvalues other than zero, so sigma is (1 + sqrt(2 tr(C^2) / tr(C)^2 - 1)) / 2. ``mode="pca"`` takes those of the
    neighbours' covariance. Without extent sigma is 0.5 and the direction null.
    """
    return _line(_scatter(edges, points), mode)


def linearity_within(points: DataFrame, radius: float, *, moved: DataFrame | None = None, mode: str = "reference") -> DataFrame:
    """``linearity`` with all points nearer than ``radius`` as neighbours, or with their places in ``moved``; no pair becomes a row."""
    return _line(nearby.scatter(points, radius, moved).withColumnRenamed("id", "src"), mode)


def _line(s: DataFrame, mode: str = "reference") -> DataFrame:
    """``id, sigma, dx, dy, dz, k`` of the sums ``src, sxx .. szz, mx, my, mz, n``."""
    if mode == "pca":
        e = _eigen(s.select("src", "n", *[v.alias(k) for k, v in _mean_covariance().items()]), ["src", "n"])
        total = F.nullif(F.col("l0") + F.col("l1") + F.col("l2"), F.lit(0.0))
        return e.select(F.col("src").alias("id"), F.coalesce(F.col("l0") / total, F.lit(0.5)).alias("sigma"), "dx", "dy", "dz", F.col("n").alias("k"))
    c = s.select("src", "n", *[v.alias(k) for k, v in _reference_covariance().items()])
    trace = F.col("cxx") + F.col("cyy") + F.col("czz")
    square = F.col("cxx") * F.col("cxx") + F.col("cyy") * F.col("cyy") + F.col("czz") * F.col("czz") + 2.0 * (F.col("cxy") * F.col("cxy") + F.col("cxz") * F.col("cxz") + F.col("cyz") * F.col("cyz"))
    c = c.withColumns({"t": trace, "t2": square}).withColumn("sigma", F.coalesce((1.0 + F.sqrt(F.greatest(F.lit(0.0), 2.0 * F.col("t2") / F.nullif(F.col("t") * F.col("t"), F.lit(0.0)) - 1.0))) / 2.0, F.lit(0.5)))
    # C (C - l1 I) is l0 (l0 - l1) v v^T: its largest column points along v.
    low = (1.0 - F.col("sigma")) * F.col("t")
    m = [["cxx", "cxy", "cxz"], ["cxy", "cyy", "cyz"], ["cxz", "cyz", "czz"]]
    prod = [[sum((F.col(m[i][k]) * (F.col(m[k][j]) - (low if k == j else F.lit(0.0))) for k in range(1, 3)), F.col(m[i][0]) * (F.col(m[0][j]) - (low if j == 0 else F.lit(0.0)))) for j in range(3)] for i in range(3)]
    big = F.array_max(F.array(*[F.struct((prod[0][j] * prod[0][j] + prod[1][j] * prod[1][j] + prod[2][j] * prod[2][j]).alias("s"), prod[0][j].alias("x"), prod[1][j].alias("y"), prod[2][j].alias("z")) for j in range(3)]))
    c = c.withColumn("big", big)
    size = F.nullif(F.sqrt("big.s"), F.lit(0.0))
    return c.select(F.col("src").alias("id"), "sigma", *[(F.col(f"big.{a}") / size).alias(f"d{a}") for a in "xyz"], F.col("n").alias("k"))


def smooth(values: DataFrame, edges: DataFrame, radius: float, column: str = "sigma") -> DataFrame:
    """``id, <column>``: values averaged over neighbours ``edges(src, dst, dist)`` with weights exp(-16 d^2 / radius^2), one step for all at once."""
    w = F.exp(-16.0 * F.col("dist") * F.col("dist") / (radius * radius))
    own = values.select("id", F.col(column).alias("own"))
    other = values.select(F.col("id").alias("dst"), F.col(column).alias("v"))
    sums = edges.where("src <> dst").join(other, "dst").groupBy(F.col("src").alias("id")).agg(F.sum(w * F.col("v")).alias("a"), F.sum(w).alias("b"))
    return own.join(sums, "id", "left").select("id", ((F.col("own") + F.coalesce("a", F.lit(0.0))) / (1.0 + F.coalesce("b", F.lit(0.0)))).alias(column))


def smooth_within(values: DataFrame, points: DataFrame, near: float, radius: float, column: str = "sigma", *, moved: DataFrame | None = None) -> DataFrame:
    """``smooth`` over all points nearer than ``near``; with ``moved`` the weights follow from the places there."""
    p = points.select("id", "x", "y", "z")
    if moved is not None:
        p = p.join(moved.select("id", *[F.col(a).alias(f"a{a}") for a in "xyz"]), "id")
    own = values.select("id", F.col(column).alias("own"))
    sums = nearby.weighted(p, p.join(own, "id"), near, ["own"], rate=16.0 / (radius * radius), others=True, moved=moved is not None)
    sums = sums.select("id", F.col("own").alias("a"), F.col("w").alias("b"))
    return own.join(sums, "id", "left").select("id", ((F.col("own") + F.coalesce("a", F.lit(0.0))) / (1.0 + F.coalesce("b", F.lit(0.0)))).alias(column))


def density(points: DataFrame, radius: float, *, invert: bool = False, root: bool = False) -> DataFrame:
    """``id, rho``: 1 plus the Gaussian weights exp(-4 d^2 / radius^2) of the other points within the radius; its inverse or root if asked."""
    sums = nearby.weighted(points, points, radius, [], rate=4.0 / (radius * radius), others=True)
    rho = 1.0 + F.coalesce("w", F.lit(0.0))
    return points.select("id").join(sums, "id", "left").select("id", (1.0 / rho if invert else F.sqrt(rho) if root else rho).alias("rho"))


def count_density(edges: DataFrame) -> DataFrame:
    """``id, rho``: 1 plus the weights exp(-16 d^2 / k^2) of the k neighbours ``edges(src, dst, dist)`` of each point, k being how many there are."""
    k = edges.groupBy("src").agg(F.count("*").alias("k"))
    w = F.exp(-16.0 * F.col("dist") * F.col("dist") / (F.col("k") * F.col("k")))
    return edges.join(k, "src").groupBy(F.col("src").alias("id")).agg((1.0 + F.sum(w)).alias("rho"))


def histogram_mode(values: DataFrame, column: str, *, bins: int = 13) -> DataFrame:
    """``mode``: the middle of the fullest of equal bins between least and greatest distinct value, the first of equals; 0 without extent."""
    v = values.select(F.col(column).alias("v")).where("v is not null").distinct()
    r = v.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    spark = values.sparkSession
    if r["a"] is None or r["b"] <= r["a"]:
        return spark.range(1).select(F.lit(0.0).alias("mode"))
    width = (r["b"] - r["a"]) / bins
    at = F.least(F.floor((F.col("v") - r["a"]) / width).cast("long"), F.lit(bins - 1).cast("long"))
    best = v.groupBy(at.alias("bin")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "bin").limit(1)
    return best.select((F.lit(r["a"]) + (F.col("bin") + 0.5) * width).alias("mode"))


def iteration_stats(state: DataFrame) -> DataFrame:
    """One row about ``state(id, sigma, frozen, k)``: neighbours of all and of active points, converged points, sums and mean of sigma."""
    active = ~F.col("frozen")
    return state.agg(
        F.avg("k").alias("mean_k"), F.max("k").alias("max_k"), F.min("k").alias("min_k"),
        F.avg(F.when(active, F.col("k"))).alias("active_mean_k"), F.max(F.when(active, F.col("k"))).alias("active_max_k"), F.min(F.when(active, F.col("k"))).alias("active_min_k"),
        F.sum("sigma").alias("sum_sigma"), F.avg("sigma").alias("mean_sigma"), F.count_if(F.col("frozen")).alias("frozen_count"), F.count("*").alias("n"),
    )


def polyline_length(points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, length, n``: the length of each group's line through its points in order."""
    w = Window.partitionBy(key).orderBy(*order)
    prev = points.withColumns({f"p{a}": F.lag(a).over(w) for a in "xyz"})
    return prev.groupBy(key).agg(F.coalesce(F.sum(F.sqrt(geom.squared("x", "y", "z", "px", "py", "pz"))), F.lit(0.0)).alias("length"), F.count("*").alias("n"))


def bounding_sphere(points: DataFrame, *keys: str) -> DataFrame:
    """Ritter's first guess: the middle and half length of the longest of the segments between extreme points on the three axes."""
    p = F.struct("x", "y", "z")
    ends = points.groupBy(*keys).agg(*[f(p, F.struct(a, "id")).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min_by), ("hi", F.max_by))])
    spans = F.array_max(F.array(*[F.struct(geom.distance(F.col(f"lo{a}"), F.col(f"hi{a}")).alias("d"), F.lit(i).alias("i"), F.col(f"lo{a}").alias("a"), F.col(f"hi{a}").alias("b")) for i, a in enumerate("zyx")]))
    return ends.withColumn("s", spans).select(*keys, *[((F.col(f"s.a.{a}") + F.col(f"s.b.{a}")) / 2).alias(f"c{a}") for a in "xyz"], (F.col("s.d") / 2).alias("radius"))


def incident_mean(edges: DataFrame) -> DataFrame:
    """``mean``: the weights of all edges by the number of nodes that have any."""
    nodes = edges.select("src").union(edges.select("dst")).distinct().agg(F.count("*").alias("v"))
    return edges.agg(F.sum("weight").alias("w")).join(nodes).select((F.col("w") / F.col("v")).alias("mean"))


def mean_of_smallest(points: DataFrame, key: str, value: str, take: int = 25) -> DataFrame:
    """``key, mean``: the mean of each group's ``take`` smallest values."""
    w = Window.partitionBy(key).orderBy(value)
    return points.withColumn("n", F.row_number().over(w)).where(F.col("n") <= take).groupBy(key).agg(F.avg(value).alias("mean"))
