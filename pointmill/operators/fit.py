"""Least-squares fits of groups of points; medians are in ``medians``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from .medians import joint_centres, l1_median, lvp_median, weighted_local_median  # noqa: F401  one place for the callers to take them from


def line_fit(points: DataFrame, *keys: str, x: str = "x", y: str = "y") -> DataFrame:
    """``keys, slope, intercept`` of y over x by least squares; null where x has no extent."""
    n, sx, sy, sxx, sxy = F.count("*").cast("double"), F.sum(x), F.sum(y), F.sum(F.col(x) * F.col(x)), F.sum(F.col(x) * F.col(y))
    s = points.groupBy(*keys).agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"))
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    return s.withColumn("slope", slope).select(*keys, "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"))


def _det3(m: list[list[Column]]) -> Column:
    return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])


def solve3(m: list[list[Column]], v: list[Column]) -> list[Column]:
    """Cramer's rule; null for a singular matrix."""
    det = F.nullif(_det3(m), F.lit(0.0))
    return [_det3([[v[i] if j == c else m[i][j] for j in range(3)] for i in range(3)]) / det for c in range(3)]


def _normal(points: DataFrame, keys: tuple[str, ...], terms: list[Column], target: Column) -> tuple[DataFrame, list[Column]]:
    sums = {f"m{i}{j}": F.sum(terms[i] * terms[j]) for i in range(3) for j in range(i, 3)} | {f"v{i}": F.sum(terms[i] * target) for i in range(3)}
    s = points.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()])
    return s, solve3([[F.col(f"m{min(i, j)}{max(i, j)}") for j in range(3)] for i in range(3)], [F.col(f"v{i}") for i in range(3)])


def plane_fit(points: DataFrame, *keys: str) -> DataFrame:
    """``keys, a, b, c`` of z = a x + b y + c by least squares."""
    s, r = _normal(points, keys, [F.col("x"), F.col("y"), F.lit(1.0)], F.col("z"))
    return s.select(*keys, *[e.alias(n) for e, n in zip(r, "abc", strict=True)])


def quadratic_fit(points: DataFrame, *keys: str) -> DataFrame:
    """``keys, a, b, c`` of y = a x^2 + b x + c by least squares."""
    s, r = _normal(points, keys, [F.col("x") * F.col("x"), F.col("x"), F.lit(1.0)], F.col("y"))
    return s.select(*keys, *[e.alias(n) for e, n in zip(r, "abc", strict=True)])


def circle_fit(points: DataFrame, *keys: str) -> DataFrame:
    """``keys, cx, cy, r``: the circle in x, y with the least sum of squared differences of squared distance and squared radius."""
    sq = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    s, r = _normal(points, keys, [F.col("x"), F.col("y"), F.lit(1.0)], sq)
    s = s.select(*keys, (r[0] / 2).alias("cx"), (r[1] / 2).alias("cy"), r[2].alias("k"))
    return s.select(*keys, "cx", "cy", F.sqrt(F.greatest(F.lit(0.0), F.col("k") + F.col("cx") * F.col("cx") + F.col("cy") * F.col("cy"))).alias("r"))


def moving_least_squares(points: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, x, y, z``: every point moved onto a quadratic curve through its neighbours.

    In the frame of the plane that fits the neighbours best (least squares of z over x and y, about the point), they are turned
    along their line of best fit, a quadratic is fitted across it, and the point moves to its value at 0. Where a fit is singular the
    point stays.
    """
    p = points.select(F.col("id").alias("src"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    q = points.select(F.col("id").alias("dst"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    near = edges.select("src", "dst").join(p, "src").join(q, "dst").select("src", "px", "py", "pz", *[(F.col(f"q{a}") - F.col(f"p{a}")).alias(a) for a in "xyz"])
    pl = plane_fit(near, "src")
    normal = geom.vec(-F.coalesce("a", F.lit(0.0)), -F.coalesce("b", F.lit(0.0)), F.lit(1.0))
    pl = pl.select("src", geom.frame(normal).alias("f"), F.coalesce("c", F.lit(0.0)).alias("h"))
    at = geom.vec("x", "y", "z")
    flat = near.join(pl, "src").withColumn("l", geom.to_local(at, geom.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)), F.col("f"))).select("src", "f", F.col("l.x").alias("x"), F.col("l.y").alias("y"), F.col("l.z").alias("z"))
    turn = line_fit(flat, "src").select("src", F.atan(F.coalesce("slope", F.lit(0.0))).alias("t"))
    turned = flat.join(turn, "src").select("src", (F.col("x") * F.cos("t") + F.col("y") * F.sin("t")).alias("x"), (F.col("y") * F.cos("t") - F.col("x") * F.sin("t")).alias("y"))
    curve = quadratic_fit(turned, "src").select("src", F.coalesce("c", F.lit(0.0)).alias("c"))
    moved = p.join(pl, "src", "left").join(turn, "src", "left").join(curve, "src", "left")
    local = geom.vec(-F.sin("t") * F.col("c"), F.cos("t") * F.col("c"), F.lit(0.0))
    world = geom.to_world(local, geom.vec("px", "py", "pz"), F.col("f"))
    return moved.withColumn("w", world).select(F.col("src").alias("id"), *[F.coalesce(f"w.{a}", f"p{a}").alias(a) for a in "xyz"])
