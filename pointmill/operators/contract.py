"""Contraction of a cloud onto its curve skeleton."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from . import nearby
from .spatial import knn, spread, with_self
from .stats import iteration_stats, linearity, linearity_within, smooth, smooth_within


@dataclass(frozen=True)
class ContractionParams:
    """``init_radius``: tenths of diagonal / n^(1/3); ``iteration_num``: steps between two searches for neighbours;
    ``stop_sigma``: thousandths of mean sigma at which the loop ends; ``increase``: how fast neighbourhoods grow, in percent."""

    init_radius: float = 10.0
    iteration_num: int = 12
    stop_sigma: float = 990.0
    increase: float = 100.0
    frozen_above: float = 0.99
    max_iterations: int = 91

    def __post_init__(self):
        if not (1 <= self.init_radius <= 100 and 2 <= self.iteration_num <= 200 and 900 <= self.stop_sigma <= 999 and 0 <= self.increase <= 300):
            raise ValueError(f"out of range: {self}")


def mean_shift(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, ux, uy, uz``: mean offset from each point to its neighbours ``edges(src, dst)``."""
    p = state.select(F.col("id").alias("src"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    q = state.select(F.col("id").alias("dst"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
    j = edges.select("src", "dst").join(p, "src").join(q, "dst")
    return j.groupBy(F.col("src").alias("id")).agg(*[F.avg(F.col(f"q{a}") - F.col(f"p{a}")).alias(f"u{a}") for a in "xyz"])


def move(state: DataFrame, shift: DataFrame, *, along_axis: bool) -> DataFrame:
    """Points moved by their shift; with ``along_axis`` the part of it along the principal direction counts only 1 - sigma times."""
    j = state.join(shift, "id", "left")
    u = {a: F.coalesce(f"u{a}", F.lit(0.0)) for a in "xyz"}
    if along_axis:
        t = F.coalesce(u["x"] * F.col("dx") + u["y"] * F.col("dy") + u["z"] * F.col("dz"), F.lit(0.0)) * F.col("sigma")
        u = {a: u[a] - F.coalesce(t * F.col(f"d{a}"), F.lit(0.0)) for a in "xyz"}
    return j.select("id", *[(F.col(a) + u[a]).alias(a) for a in "xyz"], *[c for c in state.columns if c not in ("id", "x", "y", "z")])


def contraction_step(state: DataFrame, edges: DataFrame, radius: float, *, first: bool, frozen_above: float = 0.99) -> DataFrame:
    """``id, x, y, z, sigma, dx, dy, dz, frozen, k`` after one step: move, then linearity of the same neighbours, smoothed."""
    points = move(state, mean_shift(state, edges), along_axis=not first).select("id", "x", "y", "z", "k")
    return measured(points, edges, radius, frozen_above)


def contraction_step_within(points: DataFrame, state: DataFrame, near: float, radius: float, *, first: bool, frozen_above: float = 0.99) -> DataFrame:
    """``contraction_step`` of ``state`` where the neighbours are all pairs of ``points`` nearer than ``near``; no pair becomes a row."""
    sums = nearby.scatter(points, near, state)
    shift = sums.select("id", *[(F.col(f"m{a}") / F.col("n")).alias(f"u{a}") for a in "xyz"])
    moved = materialize(move(state, shift, along_axis=not first).select("id", "x", "y", "z", "k"), "moved")
    s = materialize(linearity_within(points, near, moved=moved).drop("k"), "linearity")
    return _after(moved, s, smooth_within(s, points, near, radius, moved=moved), frozen_above)


def _after(points: DataFrame, s: DataFrame, even: DataFrame, frozen_above: float) -> DataFrame:
    out = points.join(s.drop("sigma"), "id", "left").join(even, "id", "left")
    return out.select("id", "x", "y", "z", F.coalesce("sigma", F.lit(0.5)).alias("sigma"), "dx", "dy", "dz", (F.coalesce("sigma", F.lit(0.5)) > frozen_above).alias("frozen"), "k")


def measured(points: DataFrame, edges: DataFrame, radius: float, frozen_above: float = 0.99) -> DataFrame:
    s = linearity(edges, points).drop("k")
    near = edges.join(points.select(F.col("id").alias("src"), *[F.col(a).alias(f"p{a}") for a in "xyz"]), "src").join(points.select(F.col("id").alias("dst"), *[F.col(a).alias(f"q{a}") for a in "xyz"]), "dst")
    d = {a: F.col(f"q{a}") - F.col(f"p{a}") for a in "xyz"}
    near = near.select("src", "dst", F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]).alias("dist"))
    return _after(points, s, smooth(s, near, radius), frozen_above)


def k_update(state: DataFrame, k0: int, mean_distance: float, *, iteration: int, iteration_num: int, increase: float = 1.0, floor: int = 20) -> DataFrame:
    """``id, k``: neighbourhood sizes grown by k0 (a^2 (2c - 1) + 2a) exp(-(s - m)^2 / (0.95 - m)^2), with c refreshes so far and m
    the least sigma, at most a quarter of the active points, then averaged over neighbours within three mean distances."""
    c = iteration // iteration_num
    grow = k0 * (increase * increase * (2 * c - 1) + 2 * increase)
    r = state.agg(F.min("sigma").alias("m"), F.sum((~F.col("frozen")).cast("long")).alias("active")).first()
    width = max(1e-9, 0.95 - (r["m"] or 0.0))
    top = max(floor, (r["active"] or 0) // 4)
    s = F.col("sigma") - F.lit(r["m"] or 0.0)
    grown = state.select("id", "x", "y", "z", F.least(F.lit(float(top)), F.greatest(F.lit(float(floor)), F.col("k") + grow * F.exp(-s * s / (width * width)))).alias("k"))
    grown = materialize(grown, "grown")
    near = nearby.weighted(grown, grown, 3 * mean_distance, ["k"])
    return near.select("id", F.floor(F.col("k") / F.col("n")).cast("int").alias("k"))


def contract(points: DataFrame, params: ContractionParams = ContractionParams(), on_iteration=None) -> DataFrame:
    """The contracted cloud with its linearity. ``on_iteration(i, stats_row)`` is called before each step.

    Neighbour ids stay as they are between two searches, while points move; each step's state and each search's edges are written
    to the shared folder. Neighbourhoods grow with a search, up to a quarter of the active points.
    """
    n, diagonal, _ = spread(points)
    start = points.select("id", "x", "y", "z")
    if n < 7:
        return start.select("*", F.lit(0.5).alias("sigma"), *[F.lit(None).cast("double").alias(f"d{a}") for a in "xyz"], F.lit(False).alias("frozen"), F.lit(0).alias("k"))
    mean_distance = knn(start, start, 5).agg(F.avg("dist")).first()[0]
    radius = diagonal / n**0.33333 * params.init_radius / 10
    k0 = min(n - 1, max(20, int(radius / max(mean_distance, 1e-12)) ** 2))
    edges = materialize(with_self(knn(start, start, k0), start), "edges")
    state = materialize(measured(start.withColumn("k", F.lit(k0)), edges, radius, params.frozen_above), "state")
    for i in range(params.max_iterations):
        stats = iteration_stats(state).first()
        if on_iteration:
            on_iteration(i, stats)
        if stats["mean_sigma"] >= params.stop_sigma / 1000:
            break
        state = materialize(contraction_step(state, edges, radius, first=i == 0, frozen_above=params.frozen_above), "state")
        if i and i % params.iteration_num == 0:
            k = materialize(k_update(state, k0, mean_distance, iteration=i, iteration_num=params.iteration_num, increase=params.increase / 100), "k")
            state = materialize(state.drop("k").join(k, "id"), "state")
            nearest = knn(state.withColumn("k", F.least(F.greatest("k", F.lit(10)), F.lit(n - 1))), state, "k")
            edges = materialize(with_self(nearest, state), "edges")
    return state


def redistribute(state: DataFrame, *, iterations: int = 6, k: int = 5) -> DataFrame:
    """Points that have not converged drawn to the mean of their five nearest, again and again."""
    edges = materialize(knn(state, state, k).select("src", "dst"), "edges")
    for _ in range(iterations):
        q = state.select(F.col("id").alias("dst"), *[F.col(a).alias(f"q{a}") for a in "xyz"])
        m = edges.join(q, "dst").groupBy(F.col("src").alias("id")).agg(*[F.avg(f"q{a}").alias(f"q{a}") for a in "xyz"])
        j = state.join(m, "id", "left")
        state = materialize(j.select("id", *[F.when(F.col("frozen"), F.col(a)).otherwise(F.coalesce(f"q{a}", a)).alias(a) for a in "xyz"], *[c for c in state.columns if c not in ("id", "x", "y", "z")]), "state")
    return state
