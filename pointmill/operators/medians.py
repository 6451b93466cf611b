"""Centres of groups of points without a closed form.

Groups of at most ``bounded`` points are collected as arrays by a hash aggregate and solved many at a time: one Arrow pass goes through all rounds of thousands of
groups with sums over segments. Larger groups go through the same rounds with sums in hash aggregates over all their points, a job for each round, so
groups may be of any size. Points with a null or NaN coordinate take no part; a null key is a group like any other. A group that has not settled
after ``rounds`` raises.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.scratch import discard, materialize

BOUNDED = 4096


def valid(points: DataFrame) -> DataFrame:
    return points.where(geom.is_valid(F.col("x"), F.col("y"), F.col("z")))


def same_keys(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str = "inner") -> DataFrame:
    """A join on keys of which null equals null."""
    if not keys:
        return left.crossJoin(F.broadcast(right)) if how == "inner" else left.limit(0) if right.limit(1).collect() else left
    named = right.select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    met = F.lit(True)
    for i, k in enumerate(keys):
        met = met & left[k].eqNullSafe(named[f"__{i}"])
    return left.join(named, met, how).drop(*[f"__{i}" for i in range(len(keys))])


def split_by_size(points: DataFrame, keys: tuple[str, ...], bounded: int) -> tuple[DataFrame, DataFrame | None]:
    """``keys, at`` with the sorted points of each group of at most ``bounded``, and the points of larger groups, if there are any."""
    sizes = points.groupBy(*keys).agg(F.count("*").alias("n"))
    large = None
    if (sizes.agg(F.max("n")).first()[0] or 0) > bounded:
        big = materialize(sizes.where(F.col("n") > bounded).select(*keys, F.lit(1).alias("__big")), "large")
        large = same_keys(points, big, keys, "left_semi") if keys else points
        points = same_keys(points, big, keys, "left_anti") if keys else points.limit(0)
    return points.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("x", "y", "z"))).alias("at")), large


def solve_segments(groups: DataFrame, keys: tuple[str, ...], solve: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``keys, x, y, z`` of ``groups(keys, at)``: ``solve(points, starts)`` gets the points of many groups, one after the other, and returns a row for each."""
    schema = ", ".join([*[f"`{k}` {groups.schema[k].dataType.simpleString()}" for k in keys], "x double", "y double", "z double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                held = batch.column(batch.num_columns - 1)
                p = np.column_stack([c.to_numpy(zero_copy_only=False) for c in held.flatten().flatten()])
                offsets = held.offsets.to_numpy()
                found = solve(p, offsets[:-1] - offsets[0])
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(found[:, i]) for i in range(3)]], names=[*keys, "x", "y", "z"])

    return groups.where(F.size("at") > 0).select(*keys, "at").mapInArrow(run, schema)


class Segments:
    """Sums over segments of rows."""

    def __init__(self, starts: np.ndarray, rows: int):
        self.starts = starts
        self.size = np.diff(np.append(starts, rows))
        self.of = np.repeat(np.arange(len(starts)), self.size)

    def sum(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts, axis=0)

    def least(self, values: np.ndarray) -> np.ndarray:
        """The first row of each segment that has its least value."""
        low = np.minimum.reduceat(values, self.starts)
        return np.minimum.reduceat(np.where(values == low[self.of], np.arange(len(values)), len(values)), self.starts)

    def only(self, keep: np.ndarray) -> tuple[Segments, np.ndarray]:
        """Some of the segments, and a mask of their rows."""
        rows = keep[self.of]
        return Segments(np.cumsum(self.size[keep]) - self.size[keep], int(rows.sum())), rows


def _units(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distances to a place, 1 / distance, and unit vectors to the points; 0 for points at the place."""
    off = p - at
    d = np.sqrt((off * off).sum(axis=1))
    inverse = np.divide(1.0, d, out=np.zeros_like(d), where=d > 0)
    return d, inverse, off * inverse[:, None]


def _newton(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """h^-1 g for each group; NaN where h is singular."""
    out = np.full_like(g, np.nan)
    fine = np.abs(np.linalg.det(h)) > 0
    out[fine] = np.linalg.solve(h[fine], g[fine][:, :, None])[:, :, 0]
    return out


def l1_segments(p: np.ndarray, starts: np.ndarray, tol: float, rounds: int) -> np.ndarray:
    """The L1 medians of segments, by the rules of ``l1_median``."""
    seg = Segments(starts, len(p))
    m = seg.sum(p) / seg.size[:, None]
    q, slow_at, best, share = np.full_like(m, np.nan), np.full_like(m, np.nan), np.full(len(m), np.nan), np.ones(len(m))
    out, index = np.empty_like(m), np.arange(len(m))
    for _ in range(rounds):
        d, inverse, unit = _units(p, m[seg.of])
        e, _, pull = _units(p, q[seg.of])
        here, there = seg.sum(d == 0), seg.sum(e == 0)
        f, w, g, r = seg.sum(d), seg.sum(inverse), seg.sum(unit), seg.sum(np.nan_to_num(pull))
        h = w[:, None, None] * np.eye(3) - seg.sum(inverse[:, None, None] * unit[:, :, None] * unit[:, None, :])
        close = p[seg.least(d)]
        length = lambda v: np.sqrt((v * v).sum(axis=1))
        at_q = ~np.isnan(q[:, 0]) & (length(r) <= there + tol * seg.size)
        short = np.maximum(0.0, 1.0 - here / np.maximum(length(g), 1e-300))
        worse = f > best  # false before the first round
        slow = m + np.where(w > 0, short / np.where(w > 0, w, 1.0), 0.0)[:, None] * g
        way = _newton(h, g)
        whole = np.where((here > 0)[:, None] | np.isnan(way), slow - m, way)
        step = np.where((here > 0)[:, None] | np.isnan(way), slow, m + share[:, None] * way)
        still = np.abs(whole).sum(axis=1) <= 1e-15 * np.abs(m).sum(axis=1)
        at_m = (length(g) <= here + tol * seg.size) | (still & ~worse)
        settled = at_m | at_q
        out[index[settled]] = np.where(at_m[:, None], m, q)[settled]
        left = ~settled
        if not left.any():
            return out
        m, q, slow_at, best = np.where(worse[:, None], slow_at, step)[left], close[left], np.where(worse[:, None], slow_at, slow)[left], np.where(worse, np.nan, f)[left]
        share = np.where(worse, share / 2, np.minimum(1.0, 2 * share))[left]
        index = index[left]
        seg, rows = seg.only(left)
        p = p[rows]
    raise RuntimeError(f"{len(index)} medians did not settle in {rounds} rounds")


def l1_median(points: DataFrame, *keys: str, tol: float = 1e-11, rounds: int = 100, bounded: int = BOUNDED) -> DataFrame:
    """``keys, x, y, z``: the point with the least sum of distances to each group.

    A place is the median if the unit vectors to the members elsewhere add up to no more than the number of members at it, ``tol`` for each member allowed;
    the member nearest to the last place is tried too. Otherwise the place moves by a Newton step, or by a Weiszfeld step after one that made the sum larger, whereupon Newton steps are halved for a while.
    Where many points are medians (two members, or an even number on a line) the result is the one reached from the mean. A group also settles when its step
    is below the resolution of its coordinates.
    """
    small, large = split_by_size(valid(points.select(*keys, "x", "y", "z")), keys, bounded)
    found = solve_segments(small, keys, lambda p, starts: l1_segments(p, starts, tol, rounds))
    return found if large is None else found.union(_l1_large(large, keys, tol, rounds))


def _l1_large(p: DataFrame, keys: tuple[str, ...], tol: float, rounds: int) -> DataFrame:
    from .fit import solve3

    at, near = {a: F.col(a) - F.col(f"m{a}") for a in "xyz"}, {a: F.col(a) - F.col(f"q{a}") for a in "xyz"}
    d, e = F.col("d"), F.col("e")
    unit = {a: F.when(d > 0, at[a] / d).otherwise(0.0) for a in "xyz"}
    inverse = F.when(d > 0, 1.0 / d).otherwise(0.0)
    sums = {"n": F.count("*"), "f": F.sum(d), "w": F.sum(inverse), "here": F.sum((d == 0).cast("long")), "there": F.sum((e == 0).cast("long"))}
    sums |= {f"g{a}": F.sum(unit[a]) for a in "xyz"} | {f"r{a}": F.sum(F.when(e > 0, near[a] / e).otherwise(0.0)) for a in "xyz"}
    sums |= {f"h{a}{b}": F.sum(inverse * (F.lit(float(a == b)) - unit[a] * unit[b])) for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")}
    sums |= {"close": F.min_by(F.struct("x", "y", "z"), F.struct("d", "x", "y", "z"))}
    state = ["mx", "my", "mz", "qx", "qy", "qz", "sx", "sy", "sz", "best", "share"]
    nothing = F.lit(None).cast("double")
    now = p.groupBy(*keys).agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"]).select(*keys, "mx", "my", "mz", *[nothing.alias(c) for c in state[3:-1]], F.lit(1.0).alias("share"))
    now, done = materialize(now, "median"), None
    length = lambda c: F.sqrt(sum((F.col(f"{c}{a}") * F.col(f"{c}{a}") for a in "xyz"), F.lit(0.0)))
    for _ in range(rounds):
        j = same_keys(p, now, keys).withColumn("d", geom.distance(geom.vec("x", "y", "z"), geom.vec("mx", "my", "mz"))).withColumn("e", geom.distance(geom.vec("x", "y", "z"), geom.vec("qx", "qy", "qz")))
        r = j.groupBy(*keys, *state).agg(*[v.alias(k) for k, v in sums.items()])
        r = r.withColumn("at_q", F.col("qx").isNotNull() & (length("r") <= F.col("there") + tol * F.col("n")))
        newton = solve3([[F.col("h" + min(a, b) + max(a, b)) for b in "xyz"] for a in "xyz"], [F.col(f"g{a}") for a in "xyz"])
        short = F.greatest(F.lit(0.0), 1.0 - F.col("here") / F.greatest(length("g"), F.lit(1e-300)))
        worse = F.coalesce(F.col("f") > F.col("best"), F.lit(False))
        slow = {a: F.when(F.col("w") > 0, F.col(f"m{a}") + short * F.col(f"g{a}") / F.col("w")).otherwise(F.col(f"m{a}")) for a in "xyz"}
        step = {a: F.when(F.col("here") > 0, slow[a]).otherwise(F.coalesce(F.col(f"m{a}") + F.col("share") * s, slow[a])) for a, s in zip("xyz", newton, strict=True)}
        whole = {a: F.when(F.col("here") > 0, slow[a] - F.col(f"m{a}")).otherwise(F.coalesce(s, slow[a] - F.col(f"m{a}"))) for a, s in zip("xyz", newton, strict=True)}
        still = sum((F.abs(whole[a]) for a in "xyz"), F.lit(0.0)) <= 1e-15 * sum((F.abs(f"m{a}") for a in "xyz"), F.lit(0.0))
        r = r.withColumn("at_m", (length("g") <= F.col("here") + tol * F.col("n")) | (still & ~worse))
        moved = {f"m{a}": F.when(worse, F.col(f"s{a}")).otherwise(step[a]) for a in "xyz"} | {f"q{a}": F.col(f"close.{a}") for a in "xyz"}
        moved |= {f"s{a}": F.when(worse, F.col(f"s{a}")).otherwise(slow[a]) for a in "xyz"} | {"best": F.when(worse, nothing).otherwise(F.col("f"))}
        moved |= {"share": F.when(worse, F.col("share") / 2).otherwise(F.least(F.lit(1.0), 2 * F.col("share")))}
        end = [F.when(F.col("at_m"), F.col(f"m{a}")).otherwise(F.col(f"q{a}")).alias(a) for a in "xyz"]
        r = materialize(r.select(*keys, (F.col("at_m") | F.col("at_q")).alias("settled"), *end, *[v.alias(k) for k, v in moved.items()]), "median")
        part = r.where("settled").select(*keys, "x", "y", "z")
        done = part if done is None else done.union(part)
        now = r.where("not settled").select(*keys, *state)
        if now.isEmpty():
            return done
    raise RuntimeError(f"medians did not settle in {rounds} rounds")


#: Step lengths that a round of ``Descent`` tries together.
STEPS = np.array([1.0, 0.5, 0.25, 2.0**-4, 2.0**-7, 2.0**-12])
#: A value, three slopes and six second derivatives.
FACTS = 10


class Cost:
    """A cost of a centre c as a function of sums over a group: ``terms(d, u)`` are what is summed, d the distances and u the unit vectors from the points to c;
    ``facts(sums)`` makes value, gradient and second derivatives of them; no round goes
    farther than ``reach``, and a ``boxed`` centre stays in the box of its group, as a cost that vanishes far from all points has no minimum out there. Both hold for arrays, the terms for columns too."""

    def __init__(self, names: tuple[str, ...], terms: Callable, facts: Callable, reach: float = float("inf"), boxed: bool = False):
        self.names, self.terms, self.facts, self.reach, self.boxed = names, terms, facts, reach, boxed


_PAIRS = ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))


def variance_penalty(k: float) -> Cost:
    """Sum of distances plus k times the sum of their squared deviations from their mean."""

    def terms(d, u, exp):
        return [1.0 + 0.0 * d, d, d * d, *u, *[d * v for v in u], *[(float(i == j) - u[i] * u[j]) / d for i, j in _PAIRS]]

    def facts(s):
        n, s1, s2, su, sc, a = s[0], s[1], s[2], s[3:6], s[6:9], s[9:15]
        value = s1 + k * (s2 - s1 * s1 / n)
        gradient = [su[i] + 2 * k * (sc[i] - su[i] * s1 / n) for i in range(3)]
        return [value, *gradient, *[a[m] * (1 - 2 * k * s1 / n) + 2 * k * (n * float(i == j) - su[i] * su[j] / n) for m, (i, j) in enumerate(_PAIRS)]]

    return Cost(tuple(f"t{i}" for i in range(15)), terms, facts)


def local_weight(s: float) -> Cost:
    """Sum of d exp(-s d^2)."""

    def terms(d, u, exp):
        e = exp(-s * d * d)
        slope, bend = e * (1.0 - 2.0 * s * d * d), e * (4.0 * s * s * d * d * d - 6.0 * s * d)
        return [d * e, *[v * slope for v in u], *[bend * u[i] * u[j] + slope / d * (float(i == j) - u[i] * u[j]) for i, j in _PAIRS]]

    return Cost(tuple(f"t{i}" for i in range(FACTS)), terms, lambda t: t, 0.5 / s**0.5, True)


def moved(state: dict[str, np.ndarray], step: np.ndarray | float) -> np.ndarray:
    """Where a step leads to: along the way, but not out of the box ``low, high``."""
    return np.clip(state["c"] + step * state["way"], state["low"], state["high"])


def advance(state: dict[str, np.ndarray], facts: np.ndarray, cost: Cost, tol: float) -> np.ndarray:
    """Moves the centres ``c`` to the best of the steps tried along ``way``, whose ``facts`` (groups, steps, 10) are given, and turns ``way`` to the next Newton
    direction, all curvatures counted as positive. Where no step was better ``way`` is cut. True for groups that have settled: the way is shorter than ``tol``
    times the size of the coordinates, or the cost falls by no more than its resolution."""
    pick, rows = facts[:, :, 0].argmin(axis=1), np.arange(len(facts))
    new, old = facts[rows, pick], state["value"]
    better = new[:, 0] < old
    state["c"] = np.where(better[:, None], moved(state, STEPS[pick][:, None]), state["c"])
    g, h = new[:, 1:4], new[:, [4, 5, 6, 5, 7, 8, 6, 8, 9]].reshape(-1, 3, 3)
    # What pushes against the box takes no part.
    free = ~(((state["c"] <= state["low"]) & (g > 0)) | ((state["c"] >= state["high"]) & (g < 0)))
    g, h = g * free, np.where(free[:, :, None] & free[:, None, :], h, np.eye(3))
    curve, axes = np.linalg.eigh(h)
    curve = np.maximum(np.abs(curve), 1e-9 * np.abs(curve).max(axis=1, keepdims=True) + 1e-300)
    way = -np.einsum("gij,gj->gi", axes, np.einsum("gji,gj->gi", axes, g) / curve)
    length = np.sqrt((way * way).sum(axis=1, keepdims=True))
    way *= np.minimum(1.0, cost.reach / np.maximum(length, 1e-300))
    state["way"] = np.where(better[:, None], way, state["way"] * STEPS[-1] / 2)
    state["value"] = np.where(better, new[:, 0], old)
    short = np.abs(state["way"]).max(axis=1) <= tol * (np.abs(state["c"]).max(axis=1) + 1e-3)
    with np.errstate(invalid="ignore"):
        return short | (better & np.isfinite(old) & (old - new[:, 0] <= 1e-14 * np.abs(old)))


def descend_segments(p: np.ndarray, starts: np.ndarray, begin: np.ndarray, cost: Cost, tol: float, rounds: int) -> np.ndarray:
    """The centres of segments that descent from ``begin`` leads to."""
    seg, index, out = Segments(starts, len(p)), np.arange(len(begin)), np.empty_like(begin)
    state = {"c": begin.copy(), "way": np.zeros_like(begin), "value": np.full(len(begin), np.inf), "low": np.full_like(begin, -np.inf), "high": np.full_like(begin, np.inf)}
    if cost.boxed:
        state |= {"low": np.minimum.reduceat(p, starts), "high": np.maximum.reduceat(p, starts)}
    for _ in range(rounds):
        facts = np.empty((len(index), len(STEPS), FACTS))
        for t, step in enumerate(STEPS):
            off = moved(state, step)[seg.of] - p
            d = np.maximum(np.sqrt((off * off).sum(axis=1)), 1e-12)
            u = [off[:, i] / d for i in range(3)]
            facts[:, t] = np.column_stack(cost.facts([seg.sum(v) for v in cost.terms(d, u, np.exp)]))
        settled = advance(state, facts, cost, tol)
        out[index[settled]] = state["c"][settled]
        left = ~settled
        if not left.any():
            return out
        state, index = {k: v[left] for k, v in state.items()}, index[left]
        seg, rows = seg.only(left)
        p = p[rows]
    raise RuntimeError(f"{len(index)} centres did not settle in {rounds} rounds")


def _descend_large(points: DataFrame, begin: DataFrame, keys: tuple[str, ...], cost: Cost, tol: float, rounds: int) -> DataFrame:
    """The same for groups of any size, ``begin(keys, x, y, z)``: a hash aggregate over all points and steps a round; only the groups' sums meet ``advance``."""
    end = lambda f, v: F.array(*[f(a) if cost.boxed else F.lit(v) for a in "xyz"])
    box = points.groupBy(*keys).agg(end(F.min, float("-inf")).alias("low"), end(F.max, float("inf")).alias("high"))
    begin = same_keys(begin, box, keys).select(*keys, F.array("x", "y", "z").alias("c"), F.array(*[F.lit(0.0)] * 3).alias("way"), "low", "high", F.lit(float("inf")).alias("value"))
    state, facts_of = materialize(begin, "centres"), ["c", "way", "low", "high", "value"]
    kinds = ", ".join(f"`{k}` {begin.schema[k].dataType.simpleString()}" for k in keys)
    done, scratch = None, [state]
    for _ in range(rounds):
        j = same_keys(points, state.select(*keys, *facts_of), keys).withColumn("step", F.explode(F.array(*[F.lit(float(s)) for s in STEPS])))
        off = [F.greatest(F.col("low")[i], F.least(F.col("high")[i], F.col("c")[i] + F.col("step") * F.col("way")[i])) - F.col(a) for i, a in enumerate("xyz")]
        j = j.withColumns({f"o{a}": v for a, v in zip("xyz", off, strict=True)}).withColumn("d", F.greatest(F.sqrt(F.col("ox") * F.col("ox") + F.col("oy") * F.col("oy") + F.col("oz") * F.col("oz")), F.lit(1e-12)))
        terms = cost.terms(F.col("d"), [F.col(f"o{a}") / F.col("d") for a in "xyz"], F.exp)
        sums = j.groupBy(*keys, *facts_of, "step").agg(*[F.sum(t if isinstance(t, Column) else F.lit(t)).alias(n) for n, t in zip(cost.names, terms, strict=True)])
        held = sums.groupBy(*keys, *facts_of).agg(F.sort_array(F.collect_list(F.struct((-F.col("step")).alias("step"), *cost.names))).alias("s"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                n, own = b.num_rows, dict(zip(facts_of, b.columns[len(keys) :], strict=False))
                flat = [c.to_numpy(zero_copy_only=False) for c in b.columns[-1].flatten().flatten()]
                facts = np.stack(cost.facts([c.reshape(n, len(STEPS)) for c in flat[1:]]), axis=2)
                now = {k: v.to_numpy(zero_copy_only=False) if k == "value" else v.flatten().to_numpy().reshape(n, 3) for k, v in own.items()}
                settled = advance(now, facts, cost, tol)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], *[pa.array(list(now[k])) for k in facts_of], pa.array(settled)], names=[*keys, *facts_of, "settled"])

        schema = ", ".join([kinds, *[f"{k} array<double>" for k in facts_of[:-1]], "value double", "settled boolean"])
        after = materialize(held.select(*keys, *facts_of, "s").mapInArrow(run, schema), "centres")
        part = after.where("settled").select(*keys, *[F.col("c")[i].alias(a) for i, a in enumerate("xyz")])
        done = part if done is None else done.union(part)
        state = after.where("not settled")
        if state.isEmpty():
            discard(*scratch)
            return done
    raise RuntimeError(f"centres did not settle in {rounds} rounds")


def optimised_centre(points: DataFrame, key: str, cost: Cost, *, tol: float = 1e-10, rounds: int = 200, bounded: int = BOUNDED) -> DataFrame:
    """``key, x, y, z``: the centre that descent from the mean of each group leads to; the mean itself where the gradient vanishes there."""
    p = valid(points.select(key, "x", "y", "z"))
    small, large = split_by_size(p, (key,), bounded)

    def solve(at: np.ndarray, starts: np.ndarray) -> np.ndarray:
        seg = Segments(starts, len(at))
        return descend_segments(at, starts, seg.sum(at) / seg.size[:, None], cost, tol, rounds)

    found = solve_segments(small, (key,), solve)
    if large is None:
        return found
    begin = large.groupBy(key).agg(*[F.avg(a).alias(a) for a in "xyz"])
    return found.union(_descend_large(large, begin, (key,), cost, tol, rounds))


def lvp_median(points: DataFrame, key: str, *, k: float = 30.0, bounded: int = BOUNDED) -> DataFrame:
    """The least sum of distances with a penalty for their variance."""
    return optimised_centre(points, key, variance_penalty(k), bounded=bounded)


def weighted_local_median(points: DataFrame, key: str, *, s: float = 100.0, bounded: int = BOUNDED) -> DataFrame:
    """The least sum of d exp(-s d^2) that descent from the mean reaches."""
    return optimised_centre(points, key, local_weight(s), bounded=bounded)


def in_order(points: DataFrame, key: str) -> DataFrame:
    """``key, x, y, z, place, n``: the place of each point in the order of the coordinates of its group, from 0, and the group's size. Points are dealt by ranges,
    and only the ranges' sizes come together, so no task orders a whole group."""
    dealt = points.select(key, "x", "y", "z").repartitionByRange(key, "x", "y", "z").sortWithinPartitions(key, "x", "y", "z")
    rows = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in rows.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before = {p: sum(n for o, n in sizes.items() if o < p) for p in sizes}
    if not before:
        return rows.select(key, "x", "y", "z", F.col("at").alias("place"), F.col("at").alias("n"))
    offset = F.create_map(*[F.lit(int(v)) for p in before for v in (p, before[p])])
    rows = rows.select(key, "x", "y", "z", (offset[part] + within).alias("row"))
    first = rows.groupBy(key).agg(F.min("row").alias("first"), F.count("*").alias("n"))
    return same_keys(rows, first, (key,)).select(key, "x", "y", "z", (F.col("row") - F.col("first")).alias("place"), "n")


def joint_centres(points: DataFrame, key: str, starts: int, *, s: float = 100.0, tol: float = 1e-10, rounds: int = 200, bounded: int = BOUNDED) -> DataFrame:
    """``key, centre, x, y, z``: ``starts`` centres of each group that minimise the sum of d exp(-s d^2) together, begun at points spread evenly over the group in
    the order of their coordinates. The sum over the centres falls apart, so each descends by itself."""
    p = valid(points.select(key, "x", "y", "z"))
    placed = in_order(p, key)
    wanted = F.array(*[F.struct(F.lit(i).alias("centre"), F.round((F.col("n") - 1) * (i / max(1, starts - 1))).cast("long").alias("w")) for i in range(starts)])
    begin = placed.withColumn("c", F.explode(F.filter(wanted, lambda c: c["w"] == F.col("place")))).select(key, F.col("c.centre").alias("centre"), "x", "y", "z")
    begin = materialize(begin, "begin")
    small, large = split_by_size(p, (key,), bounded)
    each = same_keys(small, begin.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("centre", "x", "y", "z"))).alias("begin")), (key,))
    cost = local_weight(s)
    kind = points.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                held, first = b.column(1), b.column(2)
                offsets = held.offsets.to_numpy()
                q = np.column_stack([c.to_numpy(zero_copy_only=False) for c in held.flatten().flatten()])
                centre, *xyz = [c.to_numpy(zero_copy_only=False) for c in first.flatten().flatten()]
                # A group's points once for each of its centres.
                of = np.repeat(np.arange(b.num_rows), np.diff(first.offsets.to_numpy()))
                begins, size = (offsets[:-1] - offsets[0])[of], np.diff(offsets)[of]
                rows = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())
                found = descend_segments(q[rows], np.cumsum(size) - size, np.column_stack(xyz), cost, tol, rounds)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(centre.astype(np.int32)), *[pa.array(found[:, i]) for i in range(3)]], names=[key, "centre", "x", "y", "z"])

    found = each.select(key, "at", "begin").mapInArrow(run, f"`{key}` {kind}, centre int, x double, y double, z double")
    if large is None:
        return found
    big = same_keys(begin, large.select(key).distinct(), (key,), "left_semi")
    many = large.withColumn("centre", F.explode(F.array(*[F.lit(i) for i in range(starts)])))
    return found.union(_descend_large(many, big, (key, "centre"), cost, tol, rounds))
