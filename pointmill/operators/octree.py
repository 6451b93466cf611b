"""An adaptive octree: cells split until they hold at most so many points.

A cell is ``level, ix, iy, iz``: the root is level 0, a cell of level n is one of 8**n. Points know their deepest cell (``qx, qy, qz``), so every cell that holds a point is a
shift of these. What is stored of a tree are its full cells, those with more than ``capacity`` points: the leaf that a place lies in is one level
below the deepest full cell on its path. Levels are counted a few at a time, and only points in full cells go on to deeper ones; no cell's
points come together in one task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import discard, materialize

DEPTH = 20
CELL = ("ix", "iy", "iz")
DEEPEST = ("qx", "qy", "qz")


@dataclass(frozen=True)
class Root:
    """The cube that holds everything, by its lower corner and side."""

    x: float
    y: float
    z: float
    side: float

    def width(self, level: Column | int) -> Column:
        """The side of a cell."""
        return F.lit(self.side) / F.pow(F.lit(2.0), level if isinstance(level, Column) else F.lit(level))


def root_of(points: DataFrame, *others: DataFrame) -> tuple[Root, int]:
    """The least cube around the points of all tables, and the number of ``points``."""
    every = points.select("x", "y", "z", F.lit(1).alias("n"))
    for t in others:
        every = every.union(t.select("x", "y", "z", F.lit(0)))
    r = every.agg(F.sum("n").alias("n"), *[f(a).alias(f"{m}{a}") for a in "xyz" for m, f in (("a", F.min), ("b", F.max))]).first()
    if r["ax"] is None:
        return Root(0.0, 0.0, 0.0, 1.0), 0
    return Root(r["ax"], r["ay"], r["az"], max(max(r[f"b{a}"] - r[f"a{a}"] for a in "xyz") * (1 + 1e-9), 1e-300)), r["n"]


def deepest(points: DataFrame, origin: tuple[Column | float, ...], side: float, names: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """``points`` with their deepest cell ``qx, qy, qz`` in a cube with a corner at ``origin``."""
    at = {q: (F.col(a) - (o if isinstance(o, Column) else F.lit(o))) / side for q, a, o in zip(DEEPEST, names, origin, strict=True)}
    return points.withColumns({q: F.greatest(F.lit(0), F.least(F.lit(2**DEPTH - 1), F.floor(v * 2**DEPTH))).cast("long") for q, v in at.items()})


def cell_at(level: Column | str) -> list[Column]:
    """``ix, iy, iz`` of the cell of a level that holds a deepest cell; the level may be a column."""
    level = F.col(level) if isinstance(level, str) else level
    return [F.call_function("shiftright", F.col(q), (F.lit(DEPTH) - level).cast("int")).alias(i) for q, i in zip(DEEPEST, CELL, strict=True)]


@dataclass(frozen=True)
class Full:
    """The cells ``by, level, ix, iy, iz, n`` that hold more than a leaf may, and the deepest level that has one; -1 where the root is a leaf."""

    cells: DataFrame
    top: int
    parts: tuple[DataFrame, ...]


def full_cells(points: DataFrame, capacity: int, *by: str, count: int | None = None) -> Full:
    """The full cells of the points ``by, qx, qy, qz``, in a tree of its own for each ``by``."""
    here = materialize(points.groupBy(*by, *DEEPEST).agg(F.count("*").alias("n")), "cells")
    n = count if count is not None else here.count()
    first, last, top, parts, scratch = 0, min(DEPTH, max(2, math.ceil(math.log(max(1.0, n / capacity), 8)) + 1)), -1, [], [here]
    while True:
        each = here.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(first, last + 1)]))).select(*by, "level", *cell_at("level"), "n")
        part = materialize(each.groupBy(*by, "level", *CELL).agg(F.sum("n").alias("n")).where(F.col("n") > capacity), "full")
        parts.append(part)
        reached = part.agg(F.max("level")).first()[0]
        top = top if reached is None else reached
        if last == DEPTH or reached != last:
            break
        edge = part.where(F.col("level") == last).select(*by, *CELL)
        here = materialize(here.select("*", *cell_at(F.lit(last))).join(edge, [*by, *CELL], "left_semi").drop(*CELL), "cells")
        scratch.append(here)
        first, last = last + 1, min(DEPTH, last + 4)
    discard(*scratch)
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.union(part)
    return Full(cells, top, tuple(parts))


def leaf_levels(places: DataFrame, full: Full, *by: str) -> DataFrame:
    """``by, qx, qy, qz, level``: the level of the leaf that each of the distinct deepest cells of ``places`` lies in; empty leaves have one too."""
    cells = places.select(*by, *DEEPEST).distinct()
    if full.top < 0:
        return cells.withColumn("level", F.lit(0))
    each = cells.withColumn("level", F.explode(F.array(*[F.lit(i) for i in range(full.top + 1)]))).select(*by, *DEEPEST, "level", *cell_at("level"))
    inside = each.join(full.cells.select(*by, "level", *CELL), [*by, "level", *CELL]).groupBy(*by, *DEEPEST).agg(F.max("level").alias("level"))
    deep = inside.select(*by, *DEEPEST, F.least(F.col("level") + 1, F.lit(DEPTH)).alias("level"))
    return cells.join(deep, [*by, *DEEPEST], "left").select(*by, *DEEPEST, F.coalesce("level", F.lit(0)).alias("level"))


def with_leaf(points: DataFrame, full: Full, *by: str) -> DataFrame:
    """``points`` with the leaf ``level, ix, iy, iz`` that holds each."""
    return points.join(leaf_levels(points, full, *by), [*by, *DEEPEST]).select("*", *cell_at("level"))


def leaves(points: DataFrame, capacity: int = 200) -> tuple[DataFrame, Root]:
    """The points with their leaf ``level, ix, iy, iz``, and the root. Points at one place, or nearer than the root's side by 2**20, share a leaf whatever
    their number."""
    root, n = root_of(points)
    coded = deepest(points, (root.x, root.y, root.z), root.side)
    return with_leaf(coded, full_cells(coded, capacity, count=n)).drop(*DEEPEST), root
