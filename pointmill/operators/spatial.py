"""Spatial joins on a grid and an octree.

Points are ``id, x, y, z``. A join within a radius puts points into cells and joins on equal cells; the neighbouring cells are
listed by ``explode`` on one side, so that the join has equal keys and the distance is only a filter. Neither a cross join nor a
nested loop is planned. Dense cells split (``octree``), and a search for the nearest begins in cells of the size that the place asks for.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.scratch import discard, materialize
from . import octree


def with_cell(points: DataFrame, size: float, prefix: str = "c") -> DataFrame:
    """Adds the cell (three longs) that holds each point, half-open on every axis."""
    return points.withColumns({f"{prefix}{a}": F.floor(F.col(a) / size).cast("long") for a in "xyz"})


def around(reach: int = 1) -> Column:
    """The offsets of a cell and its neighbours, as an array of structs."""
    steps = range(-reach, reach + 1)
    return F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(o, ("dx", "dy", "dz"), strict=True)]) for o in ((a, b, c) for a in steps for b in steps for c in steps)])


def radius_join(queries: DataFrame, points: DataFrame, radius: float, *, inclusive: bool = False, capacity: int = 2048) -> DataFrame:
    """``src, dst, dist``: every query with every point nearer than ``radius``, itself included.

    Cells are as wide as the radius. One with more than ``capacity`` points is a tree of its own, and a query goes to those of its leaves that lie within
    the radius; a leaf that cannot split, of points at one place, is dealt in blocks of ``capacity``. So no key holds more points than that.
    """
    q = with_cell(queries.select("id", "x", "y", "z"), radius).select(F.col("id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("z").alias("sz"), "cx", "cy", "cz", F.explode(around()).alias("o"))
    q = q.select("src", "sx", "sy", "sz", (F.col("cx") + F.col("o.dx")).alias("kx"), (F.col("cy") + F.col("o.dy")).alias("ky"), (F.col("cz") + F.col("o.dz")).alias("kz"))
    p = with_cell(points.select("id", "x", "y", "z"), radius, "k").select(F.col("id").alias("dst"), "x", "y", "z", "kx", "ky", "kz")
    near = geom.squared("sx", "sy", "sz", "x", "y", "z")
    inside = near <= radius * radius if inclusive else near < radius * radius
    cell = ["kx", "ky", "kz"]
    hot = materialize(p.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > capacity).select(*cell), "hot")
    if not hot.limit(1).collect():
        discard(hot)
        return q.join(p, cell).where(inside).select("src", "dst", F.sqrt(near).alias("dist"))
    coded = octree.deepest(p.join(hot, cell, "left_semi"), tuple(F.col(k) * radius for k in cell), radius)
    leaf = [*cell, "level", *octree.CELL]
    held = materialize(octree.with_leaf(coded, octree.full_cells(coded, capacity, *cell), *cell).drop(*octree.DEEPEST), "leaves")
    boxes = held.groupBy(*leaf).agg(F.ceil(F.count("*") / capacity).alias("blocks"), *[f(a).alias(f"{m}{a}") for a in "xyz" for m, f in (("a", F.min), ("b", F.max))])
    boxes = materialize(boxes, "boxes")
    off = {a: F.greatest(F.col(f"a{a}") - F.col(f"s{a}"), F.col(f"s{a}") - F.col(f"b{a}"), F.lit(0.0)) for a in "xyz"}
    meets = sum((v * v for v in off.values()), F.lit(0.0)) <= radius * radius
    asks = q.join(boxes, cell).where(meets).select("src", "sx", "sy", "sz", *leaf, F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    held = held.join(boxes.select(*leaf, "blocks"), leaf).withColumn("block", F.pmod(F.xxhash64("dst"), F.col("blocks"))).drop("blocks")
    cold = q.join(p.join(hot, cell, "left_anti"), cell)
    both = cold.select("src", "dst", "sx", "sy", "sz", "x", "y", "z").union(asks.join(held, [*leaf, "block"]).select("src", "dst", "sx", "sy", "sz", "x", "y", "z"))
    return both.where(inside).select("src", "dst", F.sqrt(near).alias("dist"))


def spread(points: DataFrame) -> tuple[int, float, float]:
    """Number of points, diagonal of their bounding box and its longest side."""
    r = points.agg(F.count("*").alias("n"), *[f(a).alias(f"{m}{a}") for a in "xyz" for m, f in (("a", F.min), ("b", F.max))]).first()
    sides = [(r[f"b{a}"] or 0.0) - (r[f"a{a}"] or 0.0) for a in "xyz"]
    return r["n"], math.sqrt(sum(s * s for s in sides)), max(sides)


def knn(queries: DataFrame, points: DataFrame, k: int | str, *, exclude_coincident: bool = False) -> DataFrame:
    """``src, dst, dist, rank``: the exact k nearest points of each query, itself excluded by id; ties by id. ``k`` may name a column of the queries.

    An octree of the points, whose leaves hold at most 2 (k + 1), gives each query a cell to begin with, so neither a dense nor an empty region decides the
    size for others. Each round looks into the 27 cells around a query at its level. A query is done when its k-th neighbour is no farther than a cell is
    wide, for nothing outside can be nearer; the others go on one level up. Of points at one place only the k + 1 smallest ids can be neighbours, so a
    place that holds a large share of all points adds no more candidates than that. With ``exclude_coincident`` points at the query's own place are left out.
    """
    own = isinstance(k, str)
    points = points.select("id", "x", "y", "z").where(geom.is_valid(F.col("x"), F.col("y"), F.col("z")))
    asks = queries.select(F.col("id").alias("src"), *[F.col(a).alias(f"s{a}") for a in "xyz"], (F.col(k).cast("int") if own else F.lit(k)).alias("k")).where(geom.is_valid(F.col("sx"), F.col("sy"), F.col("sz")) & (F.col("k") > 0))
    least, most = asks.agg(F.min("k"), F.max("k")).first() if own else (k, k)
    at_place = Window.partitionBy("x", "y", "z").orderBy("id")
    few = materialize(points.withColumn("n", F.row_number().over(at_place)).where(F.col("n") <= (most or 0) + 1).drop("n"), "places")
    root, n = octree.root_of(few, queries.where(geom.is_valid(F.col("x"), F.col("y"), F.col("z"))))  # a query may lie far outside
    corner = (root.x, root.y, root.z)
    p = octree.deepest(few.withColumnRenamed("id", "dst"), corner, root.side)
    left = octree.deepest(asks, corner, root.side, ("sx", "sy", "sz"))
    full = octree.full_cells(p, 2 * ((least or 0) + 1), count=n)
    # An eighth of the places lies in a cell one level down.
    start = F.greatest(F.lit(0), F.col("level") - F.round(F.log(F.col("k") / F.lit(float(least or 1))) / math.log(8)).cast("int"))
    left = materialize(left.join(octree.leaf_levels(left, full), [*octree.DEEPEST]).withColumn("level", start), "asks")
    near, done = geom.squared("sx", "sy", "sz", "x", "y", "z"), None
    best = Window.partitionBy("src").orderBy("d2", "dst")
    facts = ["src", "sx", "sy", "sz", "k", *octree.DEEPEST, "level"]
    while True:
        levels = [r["level"] for r in left.select("level").distinct().collect()]  # at most one more than the tree is deep
        if not levels:
            break
        q = left.withColumn("o", F.explode(around())).select("src", "sx", "sy", "sz", "k", "level", *[(c + F.col(f"o.d{a}")).alias(f"i{a}") for c, a in zip(octree.cell_at("level"), "xyz", strict=True)])
        there = p.withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels]))).select("dst", "x", "y", "z", "level", *octree.cell_at("level"))
        found = q.join(there, ["level", *octree.CELL]).where((F.col("src") != F.col("dst")) & (near > 0 if exclude_coincident else F.lit(True)))
        order = found.select("src", "k", "level", "dst", near.alias("d2")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
        order = materialize(order.where(F.col("rank") <= F.col("k")) if own else order, "nearest")
        width = root.width(F.col("level")) * (1 - 1e-9)
        settled = order.groupBy("src", "k", "level").agg(F.count("*").alias("n"), F.max("d2").alias("far")).where((F.col("level") == 0) | ((F.col("n") == F.col("k")) & (F.col("far") <= width * width))).select("src")
        part = order.join(settled, "src", "left_semi").select("src", "dst", F.sqrt("d2").alias("dist"), "rank")
        done = part if done is None else done.union(part)
        old, left = left, materialize(left.where("level > 0").join(settled, "src", "left_anti").withColumn("level", F.col("level") - 1).select(*facts), "asks")
        discard(old)
    discard(*full.parts)
    return done if done is not None else queries.sparkSession.createDataFrame([], f"src {_kind(queries)}, dst {_kind(points)}, dist double, rank int")


def _kind(table: DataFrame) -> str:
    return table.schema["id"].dataType.simpleString()


def nearest_one(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, node_id, dist``: each point's nearest node, ties by id. Ids of points and nodes are unrelated, those of nodes not negative."""
    apart = nodes.select((F.col("id") + (1 << 61)).alias("id"), "x", "y", "z")
    found = knn(points.select("id", "x", "y", "z"), apart, 1)
    return found.select(F.col("src").alias("id"), (F.col("dst") - (1 << 61)).alias("node_id"), "dist")


def nearest_pair(a: DataFrame, b: DataFrame) -> DataFrame:
    """``src, dst, dist``: the nearest pair of two sets, ties by ids; one row."""
    return nearest_one(a, b).orderBy("dist", "id", "node_id").limit(1).select(F.col("id").alias("src"), F.col("node_id").alias("dst"), "dist")


def voxel_neighbours(cells: DataFrame, *, reach: int = 1) -> DataFrame:
    """``src, dst``: pairs of occupied cells ``cell, ix, iy, iz`` at most ``reach`` steps apart on every axis, both directions."""
    o = F.explode(geom.offsets(reach)).alias("o")
    q = cells.select(F.col("cell").alias("src"), "ix", "iy", "iz", o).select("src", *[(F.col(f"i{a}") + F.col(f"o.d{a}")).alias(f"i{a}") for a in "xyz"])
    return q.join(cells.select(F.col("cell").alias("dst"), "ix", "iy", "iz"), ["ix", "iy", "iz"]).select("src", "dst")


def voxel_graph(cells: DataFrame, *, reach: int = 1) -> DataFrame:
    """``src, dst, weight``: adjacent cells with the distance of their centres ``cx, cy, cz``."""
    c = cells.select("cell", "cx", "cy", "cz")
    a = c.select(F.col("cell").alias("src"), F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("cz").alias("sz"))
    b = c.withColumnRenamed("cell", "dst")
    return voxel_neighbours(cells, reach=reach).join(a, "src").join(b, "dst").select("src", "dst", F.sqrt(geom.squared("sx", "sy", "sz", "cx", "cy", "cz")).alias("weight"))


def knn_graph(points: DataFrame, k: int) -> DataFrame:
    """``src, dst, weight``: the symmetric k-nearest graph."""
    e = knn(points, points, k).select("src", "dst", F.col("dist").alias("weight"))
    return e.union(e.select("dst", "src", "weight")).dropDuplicates(["src", "dst"])


def ranked(df: DataFrame, value: str, *ties: str, buckets: int = 64) -> DataFrame:
    """``df`` with ``rank``, 1 for the least ``value``, ties by further columns. Rows are ranked in buckets between approximate
    quantiles and only the buckets' sizes come together, so no task orders the whole table."""
    cuts = sorted(set(df.approxQuantile(value, [i / buckets for i in range(1, buckets)], 0.2 / buckets)))
    bucket = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: F.col(value) > c)) if cuts else F.lit(0)
    held = df.withColumn("__bucket", bucket)
    sizes = {r["__bucket"]: r["n"] for r in held.groupBy("__bucket").agg(F.count("*").alias("n")).collect()}
    before = [sum(n for b, n in sizes.items() if b < i) for i in range(len(cuts) + 1)]
    place = F.row_number().over(Window.partitionBy("__bucket").orderBy(value, *ties))
    return held.withColumn("rank", place + F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), F.col("__bucket") + 1)).drop("__bucket")


def trimmed_knn_graph(points: DataFrame, k: int = 5, *, cut: float = 0.03) -> tuple[DataFrame, float]:
    """The k-nearest edges without the longest ones, and the mean length of all edges. Of n edges ceil(cut n / (1 + cut)) go."""
    e = materialize(knn(points, points, k).select("src", "dst", "dist"), "edges")
    n, mean = e.agg(F.count("*"), F.avg("dist")).first()
    drop = math.ceil(cut * n / (1 + cut))
    if not drop:
        return e, mean
    return ranked(e, "dist", "src", "dst").where(F.col("rank") <= n - drop).drop("rank"), mean


def with_self(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Neighbour edges with an edge of length 0 from every point to itself."""
    own = points.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("dist"))
    return edges.select("src", "dst", "dist").union(own).distinct()


def within_component(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Neighbour edges whose ends lie in one component of ``found(node, component)``: neighbours along the surface, not across a gap."""
    a = found.select(F.col("node").alias("src"), F.col("component").alias("ca"))
    b = found.select(F.col("node").alias("dst"), F.col("component").alias("cb"))
    return edges.join(a, "src").join(b, "dst").where("ca = cb").select(*edges.columns)


def hops(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """``src, dst, hop``: nodes within ``depth`` edges of each start, by the fewest edges."""
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    seen = starts.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hop"))
    edge = seen
    for h in range(1, depth + 1):
        step = edge.join(e, edge["dst"] == e["a"]).select("src", F.col("b").alias("dst"), F.lit(h).alias("hop")).distinct()
        edge = materialize(step.join(seen, ["src", "dst"], "left_anti"), "hop")
        seen = seen.union(edge)
    return seen


def covered_cells(points: DataFrame, size: float) -> DataFrame:
    """``cx, cy, cz, n``: the cells that hold the points, and how many each."""
    return with_cell(points, size).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))
