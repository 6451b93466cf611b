"""Trees of skeleton nodes: refinement, splines and tube surfaces. A tree is ``node, parent, x, y, z``; the root is its own parent."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geom
from ..functions.scratch import discard, materialize
from . import nearby
from .graph import ancestors, subtree_sizes, subtree_sums, tree_depths


def spline_densify(tree: DataFrame, *, per_edge: int = 8, tension: float = 0.1) -> DataFrame:
    """``node, n, x, y, z``: points on a cardinal spline from each node's parent to the node, its controls being the grandparent
    and the node's smallest child, or the ends themselves where there is none. Coordinates are single precision."""
    t = tree.select("node", F.coalesce("parent", "node").alias("parent"), "x", "y", "z")
    up = t.select(F.col("node").alias("parent"), F.col("parent").alias("above"), *[F.col(a).alias(f"b{a}") for a in "xyz"])
    top = t.select(F.col("node").alias("above"), *[F.col(a).alias(f"a{a}") for a in "xyz"])
    kid = t.where("node <> parent").groupBy(F.col("parent").alias("node")).agg(F.min_by(F.struct("x", "y", "z"), "node").alias("kid"))
    j = t.where("node <> parent").join(up, "parent").join(top, "above", "left").join(kid, "node", "left")
    j = j.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(per_edge))))
    u = F.col("n") / per_edge
    return j.select("node", "n", *[geom.cardinal(F.col(f"a{a}"), F.col(f"b{a}"), F.col(a), F.coalesce(F.col(f"kid.{a}"), F.col(a)), u, tension).cast("double").alias(a) for a in "xyz"])


def branch_radii(tree: DataFrame, *, root_radius: float = 0.18, power: float = 3.0) -> DataFrame:
    """``node, radius``: radii that shrink with the share of leaves above a node, r^power being shared out between branches."""
    count = materialize(subtree_sizes(tree).select("node", "leaves"), "leaves")
    total = tree.join(tree.where("parent <> node").select(F.col("parent").alias("node")).distinct(), "node", "left_anti").count()
    return count.select("node", (F.lit(root_radius) * F.pow(F.col("leaves") / float(max(1, total)), F.lit(1 / power))).alias("radius"))


def circles(tree: DataFrame, radii: DataFrame, *, sides: int = 12) -> DataFrame:
    """``node, side, x, y, z``: the corners of a regular polygon about each node, square to the edge to its parent."""
    up = tree.select(F.col("node").alias("parent"), *[F.col(a).alias(f"p{a}") for a in "xyz"])
    j = tree.where("parent <> node").join(up, "parent").join(radii, "node")
    way = geom.vec(F.col("x") - F.col("px"), F.col("y") - F.col("py"), F.col("z") - F.col("pz"))
    j = j.where(geom.norm(way) > 0).withColumn("f", geom.frame(way)).withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    t = F.col("side") * (2 * math.pi / sides)
    return j.select("node", "side", *[(F.col(a) + F.col("radius") * (F.cos(t) * F.col(f"f.u.{a}") + F.sin(t) * F.col(f"f.v.{a}"))).alias(a) for a in "xyz"])


def triangles(tree: DataFrame, rings: DataFrame, *, sides: int = 12) -> DataFrame:
    """``node, side, part, a, b, c``: two triangles for each side of the tube between a node's ring and its parent's."""
    e = tree.where("parent <> node").select("node", "parent")
    at = F.struct("x", "y", "z")
    own = rings.select("node", "side", at.alias("p"))
    nxt = rings.select("node", ((F.col("side") + sides - 1) % sides).alias("side"), at.alias("q"))
    low = own.select(F.col("node").alias("parent"), "side", F.col("p").alias("lp"))
    lown = nxt.select(F.col("node").alias("parent"), "side", F.col("q").alias("lq"))
    j = e.join(own, "node").join(nxt, ["node", "side"]).join(low, ["parent", "side"]).join(lown, ["parent", "side"])
    pair = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("lp").alias("a"), F.col("lq").alias("b"), F.col("p").alias("c")), F.struct(F.lit(1).alias("part"), F.col("p").alias("a"), F.col("lq").alias("b"), F.col("q").alias("c"))))
    return j.select("node", "side", pair.alias("t")).select("node", "side", "t.*")


def tree_measures(tree: DataFrame) -> DataFrame:
    """``node, depth, root, size, height`` of every node."""
    return tree_depths(tree).join(subtree_sizes(tree).drop("leaves"), "node")


def fission(members: DataFrame, tree: DataFrame, *, rounds: int = 5) -> DataFrame:
    """``node, part, id``: the members ``node, id, x, y, z`` of each forking node, split by k-means into one part per child where
    the fork lies below the node: where the mean distance of the parts' centres from the node's is at least the root of the sum of
    squared part radii. Other forks have part 0 alone. Seeds are the children's centres drawn back by half an edge; a part without members
    keeps its centre. Parts are numbered by child, ties go to the smaller one.

    All forks are split together: a round places members with the centres of their node, which are as many as its children, and
    averages them in a hash aggregate, so a fork may have any number of members.
    """
    kids = tree.where("parent <> node").select(F.col("parent").alias("node"), F.col("node").alias("kid"), *[F.col(a).alias(f"k{a}") for a in "xyz"])
    forks = kids.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    held = materialize(members.select("node", "id", "x", "y", "z").join(forks, "node", "left_semi"), "members")
    middle = materialize(held.groupBy("node").agg(*[F.avg(a).alias(f"c{a}") for a in "xyz"]), "middle")
    number = F.row_number().over(Window.partitionBy("node").orderBy("kid")) - 1
    centres = kids.join(middle, "node").select("node", number.alias("part"), *[((F.col(f"k{a}") + F.col(f"c{a}")) / 2).alias(a) for a in "xyz"])
    centres = materialize(centres, "centres")
    for i in range(rounds):
        listed = centres.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("part", "x", "y", "z"))).alias("at"))
        options = F.transform("at", lambda c: F.struct(geom.distance(geom.vec("x", "y", "z"), geom.vec(c["x"], c["y"], c["z"])).alias("d"), c["part"].alias("part")))
        placed = held.join(listed, "node").withColumn("part", F.array_min(options)["part"]).drop("at")
        if i + 1 < rounds:
            means = placed.groupBy("node", "part").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
            centres = materialize(centres.join(means, ["node", "part"], "left").select("node", "part", *[F.coalesce(f"m{a}", a).alias(a) for a in "xyz"]), "centres")
    placed = materialize(placed, "placed")
    means = materialize(placed.groupBy("node", "part").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"]), "means")
    off = geom.distance(geom.vec("x", "y", "z"), geom.vec("mx", "my", "mz"))
    radii = placed.join(means, ["node", "part"]).groupBy("node", "part").agg(F.avg(off).alias("radius"))
    out = geom.distance(geom.vec("mx", "my", "mz"), geom.vec("cx", "cy", "cz"))
    verdict = means.join(radii, ["node", "part"]).join(middle, "node").groupBy("node").agg(((F.count("*") > 1) & (F.avg(out) >= F.sqrt(F.sum(F.col("radius") * F.col("radius"))))).alias("apart"))
    return placed.join(verdict, "node").select("node", F.when(F.col("apart"), F.col("part")).otherwise(0).cast("int").alias("part"), "id")


def refine(members: DataFrame, tree: DataFrame, *, rounds: int = 5, least_depth: int = 13) -> tuple[DataFrame, DataFrame]:
    """Members ``node, id, x, y, z`` and tree ``node, parent, x, y, z`` after the fission of forks from the tips to the root.

    Level by level, the forks whose children lie at ``least_depth`` or deeper are split by ``fission``. Each part but the first becomes a node beside the fork: it takes its members, has
    their mean as its place and leads from the fork's parent to its child; so a split makes the node above a fork, which the next level decides. Children of parts without members stay
    with the fork. The root never splits. A new node is named node + part * (largest node + 1). Nodes are not negative, an id stands once in a node. A level is one set of jobs over its
    forks alone, whatever their number.
    """
    size = tree.agg(F.min("node").alias("a"), F.max("node").alias("b")).first()
    if size["a"] is not None and size["a"] < 0:
        raise ValueError("nodes are numbered from 0")
    stride = (size["b"] or 0) + 1
    t = tree.select("node", F.coalesce("parent", "node").alias("parent"), "x", "y", "z").join(tree_depths(tree).select("node", "depth"), "node")
    t = materialize(t, "tree")
    m = materialize(members.select("node", "id", "x", "y", "z"), "members")
    deepest = t.agg(F.max("depth")).first()[0] or 0
    for level in range(deepest - 1, max(1, least_depth - 1) - 1, -1):
        kids = t.where(F.col("depth") == level + 1)
        forks = kids.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n")).where("n > 1").select("node")
        forks = materialize(t.join(forks, "node", "left_semi"), "forks")
        if forks.isEmpty():
            discard(forks)
            continue
        own = kids.join(forks.select(F.col("node").alias("parent")), "parent", "left_semi")
        parts = materialize(fission(m.join(forks.select("node"), "node", "left_semi"), own, rounds=rounds).where("part > 0"), "parts")
        if parts.isEmpty():
            discard(forks, parts)
            continue
        name = (F.col("node") + F.col("part") * stride).alias("into")
        moved = m.join(parts, ["node", "id"], "left").select(F.when(F.col("part").isNull(), F.col("node")).otherwise(name).alias("node"), "id", "x", "y", "z")
        moved = materialize(moved, "members")
        split = parts.select("node", "part").distinct()
        touched = split.select("node").union(split.select(name)).distinct()
        at = moved.join(touched, "node", "left_semi").groupBy("node").agg(*[F.avg(a).alias(f"m{a}") for a in "xyz"])
        number = (F.row_number().over(Window.partitionBy("parent").orderBy("node")) - 1).alias("part")
        lead = own.select(F.col("node").alias("kid"), F.col("parent").alias("node"), number).join(split, ["node", "part"]).select(F.col("kid").alias("node"), name)
        new = forks.join(split, "node").select(name.alias("node"), "parent", "x", "y", "z", "depth")
        whole = t.join(lead, "node", "left").select("node", F.coalesce("into", "parent").alias("parent"), "x", "y", "z", "depth").union(new)
        whole = whole.join(at, "node", "left").select("node", "parent", *[F.coalesce(f"m{a}", a).alias(a) for a in "xyz"], "depth")
        whole = materialize(whole, "tree")
        discard(t, m, forks, parts)
        t, m = whole, moved
    return m, t.drop("depth")


def smooth_radii(tree: DataFrame, radii: DataFrame, *, steps: int = 7) -> DataFrame:
    """``node, radius``: within ``steps`` nodes above a fork radii go linearly from the fork's to their own."""
    forks = tree.where("parent <> node").groupBy(F.col("parent").alias("fork")).agg(F.count("*").alias("n")).where("n > 1").select("fork")
    near = ancestors(tree, steps).where((F.col("hops") > 0) & (F.col("hops") <= steps)).join(forks, F.col("ancestor") == F.col("fork"), "left_semi")
    first = near.groupBy("node").agg(F.min(F.struct("hops", "ancestor")).alias("m")).select("node", "m.hops", F.col("m.ancestor").alias("fork"))
    fr = radii.select(F.col("node").alias("fork"), F.col("radius").alias("fr"))
    j = radii.join(first, "node", "left").join(fr, "fork", "left")
    t = F.col("hops") / float(steps)
    return j.select("node", F.when(F.col("hops").isNull(), F.col("radius")).otherwise(F.col("fr") + (F.col("radius") - F.col("fr")) * t).alias("radius"))


def member_radii(members: DataFrame, tree: DataFrame, *, bins: int = 13) -> DataFrame:
    """``node, radius`` from the members ``node, id, x, y, z`` of a tree's nodes: a leaf has the mean distance of its members from its
    centre; the nodes of a chain, each with one child, have the mode of all their members' distances from the axis to the next
    node, taken together and each distance once; a fork the root of the sum of its children's squares.
    Leaves and chains without members have radius 0."""
    kids, at, heads = _chains(tree)
    m = members.select("node", "id", "x", "y", "z").join(at.drop("parent"), "node")
    p, c = geom.vec("x", "y", "z"), geom.vec("cx", "cy", "cz")
    axis = geom.vec(F.col("k.kx"), F.col("k.ky"), F.col("k.kz"))
    m = m.withColumn("d", F.when(F.col("n").isNull(), geom.distance(p, c)).otherwise(F.coalesce(geom.distance_to_line(p, c, axis), geom.distance(p, c))))
    leaf = at.where("n is null").select("node").join(m.where("n is null").groupBy("node").agg(F.avg("d").alias("radius")), "node", "left")
    chain = materialize(m.where("n = 1").select("node", "d").join(heads, "node").select("head", "d").distinct(), "chains")
    span = chain.groupBy("head").agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    binned = chain.join(span, "head").withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("d") - F.col("lo")) / width).cast("int"), F.lit(bins - 1))).otherwise(F.lit(0)))
    full = binned.groupBy("head", "bin").agg(F.count("*").alias("m"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    mode = full.groupBy("head").agg(F.max(F.struct(F.col("m"), (-F.col("bin")).alias("b"), "lo", "hi")).alias("t"))
    mode = mode.select("head", F.when(F.col("t.hi") > F.col("t.lo"), F.col("t.lo") + (F.lit(0.5) - F.col("t.b")) * (F.col("t.hi") - F.col("t.lo")) / bins).otherwise(F.lit(0.0)).alias("radius"))
    return _with_forks(kids, at, leaf.union(heads.join(mode, "head", "left").select("node", "radius")))


def member_radii_within(points: DataFrame, tree: DataFrame, near: float, *, bins: int = 13) -> DataFrame:
    """``member_radii`` where the members of a node are the points nearer than ``near`` to it; no member becomes a row."""
    kids, at, heads = _chains(tree)
    place = [F.col(f"c{a}").alias(a) for a in "xyz"]
    ends = at.where("n is null").select(F.col("node").alias("id"), *place)
    far = nearby.weighted(ends, points, near, [], length=True)
    leaf = ends.select(F.col("id").alias("node")).join(far.select(F.col("id").alias("node"), (F.col("w") / F.col("n")).alias("radius")), "node", "left")
    axis = at.where("n = 1").join(heads, "node").select("head", "node", *place, *[(F.col(f"k.k{a}") - F.col(f"c{a}")).alias(f"u{a}") for a in "xyz"])
    mode = nearby.modes(axis, points, near, bins=bins)
    return _with_forks(kids, at, leaf.union(heads.join(mode, "head", "left").select("node", "radius")))


def _chains(tree: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The children of each node, the nodes with their number of children and the place of the first, and the heads of chains."""
    kids = tree.where("parent <> node").select(F.col("parent").alias("node"), F.col("node").alias("kid"), *[F.col(a).alias(f"k{a}") for a in "xyz"])
    count = kids.groupBy("node").agg(F.count("*").alias("n"), F.min_by(F.struct("kx", "ky", "kz"), "kid").alias("k"))
    at = materialize(tree.select("node", "parent", *[F.col(a).alias(f"c{a}") for a in "xyz"]).join(count, "node", "left"), "kids")
    single = at.where("n = 1").select("node", F.coalesce("parent", "node").alias("parent"))
    above = single.select(F.col("node").alias("parent"), F.col("node").alias("up"))
    heads = tree_depths(single.join(above, "parent", "left").select("node", F.coalesce("up", "node").alias("parent"))).select("node", F.col("root").alias("head"))
    return kids, at, materialize(heads, "heads")


def _with_forks(kids: DataFrame, at: DataFrame, known: DataFrame) -> DataFrame:
    """``node, radius`` of all nodes from those of leaves and chains."""
    known = materialize(known.select("node", F.coalesce("radius", F.lit(0.0)).alias("radius")), "radii")
    # A fork's square is the sum of those of all leaves and chains that are reached through forks alone.
    forks = at.where("n > 1").select("node", "parent")
    up = forks.select(F.col("node").alias("parent"), F.lit(True).alias("inside"))
    own = kids.join(known.select(F.col("node").alias("kid"), "radius"), "kid").groupBy("node").agg(F.sum(F.col("radius") * F.col("radius")).alias("weight"))
    forest = forks.join(up, "parent", "left").join(own, "node", "left")
    forest = forest.select("node", F.when(F.col("inside"), F.col("parent")).otherwise(F.col("node")).alias("parent"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
    return known.union(subtree_sums(forest).select("node", F.sqrt("weight")))
