"""Vector and geometry algebra as column expressions. A vector is a struct of doubles x, y, z."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x: Column | str, y: Column | str, z: Column | str) -> Column:
    x, y, z = (F.col(c) if isinstance(c, str) else c for c in (x, y, z))
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def add(a: Column, b: Column) -> Column:
    return vec(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def minus(a: Column, b: Column) -> Column:
    return vec(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def towards(a: Column, b: Column) -> Column:
    """The vector from a to b, b - a."""
    return minus(b, a)


def scale(a: Column, s: Column | float) -> Column:
    return vec(a["x"] * s, a["y"] * s, a["z"] * s)


def divide(a: Column, s: Column) -> Column:
    """a / s; null where s is 0."""
    s = F.nullif(s, F.lit(0.0))
    return vec(a["x"] / s, a["y"] / s, a["z"] / s)


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def squared(ax, ay, az, bx, by, bz) -> Column:
    """Squared distance of two points given by six columns."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (ax, ay, az, bx, by, bz)]
    d = [p - q for p, q in zip(cols[:3], cols[3:], strict=True)]
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def distance_to_line(p: Column, a: Column, b: Column) -> Column:
    """Distance of p from the line through a and b; null if a = b."""
    return norm(cross(minus(b, a), minus(a, p))) / F.nullif(norm(minus(b, a)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of the angle between a and b, within -1..1; null for a zero vector."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))))


def sine(a: Column, b: Column) -> Column:
    c = cosine(a, b)
    return F.sqrt(F.greatest(F.lit(0.0), 1.0 - c * c))


def angle(a: Column, b: Column) -> Column:
    return F.acos(cosine(a, b))


def middle(a: Column, b: Column, c: Column) -> Column:
    """The middle one of three numbers."""
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def matrix_rows(m: Column) -> Column:
    """16 numbers as four rows of four."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice(m, r * 4 + 1, F.lit(4)))


def matrix_flat(rows: Column) -> Column:
    return F.flatten(rows)


def plane(normal: Column, point: Column) -> Column:
    """The plane a x + b y + c z + d = 0 through a point with a normal."""
    return F.struct(normal["x"].alias("a"), normal["y"].alias("b"), normal["z"].alias("c"), (-dot(normal, point)).alias("d"))


def distance_to_plane(p: Column, pl: Column) -> Column:
    """Distance of p from a plane; 0 for a plane without a direction."""
    size = F.sqrt(pl["a"] * pl["a"] + pl["b"] * pl["b"] + pl["c"] * pl["c"])
    return F.when(size == 0, F.lit(0.0)).otherwise(F.abs(pl["a"] * p["x"] + pl["b"] * p["y"] + pl["c"] * p["z"] + pl["d"]) / F.nullif(size, F.lit(0.0)))


def frame(normal: Column) -> Column:
    """An orthonormal frame u, v, w with w along the normal, without a case distinction but for the sign of z."""
    size = norm(normal)
    x, y, z = (normal[a] / size for a in "xyz")
    s = F.when(normal["z"] >= 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    a = F.lit(-1.0) / (s + z)
    u = vec(1.0 + s * x * x * a, s * x * y * a, -s * x)
    v = vec(x * y * a, s + y * y * a, -y)
    return F.struct(u.alias("u"), v.alias("v"), vec(x, y, z).alias("w"))


def to_local(p: Column, origin: Column, f: Column) -> Column:
    d = minus(p, origin)
    return vec(dot(d, f["u"]), dot(d, f["v"]), dot(d, f["w"]))


def to_world(p: Column, origin: Column, f: Column) -> Column:
    return add(origin, add(scale(f["u"], p["x"]), add(scale(f["v"], p["y"]), scale(f["w"], p["z"]))))


def gauss(r: Column, h: Column | float) -> Column:
    """exp(-4 r^2 / h^2)"""
    return F.exp(-4.0 * r * r / (h * h))


def cardinal(p0: Column, p1: Column, p2: Column, p3: Column, u: Column, tension: float) -> Column:
    """A cardinal spline's value between p1 and p2 at 0 <= u <= 1, as single precision."""
    s = (1.0 - tension) / 2.0
    u2, u3 = u * u, u * u * u
    w = (-s * u3 + 2 * s * u2 - s * u, (2 - s) * u3 + (s - 3) * u2 + 1.0, (s - 2) * u3 + (3 - 2 * s) * u2 + s * u, s * u3 - s * u2)
    return (p0 * w[0] + p1 * w[1] + p2 * w[2] + p3 * w[3]).cast("float")


def cell_index(value: Column, origin: Column, size: Column | float, count: Column | int) -> Column:
    """The half-open bin of a value, the last bin closed."""
    return F.least(F.floor((value - origin) / size).cast("long"), F.lit(count).cast("long") - 1 if isinstance(count, int) else count.cast("long") - 1)


def cell_id(ix: Column, iy: Column, iz: Column) -> Column:
    """(z << 40) | (y << 20) | x, 20 bits an axis."""
    return F.shiftleft(iz.cast("long"), 40).bitwiseOR(F.shiftleft(iy.cast("long"), 20)).bitwiseOR(ix.cast("long"))


def cell_of(cell: Column) -> tuple[Column, Column, Column]:
    mask = F.lit(0xFFFFF).cast("long")
    return cell.bitwiseAND(mask), F.shiftright(cell, 20).bitwiseAND(mask), F.shiftright(cell, 40).bitwiseAND(mask)


def octree_code(ix: Column, iy: Column, iz: Column, depth: int) -> Column:
    """Three bits a level, the coarsest level lowest, x the high bit of each triple."""
    code = F.lit(0).cast("long")
    for level in range(depth):
        for axis, at in ((ix, 2), (iy, 1), (iz, 0)):
            bit = F.shiftright(axis.cast("long"), depth - 1 - level).bitwiseAND(F.lit(1).cast("long"))
            code = code.bitwiseOR(F.shiftleft(bit, 3 * level + at))
    return code


def octree_cell(code: Column, depth: int) -> tuple[Column, Column, Column]:
    out = []
    for at in (2, 1, 0):
        v = F.lit(0).cast("long")
        for level in range(depth):
            v = F.shiftleft(v, 1).bitwiseOR(F.shiftright(code, 3 * level + at).bitwiseAND(F.lit(1).cast("long")))
        out.append(v)
    return out[0], out[1], out[2]


def offsets(reach: int = 1, faces_only: bool = False) -> Column:
    """Offsets of neighbouring cells as an array of structs: a cube of the given reach without its middle, or the six faces."""
    steps = range(-reach, reach + 1)
    cells = [(x, y, z) for x in steps for y in steps for z in steps if (x, y, z) != (0, 0, 0) and (not faces_only or abs(x) + abs(y) + abs(z) == 1)]
    return F.array(*[F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy"), F.lit(z).alias("dz")) for x, y, z in cells])


def is_valid(x: Column, y: Column, z: Column) -> Column:
    """A point that is there: none of its coordinates is NaN or null."""
    return ~(F.isnan(x) | F.isnan(y) | F.isnan(z) | x.isNull() | y.isNull() | z.isNull())


def random_key(seed: int, *ids: str) -> Column:
    """A digest that orders rows at random but always in the same way."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))
