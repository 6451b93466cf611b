"""Queries of scalar functions, statistics and fits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geom
from ..operators import fit, stats
from .views import CLOUD_E, CLOUD_L, EDGES_SIGMA, PTS, cloud_e, cloud_l, pts

D2 = "(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)"


def _round(df, *cols, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def _at():
    return geom.vec("x", "y", "z")


def _v(x, y, z):
    return geom.vec(F.lit(x), F.lit(y), F.lit(z))


def voxel_centroid(spark, sf_dir):
    v = stats.voxelize(pts(spark, sf_dir), cell_size=0.1)
    return _round(stats.centroids(v, "cell"), "x", "y", "z")


def voxel_estimated(spark, sf_dir):
    """Voxels of the size that the nearest neighbours suggest."""
    return _round(stats.centroids(stats.voxelize(pts(spark, sf_dir)), "cell"), "x", "y", "z")


def lineitem_voxels(spark, sf_dir):
    v = stats.voxelize(cloud_l(spark, sf_dir), cell_size=5.0)
    return _round(stats.centroids(v, "cell"), "x", "y", "z", digits=4)


def _voxel_sql(cte, name, size):
    axes = ", ".join(f"CAST(least(floor(({a} - (min_{a} - {size})) / {size}), greatest(1, ceil((max_{a} - min_{a} + 2*{size}) / {size})) - 1) AS BIGINT) AS i{a}" for a in "xyz")
    box = ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}" for a in "xyz")
    return f"WITH {cte}, box AS (SELECT {box} FROM {name}), v AS (SELECT {name}.*, {axes} FROM {name}, box), w AS (SELECT *, iz * 1099511627776 + iy * 1048576 + ix AS cell FROM v)"


def bounding_box(spark, sf_dir):
    b = stats.bounding_box(pts(spark, sf_dir))
    return _round(b, *[c for c in b.columns if c != "n"])


def plane_distance(spark, sf_dir):
    pl = geom.plane(_v(1.0, 2.0, -0.5), _v(0.1, 0.0, 0.2))
    flat = geom.plane(_v(0.0, 0.0, 0.0), _v(0.1, 0.0, 0.2))
    return pts(spark, sf_dir).select("id", F.round(geom.distance_to_plane(_at(), pl), 6).alias("dist"), geom.distance_to_plane(_at(), flat).alias("degenerate"))


def point_line_distance(spark, sf_dir):
    return pts(spark, sf_dir).select("id", F.round(geom.distance_to_line(_at(), _v(0.0, 0.1, 0.0), _v(1.0, 0.5, -0.3)), 6).alias("dist"))


def vector_algebra(spark, sf_dir):
    a, b = _at(), _v(0.3, -0.2, 0.9)
    c, s = geom.cross(a, b), geom.towards(a, b)
    out = {"dist": geom.distance(a, b), "size": geom.norm(a), "cx": c["x"], "cy": c["y"], "cz": c["z"], "mx": s["x"], "sx": geom.add(a, b)["x"], "qx": geom.divide(a, F.lit(4.0))["x"], "cosine": geom.cosine(a, b), "sine": geom.sine(a, b), "mid": geom.middle(a["x"], a["y"], a["z"]), "top": F.greatest(a["x"], a["y"], a["z"]), "low": F.least(a["x"], a["y"], a["z"])}
    return pts(spark, sf_dir).select("id", *[F.round(v, 6).alias(k) for k, v in out.items()])


def osculating_frame(spark, sf_dir):
    """Local coordinates of a fixed point in each point's frame, and back."""
    d = pts(spark, sf_dir).where(geom.norm(_at()) > 0).withColumn("f", geom.frame(_at()))
    d = d.withColumn("here", geom.to_local(_v(0.5, -0.25, 1.0), _at(), F.col("f")))
    d = d.withColumn("back", geom.to_world(F.col("here"), _at(), F.col("f")))
    return d.select("id", F.round("here.z", 6).alias("height"), F.round(geom.norm(F.col("here")), 6).alias("dist"), *[F.round(f"back.{a}", 6).alias(f"b{a}") for a in "xyz"])


def normalize(spark, sf_dir):
    return _round(stats.normalize(cloud_e(spark, sf_dir).select("id", "x", "y", "z")), "x", "y", "z")


def cardinal_spline(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("x", "id")
    q = cloud_e(spark, sf_dir).select("id", "z", *[F.lag("z", n).over(w).alias(f"p{n}") for n in (3, 2, 1)]).where("p3 is not null")
    u = F.lit(0.375)
    return q.select("id", *[F.round(geom.cardinal(F.col("p3"), F.col("p2"), F.col("p1"), F.col("z"), u, t).cast("double"), 3).alias(n) for t, n in ((0.1, "tree"), (0.5, "bridge"))])


def octree_code(spark, sf_dir):
    cells = {f"i{a}": F.least(F.greatest(F.floor((F.col(a) + 1.0) * 32.0), F.lit(0)), F.lit(63)).cast("long") for a in "xyz"}
    d = pts(spark, sf_dir).select("id", *[v.alias(k) for k, v in cells.items()])
    code = geom.octree_code(F.col("ix"), F.col("iy"), F.col("iz"), 6)
    x, y, z = geom.octree_cell(F.col("code"), 6)
    return d.withColumn("code", code).select("id", "code", x.alias("dx"), y.alias("dy"), z.alias("dz"))


def grid_id_round_trip(spark, sf_dir):
    v = stats.voxelize(pts(spark, sf_dir), cell_size=0.05)
    x, y, z = geom.cell_of(F.col("cell"))
    return v.select("id", "cell", x.alias("ix"), y.alias("iy"), z.alias("iz"))


def cell_neighbours(spark, sf_dir):
    """Faces and all neighbours of octree cells inside the cube."""
    c = octree_code(spark, sf_dir).select("code", "dx", "dy", "dz").distinct()
    inside = " and ".join(f"n{a} between 0 and 63" for a in "xyz")

    def count(faces):
        n = c.withColumn("o", F.explode(geom.offsets(1, faces))).select("code", *[(F.col(f"d{a}") + F.col(f"o.d{a}")).alias(f"n{a}") for a in "xyz"]).where(inside)
        return n.groupBy("code").agg(F.count("*").alias("faces" if faces else "around"))

    return count(True).join(count(False), "code")


def gaussian_kernel(spark, sf_dir):
    return pts(spark, sf_dir).select("id", F.round(geom.gauss(geom.norm(_at()), 0.5), 6).alias("w"))


def _edges(spark, sf_dir):
    from ..operators.spatial import radius_join

    p = pts(spark, sf_dir).select("id", "x", "y", "z")
    return radius_join(p, p, 0.15), p


def linearity(spark, sf_dir):
    e, p = _edges(spark, sf_dir)
    return _round(stats.linearity(e, p).select("id", "sigma", "k"), "sigma", digits=5)


def linearity_pca(spark, sf_dir):
    e, p = _edges(spark, sf_dir)
    return _round(stats.linearity(e, p, mode="pca").where("k > 3").select("id", "sigma", "k"), "sigma", digits=5)


def sigma_smooth(spark, sf_dir):
    p = pts(spark, sf_dir).select("id", "x", "y", "z")
    return _round(stats.smooth_within(stats.linearity_within(p, 0.15).select("id", "sigma"), p, 0.15, 0.3), "sigma", digits=5)


SCATTER = EDGES_SIGMA + ", s AS (SELECT src, sum(ux*ux) AS sxx, sum(ux*uy) AS sxy, sum(ux*uz) AS sxz, sum(uy*uy) AS syy, sum(uy*uz) AS syz, sum(uz*uz) AS szz, sum(ux) AS mx, sum(uy) AS my, sum(uz) AS mz, count(*) AS n FROM e GROUP BY src)"
SIGMA = (
    SCATTER
    + ", m AS (SELECT src, n, sxx-(sxx+sxy+sxz)/3 AS a1, sxy-(sxy+syy+syz)/3 AS a2, sxz-(sxz+syz+szz)/3 AS a3, sxy-(sxx+sxy+sxz)/3 AS b1, syy-(sxy+syy+syz)/3 AS b2, syz-(sxz+syz+szz)/3 AS b3, sxz-(sxx+sxy+sxz)/3 AS c1, syz-(sxy+syy+syz)/3 AS c2, szz-(sxz+syz+szz)/3 AS c3 FROM s)"
    ", c AS (SELECT src, n, (a1*a1+b1*b1+c1*c1)/2 AS xx, (a1*a2+b1*b2+c1*c2)/2 AS xy, (a1*a3+b1*b3+c1*c3)/2 AS xz, (a2*a2+b2*b2+c2*c2)/2 AS yy, (a2*a3+b2*b3+c2*c3)/2 AS yz, (a3*a3+b3*b3+c3*c3)/2 AS zz FROM m)"
    ", sig AS (SELECT src AS id, n AS k, coalesce((1 + sqrt(greatest(0.0, 2*(xx*xx+yy*yy+zz*zz+2*(xy*xy+xz*xz+yz*yz)) / nullif((xx+yy+zz)*(xx+yy+zz), 0) - 1))) / 2, 0.5) AS sigma FROM c)"
)
PCA = (
    SCATTER
    + ", c AS (SELECT src, n, sxx/n-mx*mx/(n*n) AS xx, sxy/n-mx*my/(n*n) AS xy, sxz/n-mx*mz/(n*n) AS xz, syy/n-my*my/(n*n) AS yy, syz/n-my*mz/(n*n) AS yz, szz/n-mz*mz/(n*n) AS zz FROM s WHERE n > 3)"
    ", q AS (SELECT *, (xx+yy+zz)/3 AS q, sqrt(((xx-(xx+yy+zz)/3)*(xx-(xx+yy+zz)/3)+(yy-(xx+yy+zz)/3)*(yy-(xx+yy+zz)/3)+(zz-(xx+yy+zz)/3)*(zz-(xx+yy+zz)/3)+2*(xy*xy+xz*xz+yz*yz))/6) AS p FROM c)"
    ", d AS (SELECT *, ((xx-q)*((yy-q)*(zz-q)-yz*yz)-xy*(xy*(zz-q)-yz*xz)+xz*(xy*yz-(yy-q)*xz))/(p*p*p) AS det FROM q)"
    " SELECT src AS id, round((q+2*p*cos(acos(greatest(-1.0, least(1.0, det/2)))/3))/(3*q), 5) AS sigma, n AS k FROM d"
)


def density(spark, sf_dir):
    p = pts(spark, sf_dir).select("id", "x", "y", "z")
    d = stats.density(p, 0.2)
    return d.select("id", F.round("rho", 6).alias("rho"), F.round(1.0 / F.col("rho"), 6).alias("inverse"), F.round(F.sqrt("rho"), 6).alias("root"))


def histogram_mode(spark, sf_dir):
    return _round(stats.histogram_mode(cloud_e(spark, sf_dir), "z"), "mode")


def _state(spark, sf_dir):
    e, p = _edges(spark, sf_dir)
    return p.join(stats.linearity(e, p), "id").withColumn("frozen", F.col("sigma") > 0.9)


def iteration_stats(spark, sf_dir):
    s = stats.iteration_stats(_state(spark, sf_dir))
    return _round(s, "mean_k", "active_mean_k", "sum_sigma", "mean_sigma", digits=4)


def polyline_length(spark, sf_dir):
    return _round(stats.polyline_length(cloud_e(spark, sf_dir), "user_id", ["x", "id"]), "length", digits=4)


def bounding_sphere(spark, sf_dir):
    return _round(stats.bounding_sphere(pts(spark, sf_dir), "label"), "cx", "cy", "cz", "radius")


def mean_of_smallest(spark, sf_dir):
    return _round(stats.mean_of_smallest(cloud_e(spark, sf_dir), "user_id", "z"), "mean")


def points_per_voxel(spark, sf_dir):
    n = stats.voxelize(pts(spark, sf_dir), cell_size=0.1).groupBy("cell").agg(F.count("*").alias("n"))
    return n.agg(F.round(F.sum("n") / F.count("*"), 6).alias("mean"))


def l1_median(spark, sf_dir):
    return _round(fit.l1_median(pts(spark, sf_dir), "label"), "x", "y", "z", digits=5)


def ols_line(spark, sf_dir):
    return _round(fit.line_fit(pts(spark, sf_dir), "label"), "slope", "intercept", digits=5)


def ols_plane(spark, sf_dir):
    return _round(fit.plane_fit(pts(spark, sf_dir), "label"), "a", "b", "c", digits=5)


def ols_quadratic(spark, sf_dir):
    return _round(fit.quadratic_fit(pts(spark, sf_dir), "label"), "a", "b", "c", digits=4)


def circle_fit(spark, sf_dir):
    return _round(fit.circle_fit(pts(spark, sf_dir), "label"), "cx", "cy", "r", digits=4)


def lvp_median(spark, sf_dir):
    return fit.lvp_median(pts(spark, sf_dir), "label")


def lvp_gradient(spark, sf_dir):
    """Whether the gradient of sum d + 30 sum (d - mean d)^2 is 0, for each label, at the centre found."""
    p = pts(spark, sf_dir)
    j = p.join(fit.lvp_median(p, "label").select("label", *[F.col(a).alias(f"c{a}") for a in "xyz"]), "label")
    d = F.sqrt(geom.squared("cx", "cy", "cz", "x", "y", "z"))
    unit = {a: (F.col(f"c{a}") - F.col(a)) / d for a in "xyz"}
    s = j.groupBy("label").agg(F.count("*").alias("n"), F.sum(d).alias("s"), *[F.sum(v).alias(f"u{a}") for a, v in unit.items()], *[F.sum(F.col(f"c{a}") - F.col(a)).alias(f"o{a}") for a in "xyz"])
    slope = [F.col(f"u{a}") + 60.0 * (F.col(f"o{a}") - F.col(f"u{a}") * F.col("s") / F.col("n")) for a in "xyz"]
    return s.select("label", "n", *[(F.abs(v) < 1e-6 * F.col("n")).alias(f"flat_{a}") for v, a in zip(slope, "xyz", strict=True)])


def local_weight_median(spark, sf_dir):
    return fit.weighted_local_median(pts(spark, sf_dir), "label")


def moving_least_squares(spark, sf_dir):
    from ..operators.spatial import knn

    p = pts(spark, sf_dir).select("id", "x", "y", "z")
    return _round(fit.moving_least_squares(p, knn(p, p, 13)), "x", "y", "z", digits=4)


def median_sql(cte: str, name: str, key: str, steps: int = 600) -> str:
    """A CTE ``med`` with the L1 medians of the groups of ``name``: the mean where the unit vectors from it cancel out, the member that
    balances the others, or else what over-relaxed Weiszfeld steps tend to."""
    off = "(p.x-m.mx)*(p.x-m.mx)+(p.y-m.my)*(p.y-m.my)+(p.z-m.mz)*(p.z-m.mz)"
    pull = ", ".join(f"sum((p.{a}-m.m{a})/nullif(sqrt({off}), 0)) AS g{a}" for a in "xyz")
    unit = ", ".join(f"coalesce(sum((b.{a}-a.{a})/nullif(sqrt({D2}), 0)), 0) AS g{a}" for a in "xyz")
    small = "sqrt(gx*gx+gy*gy+gz*gz) <= {c} + CAST('1e-11' AS DOUBLE)*n"
    step = ", ".join(f"any_value(m.m{a}) + 1.5*sum((p.{a}-m.m{a})/greatest(sqrt({off}), CAST('1e-13' AS DOUBLE)))/sum(1/greatest(sqrt({off}), CAST('1e-13' AS DOUBLE)))" for a in "xyz")
    return (
        f"WITH RECURSIVE {cte}, m0 AS (SELECT {key}, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM {name} GROUP BY {key})"
        f", c0 AS (SELECT {key}, any_value(n) AS n, any_value(mx) AS mx, any_value(my) AS my, any_value(mz) AS mz, count(*) FILTER ({off} = 0) AS here, {pull} FROM {name} p JOIN m0 m USING ({key}) GROUP BY {key})"
        f", even AS (SELECT {key}, mx, my, mz FROM c0 WHERE {small.format(c='here').replace('gx*gx+gy*gy+gz*gz', 'coalesce(gx*gx+gy*gy+gz*gz, 0)')})"
        f", b0 AS (SELECT a.{key}, a.x, a.y, a.z, count(*) AS n, count(*) FILTER ({D2} = 0) AS here, {unit} FROM {name} a JOIN {name} b USING ({key}) GROUP BY a.{key}, a.id, a.x, a.y, a.z)"
        f", vertex AS (SELECT {key}, min(x) AS mx, min(y) AS my, min(z) AS mz FROM b0 WHERE {small.format(c='here')} AND {key} NOT IN (SELECT {key} FROM even) GROUP BY {key})"
        f", fixed AS (SELECT * FROM even UNION ALL SELECT * FROM vertex)"
        f", free AS (SELECT * FROM {name} WHERE {key} NOT IN (SELECT {key} FROM fixed))"
        f", it(step, {key}, mx, my, mz) AS (SELECT 0, {key}, mx, my, mz FROM m0 WHERE {key} NOT IN (SELECT {key} FROM fixed) UNION ALL SELECT any_value(m.step) + 1, p.{key}, {step} FROM free p JOIN it m ON m.{key} = p.{key} WHERE m.step < {steps} GROUP BY p.{key})"
        f", med AS (SELECT * FROM fixed UNION ALL SELECT {key}, mx, my, mz FROM it WHERE step = {steps})"
    )


def _fit_cte(name: str, source: str, key: str, terms: list[str], target: str, out: list[str]) -> str:
    """A CTE with the coefficients of a least-squares fit of three terms for each key."""
    sums = ", ".join([f"sum({terms[i]}*{terms[j]}) AS m{i}{j}" for i in range(3) for j in range(i, 3)] + [f"sum({terms[i]}*{target}) AS v{i}" for i in range(3)])

    def det(m):
        return f"({m[0][0]}*({m[1][1]}*{m[2][2]}-{m[1][2]}*{m[2][1]})-{m[0][1]}*({m[1][0]}*{m[2][2]}-{m[1][2]}*{m[2][0]})+{m[0][2]}*({m[1][0]}*{m[2][1]}-{m[1][1]}*{m[2][0]}))"

    full = [[f"m{min(i, j)}{max(i, j)}" for j in range(3)] for i in range(3)]
    cols = ", ".join(f"{det([[f'v{i}' if j == c else full[i][j] for j in range(3)] for i in range(3)])}/{det(full)} AS {out[c]}" for c in range(3))
    return f"{name}_sums AS (SELECT {key}, {sums} FROM {source} GROUP BY {key}), {name} AS (SELECT {key}, {cols} FROM {name}_sums)"


def _solve_sql(cte: str, terms: list[str], target: str, out: list[str], select: str) -> str:
    return f"WITH {cte}, {_fit_cte('r', 'pts', 'label', terms, target, out)} {select}"


_MLS = f"""WITH {PTS}, nn AS (SELECT a.id AS src, b.x-a.x AS x, b.y-a.y AS y, b.z-a.z AS z FROM pts a JOIN pts b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) <= 13),
{_fit_cte("plane", "nn", "src", ["x", "y", "1.0"], "z", ["a", "b", "c"])},
n AS (SELECT src, -a/sqrt(a*a+b*b+1) AS nx, -b/sqrt(a*a+b*b+1) AS ny, 1/sqrt(a*a+b*b+1) AS nz FROM plane),
f AS (SELECT src, 1-nx*nx/(1+nz) AS ux, -nx*ny/(1+nz) AS uy, -nx AS uz, -nx*ny/(1+nz) AS vx, 1-ny*ny/(1+nz) AS vy, -ny AS vz FROM n),
flat AS (SELECT src, x*ux+y*uy+z*uz AS p, x*vx+y*vy+z*vz AS q FROM nn JOIN f USING (src)),
turn AS (SELECT src, atan(regr_slope(q, p)) AS t FROM flat GROUP BY src),
turned AS (SELECT src, p*cos(t)+q*sin(t) AS x, q*cos(t)-p*sin(t) AS y FROM flat JOIN turn USING (src)),
{_fit_cte("curve", "turned", "src", ["x*x", "x", "1.0"], "y", ["a", "b", "c"])}
SELECT id, {", ".join(f"round({a} + (u{a}*-sin(t) + v{a}*cos(t))*c, 4) AS {a}" for a in "xyz")} FROM pts JOIN f ON f.src = id JOIN turn ON turn.src = id JOIN curve ON curve.src = id"""


QUERIES = {
    f.__name__: f
    for f in (
        voxel_centroid, voxel_estimated, lineitem_voxels, bounding_box, plane_distance, point_line_distance, vector_algebra, osculating_frame, normalize,
        cardinal_spline, octree_code, grid_id_round_trip, cell_neighbours, gaussian_kernel, linearity, linearity_pca, sigma_smooth, density,
        histogram_mode, iteration_stats, polyline_length, bounding_sphere, mean_of_smallest, points_per_voxel, l1_median, ols_line,
        ols_plane, ols_quadratic, circle_fit, lvp_median, lvp_gradient, local_weight_median, moving_least_squares,
    )
}

_CENTROID = " SELECT cell, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM w GROUP BY cell"
_OCT = PTS + ", o AS (SELECT id, " + ", ".join(f"CAST(least(greatest(floor(({a} + 1.0) * 32.0), 0), 63) AS BIGINT) AS i{a}" for a in "xyz") + " FROM pts)"
_CODE = " + ".join(f"(((i{a} >> {5 - l}) & 1) << {3 * l + at})" for l in range(6) for a, at in (("x", 2), ("y", 1), ("z", 0)))
_SPLINE = ", ".join(
    f"round(CAST(CAST(p3*(-{s}*0.052734375+2*{s}*0.140625-{s}*0.375)+p2*((2-{s})*0.052734375+({s}-3)*0.140625+1)+p1*(({s}-2)*0.052734375+(3-2*{s})*0.140625+{s}*0.375)+z*({s}*0.052734375-{s}*0.140625) AS FLOAT) AS DOUBLE), 3) AS {n}"
    for s, n in (("CAST(0.45 AS DOUBLE)", "tree"), ("CAST(0.25 AS DOUBLE)", "bridge"))
)
_CROSS = {"x": "y*0.9 - z*(-0.2)", "y": "z*0.3 - x*0.9", "z": "x*(-0.2) - y*0.3"}

SQL = {
    "voxel_centroid": _voxel_sql(PTS, "pts", 0.1) + _CENTROID,
    "voxel_estimated": f"WITH {PTS}, nn AS (SELECT a.id, sqrt({D2}) AS dist FROM pts a JOIN pts b ON a.id <> b.id WHERE a.id % 10 = 0 OR (SELECT count(*) FROM pts) <= 1000 QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) <= 3), l AS (SELECT avg(dist) AS len FROM nn), box AS (SELECT " + ", ".join(f"min({a}) AS min_{a}, max({a}) AS max_{a}" for a in "xyz") + " FROM pts), v AS (SELECT pts.*, " + ", ".join(f"CAST(least(floor(({a} - (min_{a} - len)) / (2.5*len)), greatest(1, ceil((max_{a} - min_{a} + 2*len) / (2.5*len))) - 1) AS BIGINT) AS i{a}" for a in "xyz") + " FROM pts, box, l), w AS (SELECT *, iz * 1099511627776 + iy * 1048576 + ix AS cell FROM v)" + _CENTROID,
    "lineitem_voxels": _voxel_sql(CLOUD_L, "cl", 5.0) + _CENTROID.replace(", 6)", ", 4)"),
    "bounding_box": f"WITH {PTS}, b AS (SELECT " + ", ".join(f"min({a}) AS lo{a}, max({a}) AS hi{a}" for a in "xyz") + ", count(*) AS n FROM pts) SELECT " + ", ".join(f"round(lo{a}, 6) AS min_{a}, round(hi{a}, 6) AS max_{a}, round((lo{a}+hi{a})/2, 6) AS center_{a}, round((hi{a}-lo{a})/2, 6) AS half_{a}" for a in "xyz") + ", n, round(sqrt((hix-lox)*(hix-lox)+(hiy-loy)*(hiy-loy)+(hiz-loz)*(hiz-loz)), 6) AS diagonal FROM b",
    "plane_distance": f"WITH {PTS} SELECT id, round(abs(x + 2*y - 0.5*z - (0.1 - 0.5*0.2)) / sqrt(CAST(1+4+0.25 AS DOUBLE)), 6) AS dist, CAST(0 AS DOUBLE) AS degenerate FROM pts",
    "point_line_distance": f"WITH {PTS}, d AS (SELECT id, -x AS px, 0.1-y AS py, -z AS pz FROM pts) SELECT id, round(sqrt((0.4*pz-(-0.3)*py)*(0.4*pz-(-0.3)*py)+((-0.3)*px-1.0*pz)*((-0.3)*px-1.0*pz)+(1.0*py-0.4*px)*(1.0*py-0.4*px))/sqrt(CAST(1+0.16+0.09 AS DOUBLE)), 6) AS dist FROM d",
    "vector_algebra": f"WITH {PTS}, c AS (SELECT *, greatest(-1.0, least(1.0, (x*0.3-y*0.2+z*0.9)/(sqrt(x*x+y*y+z*z)*sqrt(CAST(0.94 AS DOUBLE))))) AS c FROM pts) SELECT id, round(sqrt((x-0.3)*(x-0.3)+(y+0.2)*(y+0.2)+(z-0.9)*(z-0.9)), 6) AS dist, round(sqrt(x*x+y*y+z*z), 6) AS size, " + ", ".join(f"round({e}, 6) AS c{a}" for a, e in _CROSS.items()) + ", round(0.3-x, 6) AS mx, round(x+0.3, 6) AS sx, round(x/4, 6) AS qx, round(c, 6) AS cosine, round(sqrt(greatest(0.0, 1-c*c)), 6) AS sine, round(x+y+z-greatest(x,y,z)-least(x,y,z), 6) AS mid, round(greatest(x,y,z), 6) AS top, round(least(x,y,z), 6) AS low FROM c",
    "osculating_frame": f"WITH {PTS} SELECT id, round(((0.5-x)*x+(-0.25-y)*y+(1.0-z)*z)/sqrt(x*x+y*y+z*z), 6) AS height, round(sqrt((0.5-x)*(0.5-x)+(-0.25-y)*(-0.25-y)+(1.0-z)*(1.0-z)), 6) AS dist, CAST(0.5 AS DOUBLE) AS bx, CAST(-0.25 AS DOUBLE) AS by, CAST(1 AS DOUBLE) AS bz FROM pts WHERE x*x+y*y+z*z > 0",
    "normalize": f"WITH {CLOUD_E}, b AS (SELECT " + ", ".join(f"min({a}) AS lo{a}, max({a}) AS hi{a}" for a in "xyz") + " FROM ce) SELECT id, " + ", ".join(f"round(({a}-(lo{a}+hi{a})/2)/greatest(CAST('1e-7' AS DOUBLE), greatest(hix-lox, hiy-loy, hiz-loz)), 6) AS {a}" for a in "xyz") + " FROM ce, b",
    "cardinal_spline": f"WITH {CLOUD_E}, q AS (SELECT id, z, lag(z, 3) OVER w AS p3, lag(z, 2) OVER w AS p2, lag(z, 1) OVER w AS p1 FROM ce WINDOW w AS (PARTITION BY user_id ORDER BY x, id)) SELECT id, {_SPLINE} FROM q WHERE p3 IS NOT NULL",
    "octree_code": f"WITH {_OCT} SELECT id, {_CODE} AS code, ix AS dx, iy AS dy, iz AS dz FROM o",
    "grid_id_round_trip": _voxel_sql(PTS, "pts", 0.05) + " SELECT id, cell, ix, iy, iz FROM w",
    "cell_neighbours": f"WITH {_OCT}, c AS (SELECT DISTINCT {_CODE} AS code, ix, iy, iz FROM o), s AS (SELECT code, " + ", ".join(f"CASE WHEN i{a} > 0 THEN 1 ELSE 0 END AS l{a}, CASE WHEN i{a} < 63 THEN 1 ELSE 0 END AS h{a}" for a in "xyz") + " FROM c) SELECT code, CAST(lx+hx+ly+hy+lz+hz AS BIGINT) AS faces, CAST((1+lx+hx)*(1+ly+hy)*(1+lz+hz)-1 AS BIGINT) AS around FROM s",
    "gaussian_kernel": f"WITH {PTS} SELECT id, round(exp(-4.0*(x*x+y*y+z*z)/0.25), 6) AS w FROM pts",
    "linearity": f"WITH {SIGMA} SELECT id, round(sigma, 5) AS sigma, k FROM sig",
    "linearity_pca": f"WITH {PCA}",
    "sigma_smooth": f"WITH {SIGMA}, w AS (SELECT e.src AS id, sum(exp(-16.0*dist*dist/(0.3*0.3))*g.sigma) AS a, sum(exp(-16.0*dist*dist/(0.3*0.3))) AS b FROM e JOIN sig g ON g.id = e.dst WHERE e.src <> e.dst GROUP BY e.src) SELECT sig.id, round((sig.sigma + coalesce(a, 0)) / (1 + coalesce(b, 0)), 5) AS sigma FROM sig LEFT JOIN w ON w.id = sig.id",
    "density": f"WITH {PTS}, s AS (SELECT a.id, 1 + coalesce(sum(CASE WHEN a.id <> b.id THEN exp(-4.0*({D2})/(0.2*0.2)) END), 0) AS rho FROM pts a JOIN pts b ON {D2} < 0.2*0.2 GROUP BY a.id) SELECT id, round(rho, 6) AS rho, round(1/rho, 6) AS inverse, round(sqrt(rho), 6) AS root FROM s",
    "histogram_mode": f"WITH {CLOUD_E}, v AS (SELECT DISTINCT z FROM ce), r AS (SELECT min(z) AS a, (max(z)-min(z))/13 AS w FROM v), h AS (SELECT CAST(least(floor((z-a)/w), 12) AS BIGINT) AS bin, any_value(a) AS a, any_value(w) AS w, count(*) AS n FROM v, r GROUP BY 1) SELECT round(a+(bin+0.5)*w, 6) AS mode FROM h ORDER BY n DESC, bin LIMIT 1",
    "iteration_stats": f"WITH {SIGMA}, t AS (SELECT *, sigma > 0.9 AS frozen FROM sig) SELECT round(avg(k), 4) AS mean_k, max(k) AS max_k, min(k) AS min_k, round(avg(k) FILTER (NOT frozen), 4) AS active_mean_k, max(k) FILTER (NOT frozen) AS active_max_k, min(k) FILTER (NOT frozen) AS active_min_k, round(sum(sigma), 4) AS sum_sigma, round(avg(sigma), 4) AS mean_sigma, count(*) FILTER (frozen) AS frozen_count, count(*) AS n FROM t",
    "polyline_length": f"WITH {CLOUD_E}, q AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM ce WINDOW w AS (PARTITION BY user_id ORDER BY x, id)) SELECT user_id, round(coalesce(sum(sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz))), 0), 4) AS length, count(*) AS n FROM q GROUP BY user_id",
    "bounding_sphere": f"WITH {PTS}, e AS (SELECT label, " + ", ".join(f"arg_min(struct_pack(x := x, y := y, z := z), struct_pack(v := {a}, i := id)) AS lo{a}, arg_max(struct_pack(x := x, y := y, z := z), struct_pack(v := {a}, i := id)) AS hi{a}" for a in "xyz") + " FROM pts GROUP BY label), d AS (" + " UNION ALL ".join(f"SELECT label, {i} AS i, lo{a} AS a, hi{a} AS b, sqrt((lo{a}.x-hi{a}.x)*(lo{a}.x-hi{a}.x)+(lo{a}.y-hi{a}.y)*(lo{a}.y-hi{a}.y)+(lo{a}.z-hi{a}.z)*(lo{a}.z-hi{a}.z)) AS d FROM e" for i, a in enumerate("zyx")) + "), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d DESC, i DESC) AS k FROM d) SELECT label, " + ", ".join(f"round((a.{c}+b.{c})/2, 6) AS c{c}" for c in "xyz") + ", round(d/2, 6) AS radius FROM r WHERE k = 1",
    "mean_of_smallest": f"WITH {CLOUD_E}, q AS (SELECT user_id, z, row_number() OVER (PARTITION BY user_id ORDER BY z) AS n FROM ce) SELECT user_id, round(avg(z), 6) AS mean FROM q WHERE n <= 25 GROUP BY user_id",
    "points_per_voxel": _voxel_sql(PTS, "pts", 0.1) + " SELECT round(count(*) / CAST(count(DISTINCT cell) AS DOUBLE), 6) AS mean FROM w",
    "lvp_gradient": "SELECT label, count(*) AS n, true AS flat_x, true AS flat_y, true AS flat_z FROM embeddings GROUP BY label",
    "l1_median": median_sql(PTS, "pts", "label") + " SELECT label, round(mx, 5) AS x, round(my, 5) AS y, round(mz, 5) AS z FROM med",
    "moving_least_squares": _MLS,
    "ols_line": f"WITH {PTS} SELECT label, round(regr_slope(y, x), 5) AS slope, round(regr_intercept(y, x), 5) AS intercept FROM pts GROUP BY label",
    "ols_plane": _solve_sql(PTS, ["x", "y", "1.0"], "z", ["a", "b", "c"], "SELECT label, round(a, 5) AS a, round(b, 5) AS b, round(c, 5) AS c FROM r"),
    "ols_quadratic": _solve_sql(PTS, ["x*x", "x", "1.0"], "y", ["a", "b", "c"], "SELECT label, round(a, 4) AS a, round(b, 4) AS b, round(c, 4) AS c FROM r"),
    "circle_fit": _solve_sql(PTS, ["x", "y", "1.0"], "(x*x+y*y)", ["a", "b", "c"], "SELECT label, round(a/2, 4) AS cx, round(b/2, 4) AS cy, round(sqrt(greatest(0.0, c+a*a/4+b*b/4)), 4) AS r FROM r"),
}
