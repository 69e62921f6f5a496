"""Surfaces and pieces of volume meshes: contours, slices and clips of cells of any shape, by their tetrahedra; gradients of cells and points.

A tetrahedron's corners are sorted by their values, which leaves three cases for a level between
them; no case table is needed. Hexahedra with a column parity meet in the same triangles, so
surfaces have no cracks. Corners are joined by merging: Spark takes rows for as few as they
were before an explode, and would broadcast all corners of a large mesh.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.mesh import TETRAS, Point, cross, dot, minus, plus, tetrahedralize, unit


def tetras_with_values(cells: DataFrame, points: DataFrame, value: Column) -> DataFrame:
    """cell, part, s: the corners of each tetrahedron as structs (f, id, x, y, z), by ascending value."""
    parts = tetrahedralize(cells).select("cell", F.monotonically_increasing_id().alias("part"), F.array("a", "b", "c", "d").alias("ids"))
    flat = parts.select("cell", "part", F.explode("ids").alias("id")).join(points.select("id", value.cast("double").alias("f"), "x", "y", "z").hint("merge"), "id")
    return flat.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("f", "id", "x", "y", "z"))).alias("s"))  # four corners


def _at(k: int, level: float) -> Column:
    """Whether corner k is at the level or above it."""
    return F.col("s")[k]["f"] >= level


def _corner(k: int) -> Column:
    c = F.col("s")[k]
    return F.struct(c["x"].alias("x"), c["y"].alias("y"), c["z"].alias("z"), c["id"].alias("a"), c["id"].alias("b"))


def _crossing(i: int, j: int, level: float) -> Column:
    """Where the level crosses the edge between two corners, with the ids of the edge's ends."""
    p, q = F.col("s")[i], F.col("s")[j]
    t = F.try_divide(level - p["f"], q["f"] - p["f"])
    return F.struct(*((p[c] + t * (q[c] - p[c])).alias(c) for c in "xyz"), F.least(p["id"], q["id"]).alias("a"), F.greatest(p["id"], q["id"]).alias("b"))


def _xyz(c: Column) -> Point:
    return c["x"], c["y"], c["z"]


def contour_surface(cells: DataFrame, points: DataFrame, value: Column, levels: list[float]) -> DataFrame:
    """level, cell, part, polygon: three or four points (x, y, z, and the mesh edge a-b they lie on), turned so that values rise along the normal."""
    tetras = tetras_with_values(cells, points, value)
    out = None
    for level in levels:
        below = sum((F.when(_at(k, level), 0).otherwise(1) for k in range(1, 4)), F.when(_at(0, level), 0).otherwise(1))
        cut = lambda *pairs: F.array(*(_crossing(i, j, level) for i, j in pairs))  # noqa: B023, E731
        polygon = F.when(below == 1, cut((0, 1), (0, 2), (0, 3))).when(below == 2, cut((0, 2), (0, 3), (1, 3), (1, 2))).when(below == 3, cut((0, 3), (1, 3), (2, 3)))
        rows = tetras.where(below.between(1, 3)).select(F.lit(level).alias("level"), "cell", "part", polygon.alias("p"), "s")
        p, s = F.col("p"), F.col("s")
        n = cross(minus(_xyz(p[1]), _xyz(p[0])), minus(_xyz(p[2]), _xyz(p[0])))
        rising = dot(n, minus(_xyz(s[3]), _xyz(s[0]))) >= 0
        rows = rows.select("level", "cell", "part", F.when(rising, p).otherwise(F.reverse(p)).alias("polygon"))
        out = rows if out is None else out.unionByName(rows)
    return out


def surface_triangles(surface: DataFrame) -> DataFrame:
    """level, cell, part, a, b, c (points) and normal: polygons as fans."""
    p = F.col("polygon")
    fan = surface.select("level", "cell", "part", "polygon", F.explode(F.sequence(F.lit(1), F.size(p) - 2)).alias("k"))
    rows = fan.select("level", "cell", "part", F.get(p, F.lit(0)).alias("a"), F.get(p, F.col("k")).alias("b"), F.get(p, F.col("k") + 1).alias("c"))
    n = unit(cross(minus(_xyz(F.col("b")), _xyz(F.col("a"))), minus(_xyz(F.col("c")), _xyz(F.col("a")))))
    return rows.withColumn("normal", F.struct(*(v.alias(k) for v, k in zip(n, "xyz"))))


def merged_points(triangles: DataFrame) -> DataFrame:
    """One row for each mesh edge that the surface crosses: a, b, x, y, z and the mean unit normal of the triangles there."""
    each = triangles.select("normal", F.explode(F.array("a", "b", "c")).alias("p"))
    own = each.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(*(F.min(f"p.{c}").alias(c) for c in "xyz"), *(F.avg(f"normal.{c}").alias(f"n{c}") for c in "xyz"))
    n = unit((F.col("nx"), F.col("ny"), F.col("nz")))
    return own.select("a", "b", "x", "y", "z", *(v.alias(f"n{c}") for v, c in zip(n, "xyz")))


def slice_surface(cells: DataFrame, points: DataFrame, functions: list[Callable[[Column, Column, Column], Column]]) -> DataFrame:
    """contour_surface at 0 of each implicit function of x, y, z, numbered as level."""
    out = None
    for k, f in enumerate(functions):
        rows = contour_surface(cells, points, f(F.col("x"), F.col("y"), F.col("z")), [0.0]).withColumn("level", F.lit(float(k)))
        out = rows if out is None else out.unionByName(rows)
    return out


def clip(cells: DataFrame, points: DataFrame, value: Column, level: float, invert: bool = False) -> DataFrame:
    """cell, part, piece, p: tetrahedra (four points with the mesh edges they lie on) that fill the part of each cell where the field
    is at least the level (below it, if inverted), all of positive volume."""
    if invert:
        value, level = -value, -level
    tetras = tetras_with_values(cells, points, value)
    below = sum((F.when(_at(k, level), 0).otherwise(1) for k in range(1, 4)), F.when(_at(0, level), 0).otherwise(1))
    wedge = lambda six: F.array(*(F.array(*(six[k] for k in t)) for t in TETRAS["wedge"]))
    x = lambda i, j: _crossing(i, j, level)
    pieces = (
        F.when(below == 0, F.array(F.array(*map(_corner, range(4)))))
        .when(below == 1, wedge([x(0, 1), x(0, 2), x(0, 3), _corner(1), _corner(2), _corner(3)]))
        .when(below == 2, wedge([_corner(2), x(0, 2), x(1, 2), _corner(3), x(0, 3), x(1, 3)]))
        .when(below == 3, F.array(F.array(_corner(3), x(0, 3), x(1, 3), x(2, 3))))
    )
    rows = tetras.select("cell", "part", F.posexplode(pieces).alias("piece", "p"))
    p = F.col("p")
    q = [_xyz(p[k]) for k in range(4)]
    volume = dot(cross(minus(q[1], q[0]), minus(q[2], q[0])), minus(q[3], q[0])) / 6
    rows = rows.withColumn("v", volume).where("v != 0")
    return rows.select("cell", "part", "piece", F.when(F.col("v") > 0, p).otherwise(F.array(p[0], p[2], p[1], p[3])).alias("p"), F.abs("v").alias("volume"))


def clip_by_function(cells: DataFrame, points: DataFrame, function: Callable[[Column, Column, Column], Column], invert: bool = False) -> DataFrame:
    """What lies outside an implicit surface, or inside it."""
    return clip(cells, points, function(F.col("x"), F.col("y"), F.col("z")), 0.0, invert)


def cell_gradient(cells: DataFrame, points: DataFrame, field: str) -> DataFrame:
    """cell, gx, gy, gz: the volume-weighted mean over a cell's tetrahedra of the gradient of the field, linear in each."""
    parts = tetrahedralize(cells).select("cell", F.monotonically_increasing_id().alias("part"), F.array("a", "b", "c", "d").alias("ids"))
    flat = parts.select("cell", "part", F.posexplode("ids").alias("k", "id")).join(points.select("id", "x", "y", "z", F.col(field).cast("double").alias("f")).hint("merge"), "id")
    own = flat.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y", "z", "f"))).alias("s"))  # four corners
    s = F.col("s")
    u, v, w = (minus(_xyz(s[k]), _xyz(s[0])) for k in (1, 2, 3))
    rows = own.select("cell", *(c.alias(n) for e, m in ((u, "u"), (v, "v"), (w, "w")) for c, n in zip(e, (f"{m}x", f"{m}y", f"{m}z"))), *((s[k]["f"] - s[0]["f"]).alias(f"d{k}") for k in (1, 2, 3)))
    u, v, w = ((F.col(f"{m}x"), F.col(f"{m}y"), F.col(f"{m}z")) for m in "uvw")
    # Each gradient is the sum of differences times a cross product, over the determinant, which is also the weight.
    total = plus(*(tuple(F.col(f"d{k}") * c for c in cross(a, b)) for k, (a, b) in ((1, (v, w)), (2, (w, u)), (3, (u, v)))))
    det = dot(u, cross(v, w))
    rows = rows.select("cell", *(c.alias(f"g{a}") for c, a in zip(total, "xyz")), det.alias("det"))
    return rows.groupBy("cell").agg(*(F.try_divide(F.sum(f"g{a}"), F.sum("det")).alias(f"g{a}") for a in "xyz"))


def point_gradient(cells: DataFrame, points: DataFrame, field: str) -> DataFrame:
    """id, gx, gy, gz: the mean gradient of the cells around each point."""
    each = cells.select("cell", F.explode("conn").alias("id")).join(cell_gradient(cells, points, field).hint("merge"), "cell")
    return each.groupBy("id").agg(*(F.avg(f"g{a}").alias(f"g{a}") for a in "xyz"))


def interpolate(cells: DataFrame, points: DataFrame, fields: list[str], where: DataFrame) -> DataFrame:
    """id, cell and the fields at points (id, x, y, z) inside cells, by barycentric weights in their tetrahedra; a point on a shared face belongs to the least cell.

    Tetrahedra are spread over bins as wide as the largest of them, so each touches two to an axis at most.
    """
    parts = tetrahedralize(cells).select("cell", F.monotonically_increasing_id().alias("part"), F.array("a", "b", "c", "d").alias("ids"))
    flat = parts.select("cell", "part", F.posexplode("ids").alias("k", "pid")).join(points.select(F.col("id").alias("pid"), "x", "y", "z", *fields).hint("merge"), "pid")
    tetra = flat.groupBy("cell", "part").agg(F.sort_array(F.collect_list(F.struct("k", "x", "y", "z", *fields))).alias("s"), *(f(c).alias(f"{n}_{c}") for c in "xyz" for f, n in ((F.min, "lo"), (F.max, "hi"))))
    widest = tetra.agg(F.max(F.greatest(*(F.col(f"hi_{c}") - F.col(f"lo_{c}") for c in "xyz"))).alias("width"))  # one row
    tetra = tetra.crossJoin(F.broadcast(widest))
    for c in "xyz":
        tetra = tetra.withColumn(f"b{c}", F.explode(F.sequence(F.floor(F.col(f"lo_{c}") / F.col("width")), F.floor(F.col(f"hi_{c}") / F.col("width")))))
    asked = where.select("id", *(F.col(c).alias(f"q{c}") for c in "xyz")).crossJoin(F.broadcast(widest))
    asked = asked.select("id", "qx", "qy", "qz", *(F.floor(F.col(f"q{c}") / F.col("width")).alias(f"b{c}") for c in "xyz"))
    slack = F.col("width") * 1e-6  # more than the weights' tolerance
    near = [F.col(f"q{c}").between(F.col(f"lo_{c}") - slack, F.col(f"hi_{c}") + slack) for c in "xyz"]
    rows = asked.join(tetra, ["bx", "by", "bz"]).where(near[0] & near[1] & near[2])
    s, q = F.col("s"), (F.col("qx"), F.col("qy"), F.col("qz"))
    e = [minus(_xyz(s[k]), _xyz(s[0])) for k in (1, 2, 3)]
    d = minus(q, _xyz(s[0]))
    det = dot(e[0], cross(e[1], e[2]))
    weights = [F.try_divide(dot(d, cross(e[1], e[2])), det), F.try_divide(dot(d, cross(e[2], e[0])), det), F.try_divide(dot(d, cross(e[0], e[1])), det)]
    rows = rows.select("id", "cell", "s", *(w.alias(f"w{k}") for k, w in enumerate(weights, 1))).withColumn("w0", 1 - F.col("w1") - F.col("w2") - F.col("w3"))
    rows = rows.where("w0 >= -1e-9 AND w1 >= -1e-9 AND w2 >= -1e-9 AND w3 >= -1e-9")
    values = [sum((F.col(f"w{k}") * s[k][f] for k in (1, 2, 3)), F.col("w0") * s[0][f]).alias(f) for f in fields]
    best = rows.select("id", "cell", *values).groupBy("id").agg(F.min_by(F.struct(*fields), "cell").alias("v"), F.min("cell").alias("cell"))
    return best.select("id", "cell", *(F.col(f"v.{f}").alias(f) for f in fields))
