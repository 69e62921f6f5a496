"""Quality of triangles, quadrilaterals, tetrahedra and hexahedra.

A metric is a function of a Stage and the corners. What a formula uses several times is a
column of an earlier projection (Stage.let), so that generated code grows with the number of
terms rather than with their powers. Degenerate cells get what the definitions say: infinity
for cells without a positive determinant, axis or diagonal.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.mesh import EDGES, HEX_CORNERS, Point, corners, cross, dot, measure, minus, norm, plus, tetra_volume, triangle_area

INFINITY = float("inf")
Frame = tuple[Point, Point, Point]


class Stage:
    """Rows to which columns are added, projection by projection."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows, self.n = rows, 0

    def let(self, *values: Column) -> list[Column]:
        names = [f"_q{self.n + k}" for k in range(len(values))]
        self.n += len(values)
        self.rows = self.rows.withColumns(dict(zip(names, values)))
        return [F.col(x) for x in names]

    def vectors(self, *values: Point) -> list[Point]:
        flat = self.let(*(c for v in values for c in v))
        return [tuple(flat[k : k + 3]) for k in range(0, len(flat), 3)]


def divide(a: Column | float, b: Column) -> Column:
    """As floating-point hardware does: infinity, or no number, by zero."""
    a = a if isinstance(a, Column) else F.lit(float(a))
    return F.when(b != 0, a / b).when(a > 0, INFINITY).when(a < 0, -INFINITY).when(a == 0, float("nan"))


def least(xs: Sequence[Column]) -> Column:
    return F.least(*xs) if len(xs) > 1 else xs[0]


def greatest(xs: Sequence[Column]) -> Column:
    return F.greatest(*xs) if len(xs) > 1 else xs[0]


def unless(bad: Column, worst: float, value: Column) -> Column:
    return F.when(bad, worst).otherwise(value)


def sides(s: Stage, q: list[Point]) -> list[Point]:
    return s.vectors(*(minus(q[(k + 1) % len(q)], q[k]) for k in range(len(q))))


def angles(s: Stage, q: list[Point]) -> tuple[list[Column], Column]:
    """Degrees at the corners, and whether a side has no length."""
    e = sides(s, q)
    n = s.let(*(norm(v) for v in e))
    cosines = s.let(*(divide(-dot(e[k - 1], e[k]), n[k - 1] * n[k]) for k in range(len(q))))
    return [F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))) for c in cosines], least(n) <= 0


def max_angle(s: Stage, q: list[Point]) -> Column:
    found, flat = angles(s, q)
    return unless(flat, 0.0, greatest(found))


def min_angle(s: Stage, q: list[Point]) -> Column:
    found, flat = angles(s, q)
    return unless(flat, 0.0, least(found))


def triangle_aspect_ratio(s: Stage, q: list[Point]) -> Column:
    """Longest side over 2 sqrt(3) inradii."""
    n = s.let(*(norm(v) for v in sides(s, q)))
    (area,) = s.let(triangle_area(*q))
    return divide(greatest(n) * (n[0] + n[1] + n[2]), 4 * math.sqrt(3) * area)


def triangle_condition(s: Stage, q: list[Point]) -> Column:
    u, v = s.vectors(minus(q[1], q[0]), minus(q[2], q[0]))
    (area,) = s.let(triangle_area(*q))
    return unless(area == 0, INFINITY, divide(dot(u, u) + dot(v, v) - dot(u, v), 2 * math.sqrt(3) * area))


def triangle_shape(s: Stage, q: list[Point]) -> Column:
    (condition,) = s.let(triangle_condition(s, q))
    return divide(1.0, condition)


def triangle_scaled_jacobian(s: Stage, q: list[Point]) -> Column:
    a, b, c = s.let(*(norm(v) for v in sides(s, q)))
    most, area = s.let(F.greatest(a * b, b * c, c * a), triangle_area(*q))
    return unless(most <= 0, 0.0, divide(4 / math.sqrt(3) * area, most))


def quad_axes(s: Stage, q: list[Point]) -> tuple[Point, Point]:
    return tuple(s.vectors(plus(minus(q[1], q[0]), minus(q[2], q[3])), plus(minus(q[2], q[1]), minus(q[3], q[0]))))


def corner_areas(s: Stage, q: list[Point]) -> tuple[list[Point], list[Column]]:
    """Sides, and the area vector at each corner along the normal at the centre."""
    e = sides(s, q)
    (centre,) = s.vectors(cross(*quad_axes(s, q)))
    (n,) = s.let(norm(centre))
    return e, s.let(*(divide(dot(cross(e[k - 1], e[k]), centre), n) for k in range(4)))


def quad_area(s: Stage, q: list[Point]) -> Column:
    a = corner_areas(s, q)[1]
    return (a[0] + a[1] + a[2] + a[3]) / 4


def quad_jacobian(s: Stage, q: list[Point]) -> Column:
    return least(corner_areas(s, q)[1])


def quad_scaled_jacobian(s: Stage, q: list[Point]) -> Column:
    e, a = corner_areas(s, q)
    n = s.let(*(norm(v) for v in e))
    return least([divide(a[k], n[k - 1] * n[k]) for k in range(4)])


def quad_condition(s: Stage, q: list[Point]) -> Column:
    e, a = corner_areas(s, q)
    squares = s.let(*(dot(v, v) for v in e))
    return greatest([divide(squares[k - 1] + squares[k], a[k]) for k in range(4)]) / 2


def quad_shape(s: Stage, q: list[Point]) -> Column:
    e, a = corner_areas(s, q)
    squares = s.let(*(dot(v, v) for v in e))
    return 2 * least([divide(a[k], squares[k - 1] + squares[k]) for k in range(4)])


def ratio_of_axes(n: list[Column]) -> Column:
    return unless(least(n) <= 0, INFINITY, greatest([divide(a, b) for a in n for b in n if a is not b]))


def quad_aspect_ratio(s: Stage, q: list[Point]) -> Column:
    """The longer principal axis over the shorter."""
    return ratio_of_axes(s.let(*(norm(v) for v in quad_axes(s, q))))


def quad_stretch(s: Stage, q: list[Point]) -> Column:
    n = s.let(*(norm(v) for v in sides(s, q)), norm(minus(q[2], q[0])), norm(minus(q[3], q[1])))
    return unless(greatest(n[4:]) <= 0, INFINITY, divide(math.sqrt(2) * least(n[:4]), greatest(n[4:])))


def quad_skew(s: Stage, q: list[Point]) -> Column:
    u, v = quad_axes(s, q)
    a, b = s.let(norm(u), norm(v))
    return unless(F.least(a, b) <= 0, 0.0, F.abs(divide(dot(u, v), a * b)))


def quad_taper(s: Stage, q: list[Point]) -> Column:
    u, v = quad_axes(s, q)
    across, a, b = s.let(norm(plus(minus(q[0], q[1]), minus(q[2], q[3]))), norm(u), norm(v))
    return unless(F.least(a, b) <= 0, INFINITY, divide(across, F.least(a, b)))


def diagonal_ratio(s: Stage, diagonals: list[Column]) -> Column:
    d = s.let(*diagonals)
    return unless(greatest(d) <= 0, INFINITY, divide(least(d), greatest(d)))


def quad_diagonal_ratio(s: Stage, q: list[Point]) -> Column:
    return diagonal_ratio(s, [norm(minus(q[2], q[0])), norm(minus(q[3], q[1]))])


def quad_normals(s: Stage, q: list[Point]) -> list[Point]:
    e = sides(s, q)
    return s.vectors(*(cross(e[k - 1], e[k]) for k in range(4)))


def quad_warpage(s: Stage, q: list[Point]) -> Column:
    n = quad_normals(s, q)
    long = s.let(*(norm(v) for v in n))
    both = s.let(*(divide(dot(n[k], n[k + 2]), long[k] * long[k + 2]) for k in range(2)))
    (lesser,) = s.let(least(both))
    return lesser * lesser * lesser


def quad_oddy(s: Stage, q: list[Point]) -> Column:
    e, n = sides(s, q), quad_normals(s, q)
    across = s.let(*(dot(v, v) for v in n))
    own = s.let(*(dot(v, v) for v in e))
    both = s.let(*(dot(e[k - 1], e[k]) for k in range(4)))
    worst = [divide((own[k - 1] - own[k]) * (own[k - 1] - own[k]) + 4 * both[k] * both[k], 2 * across[k]) for k in range(4)]
    return unless(least(across) <= 0, INFINITY, greatest(worst))


def tetra_edges(s: Stage, q: list[Point]) -> list[Column]:
    return s.let(*(norm(minus(q[b], q[a])) for a, b in EDGES["tetra"]))


def tetra_aspect_gamma(s: Stage, q: list[Point]) -> Column:
    n = tetra_edges(s, q)
    rms, volume = s.let(F.sqrt(sum((x * x for x in n[1:]), n[0] * n[0]) / 6), F.abs(tetra_volume(*q)))
    return unless(volume <= 0, INFINITY, divide(math.sqrt(2) / 12 * rms * rms * rms, volume))


def tetra_aspect_ratio(s: Stage, q: list[Point]) -> Column:
    """Longest edge over 2 sqrt(6) inradii."""
    n = tetra_edges(s, q)
    surface, volume = s.let(triangle_area(q[0], q[1], q[2]) + triangle_area(q[0], q[1], q[3]) + triangle_area(q[1], q[2], q[3]) + triangle_area(q[0], q[2], q[3]), F.abs(tetra_volume(*q)))
    return divide(greatest(n) * surface, 6 * math.sqrt(6) * volume)


def tetra_jacobian(s: Stage, q: list[Point]) -> Column:
    return 6 * tetra_volume(*q)


def tetra_scaled_jacobian(s: Stage, q: list[Point]) -> Column:
    n = dict(zip(map(frozenset, EDGES["tetra"]), tetra_edges(s, q)))
    at = [n[frozenset((k, x))] * n[frozenset((k, y))] * n[frozenset((k, z))] for k, x, y, z in ((0, 1, 2, 3), (1, 0, 2, 3), (2, 0, 1, 3), (3, 0, 1, 2))]
    (jacobian,) = s.let(6 * tetra_volume(*q))
    return divide(math.sqrt(2) * jacobian, F.greatest(*at, jacobian))


def triple(a: Point, b: Point, c: Point) -> Column:
    return dot(cross(a, b), c)


def regular_frame(s: Stage, q: list[Point]) -> Frame:
    """Edge vectors relative to those of a regular tetrahedron."""
    u, v, w = s.vectors(*(minus(q[k], q[0]) for k in (1, 2, 3)))
    second = tuple((2 * b - a) / math.sqrt(3) for a, b in zip(u, v))
    third = tuple((3 * c - b - a) / math.sqrt(6) for a, b, c in zip(u, v, w))
    return tuple(s.vectors(u, second, third))


def conditions(s: Stage, frames: list[Frame]) -> Column:
    """The greatest Frobenius condition number of the frames, over 3; infinity if a determinant isn't positive."""
    d = s.let(*(triple(*f) for f in frames))
    squares = s.let(*(dot(a, a) + dot(b, b) + dot(c, c) for a, b, c in frames))
    minors = s.vectors(*(v for a, b, c in frames for v in (cross(a, b), cross(b, c), cross(c, a))))
    turned = s.let(*(sum((dot(v, v) for v in minors[3 * k + 1 : 3 * k + 3]), dot(minors[3 * k], minors[3 * k])) for k in range(len(frames))))
    return unless(least(d) <= 0, INFINITY, greatest([divide(F.sqrt(a * b), 3 * x) for a, b, x in zip(squares, turned, d)]))


def shapes(s: Stage, frames: list[Frame]) -> Column:
    """The least of 3 determinants ^ (2/3) over the squared lengths; 0 if one isn't positive."""
    d = s.let(*(triple(*f) for f in frames))
    squares = s.let(*(dot(a, a) + dot(b, b) + dot(c, c) for a, b, c in frames))
    return unless(least(d) <= 0, 0.0, least([divide(3 * F.pow(F.greatest(x, F.lit(0.0)), F.lit(2 / 3)), y) for x, y in zip(d, squares)]))


def tetra_condition(s: Stage, q: list[Point]) -> Column:
    return conditions(s, [regular_frame(s, q)])


def tetra_shape(s: Stage, q: list[Point]) -> Column:
    return shapes(s, [regular_frame(s, q)])


def hex_diagonals(q: list[Point]) -> list[Column]:
    return [norm(minus(q[b], q[a])) for a, b in ((0, 6), (1, 7), (2, 4), (3, 5))]


def hex_axes(s: Stage, q: list[Point]) -> list[Point]:
    side = lambda ahead, behind: minus(plus(*(q[k] for k in ahead)), plus(*(q[k] for k in behind)))
    return s.vectors(side((1, 2, 5, 6), (0, 3, 4, 7)), side((2, 3, 6, 7), (0, 1, 4, 5)), side((4, 5, 6, 7), (0, 1, 2, 3)))


def hex_frames(s: Stage, q: list[Point], centre: bool = True) -> list[Frame]:
    """Edge vectors at each corner, and the mean axes at the centre."""
    flat = s.vectors(*(minus(q[k], q[c]) for c, ends in enumerate(HEX_CORNERS) for k in ends))
    frames = [tuple(flat[k : k + 3]) for k in range(0, 24, 3)]
    return [*frames, tuple(s.vectors(*(tuple(x / 4 for x in a) for a in hex_axes(s, q))))] if centre else frames


def hex_aspect_ratio(s: Stage, q: list[Point]) -> Column:
    return ratio_of_axes(s.let(*(norm(v) for v in hex_axes(s, q))))


def hex_stretch(s: Stage, q: list[Point]) -> Column:
    edges = sorted({tuple(sorted((c, k))) for c, ends in enumerate(HEX_CORNERS) for k in ends})
    n, d = s.let(*(norm(minus(q[b], q[a])) for a, b in edges)), s.let(*hex_diagonals(q))
    return unless(greatest(d) <= 0, INFINITY, divide(math.sqrt(3) * least(n), greatest(d)))


def hex_skew(s: Stage, q: list[Point]) -> Column:
    axes = hex_axes(s, q)
    n = s.let(*(norm(a) for a in axes))
    return unless(least(n) <= 0, INFINITY, F.greatest(*(F.abs(divide(dot(axes[a], axes[b]), n[a] * n[b])) for a, b in ((0, 1), (1, 2), (2, 0)))))


def hex_jacobian(s: Stage, q: list[Point]) -> Column:
    return least([triple(*f) for f in hex_frames(s, q)])


def scaled(s: Stage, frames: list[Frame]) -> Column:
    d = s.let(*(triple(*f) for f in frames))
    n = s.let(*(norm(a) * norm(b) * norm(c) for a, b, c in frames))
    return least([divide(x, y) for x, y in zip(d, n)])


def hex_scaled_jacobian(s: Stage, q: list[Point]) -> Column:
    return scaled(s, hex_frames(s, q))


def hex_shear(s: Stage, q: list[Point]) -> Column:
    return scaled(s, hex_frames(s, q, centre=False))


def hex_shape(s: Stage, q: list[Point]) -> Column:
    return shapes(s, hex_frames(s, q))


def hex_condition(s: Stage, q: list[Point]) -> Column:
    return conditions(s, hex_frames(s, q, centre=False))


def hex_oddy(s: Stage, q: list[Point]) -> Column:
    frames = hex_frames(s, q)
    d = s.let(*(triple(*f) for f in frames))
    own = s.let(*(dot(v, v) for f in frames for v in f))
    both = s.let(*(dot(f[i], f[j]) for f in frames for i, j in ((0, 1), (1, 2), (0, 2))))
    worst = []
    for k, x in enumerate(d):
        g, h = own[3 * k : 3 * k + 3], both[3 * k : 3 * k + 3]
        trace = g[0] + g[1] + g[2]
        full = g[0] * g[0] + g[1] * g[1] + g[2] * g[2] + 2 * (h[0] * h[0] + h[1] * h[1] + h[2] * h[2])
        worst.append(divide(full - trace * trace / 3, F.pow(F.abs(x), F.lit(4 / 3))))
    return unless(least(d) <= 0, INFINITY, greatest(worst))


def hex_taper(s: Stage, q: list[Point]) -> Column:
    """The greatest cross derivative over the lesser of its two axes."""
    n = s.let(*(norm(a) for a in hex_axes(s, q)))
    total = lambda ks: plus(*(q[k] for k in ks))
    across = s.let(*(norm(minus(total(a), total(b))) for a, b in (((0, 2, 4, 6), (1, 3, 5, 7)), ((0, 3, 5, 6), (1, 2, 4, 7)), ((0, 1, 6, 7), (2, 3, 4, 5)))))
    return unless(least(n) <= 0, INFINITY, F.greatest(*(divide(x, F.least(n[a], n[b])) for x, (a, b) in zip(across, ((0, 1), (0, 2), (1, 2))))))


#: Faces of a hexahedron, seen from outside in counter-clockwise order.
OUTWARD = [(0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)]


def hex_dimension(s: Stage, q: list[Point]) -> Column:
    """Volume over the length of its gradient by the corners, over sqrt(2). A bilinear face counts as the mean of its two triangulations."""
    parts: list[list[Point]] = [[] for _ in q]
    for a, b, c, d in OUTWARD:
        for x, y, z in ((a, b, c), (a, c, d), (a, b, d), (b, c, d)):
            for k, (i, j) in ((x, (y, z)), (y, (z, x)), (z, (x, y))):
                parts[k].append(cross(q[i], q[j]))
    gradient = s.vectors(*(tuple(x / 12 for x in plus(*own)) for own in parts))
    volume, squares = s.let(sum((q[k][0] * gradient[k][0] for k in range(1, 8)), q[0][0] * gradient[0][0]), sum((dot(g, g) for g in gradient[1:]), dot(gradient[0], gradient[0])))
    return F.sqrt(divide(0.5 * volume * volume, squares))


def _measure(shape: str) -> Callable[[Stage, list[Point]], Column]:
    return lambda s, q: measure(F.lit(shape), F.col("p"))


METRICS = {
    ("triangle", "area"): _measure("triangle"), ("triangle", "max_angle"): max_angle, ("triangle", "min_angle"): min_angle,
    ("triangle", "aspect_ratio"): triangle_aspect_ratio, ("triangle", "condition"): triangle_condition, ("triangle", "shape"): triangle_shape,
    ("triangle", "scaled_jacobian"): triangle_scaled_jacobian,
    ("quad", "area"): quad_area, ("quad", "max_angle"): max_angle, ("quad", "min_angle"): min_angle, ("quad", "aspect_ratio"): quad_aspect_ratio,
    ("quad", "condition"): quad_condition, ("quad", "jacobian"): quad_jacobian, ("quad", "scaled_jacobian"): quad_scaled_jacobian,
    ("quad", "shape"): quad_shape, ("quad", "shear"): quad_scaled_jacobian, ("quad", "skew"): quad_skew, ("quad", "taper"): quad_taper,
    ("quad", "stretch"): quad_stretch, ("quad", "diagonal_ratio"): quad_diagonal_ratio, ("quad", "warpage"): quad_warpage, ("quad", "oddy"): quad_oddy,
    ("tetra", "volume"): _measure("tetra"), ("tetra", "aspect_gamma"): tetra_aspect_gamma, ("tetra", "aspect_ratio"): tetra_aspect_ratio,
    ("tetra", "jacobian"): tetra_jacobian, ("tetra", "scaled_jacobian"): tetra_scaled_jacobian, ("tetra", "condition"): tetra_condition, ("tetra", "shape"): tetra_shape,
    ("wedge", "volume"): _measure("wedge"), ("pyramid", "volume"): _measure("pyramid"),
    ("hexahedron", "jacobian"): hex_jacobian, ("hexahedron", "scaled_jacobian"): hex_scaled_jacobian, ("hexahedron", "shear"): hex_shear,
    ("hexahedron", "shape"): hex_shape, ("hexahedron", "condition"): hex_condition, ("hexahedron", "oddy"): hex_oddy, ("hexahedron", "taper"): hex_taper,
    ("hexahedron", "volume"): _measure("hexahedron"), ("hexahedron", "dimension"): hex_dimension, ("hexahedron", "aspect_ratio"): hex_aspect_ratio,
    ("hexahedron", "diagonal_ratio"): lambda s, q: diagonal_ratio(s, hex_diagonals(q)), ("hexahedron", "stretch"): hex_stretch, ("hexahedron", "skew"): hex_skew,
    ("hexahedron", "max_diagonal"): lambda s, q: F.greatest(*hex_diagonals(q)), ("hexahedron", "min_diagonal"): lambda s, q: F.least(*hex_diagonals(q)),
}
CORNERS = {"triangle": 3, "quad": 4, "tetra": 4, "pyramid": 5, "wedge": 6, "hexahedron": 8}


def quality(cells: DataFrame, points: DataFrame, metric: str) -> DataFrame:
    """cell, quality; -1 for shapes that the metric has no formula for."""
    own = {shape: f for (shape, name), f in METRICS.items() if name == metric}
    most = max((CORNERS[x] for x in own), default=0)
    rows = corners(cells, points)
    s = Stage(rows.select("cell", "shape", "p", *(F.get("p", F.lit(k))[c].alias(f"_{c}{k}") for k in range(most) for c in "xyz")))
    q = [tuple(F.col(f"_{c}{k}") for c in "xyz") for k in range(most)]
    value = F.lit(-1.0)
    for shape, formula in own.items():
        value = F.when(F.col("shape") == shape, formula(s, q[: CORNERS[shape]])).otherwise(value)
    return s.rows.select("cell", value.alias("quality"))


def total_measure(cells: DataFrame, points: DataFrame) -> DataFrame:
    """total, average: over the measures of all cells."""
    m = corners(cells, points).select(measure(F.col("shape"), F.col("p")).alias("m"))
    return m.agg(F.sum("m").alias("total"), F.avg("m").alias("average"))


def relative_size_squared(cells: DataFrame, points: DataFrame) -> DataFrame:
    """min(R, 1/R)² with R the measure over the mean measure of all cells."""
    m = corners(cells, points).select("cell", measure(F.col("shape"), F.col("p")).alias("m"))
    rows = m.crossJoin(F.broadcast(m.agg(F.avg("m").alias("mean"))))  # one row
    r = F.col("m") / F.col("mean")
    return rows.select("cell", F.coalesce(F.pow(F.least(r, F.try_divide(F.lit(1.0), r)), F.lit(2.0)), F.lit(0.0)).alias("quality"))


def shape_and_size(cells: DataFrame, points: DataFrame) -> DataFrame:
    """Shape times the squared relative size."""
    size = relative_size_squared(cells, points).withColumnRenamed("quality", "_size")
    return quality(cells, points, "shape").join(size, "cell").select("cell", (F.col("quality") * F.col("_size")).alias("quality"))
