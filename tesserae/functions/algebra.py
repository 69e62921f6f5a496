"""Matrices, projective transforms, geometry, ranges, floating point, hashes and root finding, as columns.

Matrices are lists of rows of columns or numbers, known when the plan is made; so are vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Number = Column | float
Matrix = Sequence[Sequence[Number]]
Vector = Sequence[Number]


def col(x: Number) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def total(xs: Sequence[Number]) -> Column:
    out = col(xs[0])
    for x in xs[1:]:
        out = out + x
    return out


def inner(a: Vector, b: Vector) -> Column:
    return total([col(x) * y for x, y in zip(a, b)])


def minus(a: Vector, b: Vector) -> list[Column]:
    return [col(x) - y for x, y in zip(a, b)]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [col(a[i]) * b[j] - col(a[j]) * b[i] for i, j in ((1, 2), (2, 0), (0, 1))]


# Matrices.


def identity(n: int) -> list[list[float]]:
    return [[float(i == j) for j in range(n)] for i in range(n)]


def transpose(m: Matrix) -> list[list[Number]]:
    return [list(c) for c in zip(*m)]


def multiply(a: Matrix, b: Matrix) -> list[list[Column]]:
    columns = transpose(b)
    return [[inner(r, c) for c in columns] for r in a]


def apply(m: Matrix, v: Vector) -> list[Column]:
    return [inner(r, v) for r in m]


def minor(m: Matrix, i: int, j: int) -> list[list[Number]]:
    return [[x for k, x in enumerate(r) if k != j] for n, r in enumerate(m) if n != i]


def determinant(m: Matrix) -> Column:
    if len(m) == 1:
        return col(m[0][0])
    return total([(1 if j % 2 == 0 else -1) * col(m[0][j]) * determinant(minor(m, 0, j)) for j in range(len(m))])


def inverse(m: Matrix) -> list[list[Column]]:
    """By cofactors; nulls for a singular matrix."""
    det, n = determinant(m), len(m)
    if n == 1:
        return [[F.try_divide(F.lit(1.0), det)]]
    return [[F.try_divide((1 if (i + j) % 2 == 0 else -1) * determinant(minor(m, j, i)), det) for j in range(n)] for i in range(n)]


def solve(m: Matrix, v: Vector) -> list[Column]:
    """Cramer's rule; nulls for a singular matrix."""
    det = determinant(m)
    return [F.try_divide(determinant([[v[i] if k == j else x for k, x in enumerate(r)] for i, r in enumerate(m)]), det) for j in range(len(m))]


# Transforms of points: 4 x 4 matrices, applied with the perspective division.


def translation(x: Number, y: Number, z: Number) -> list[list[Number]]:
    return [[1.0, 0.0, 0.0, x], [0.0, 1.0, 0.0, y], [0.0, 0.0, 1.0, z], [0.0, 0.0, 0.0, 1.0]]


def scaling(x: Number, y: Number, z: Number) -> list[list[Number]]:
    return [[x, 0.0, 0.0, 0.0], [0.0, y, 0.0, 0.0], [0.0, 0.0, z, 0.0], [0.0, 0.0, 0.0, 1.0]]


def transform_point(m: Matrix, p: Vector) -> list[Column]:
    x, y, z, w = apply(m, [*p, 1.0])
    return [F.try_divide(c, w) for c in (x, y, z)]


def transform_vector(m: Matrix, v: Vector) -> list[Column]:
    return [inner(r[:3], v) for r in m[:3]]


# Vectors.


def reciprocal_magnitude(v: Vector) -> Column:
    return F.try_divide(F.lit(1.0), F.sqrt(inner(v, v)))


def orthonormal(vectors: Sequence[Vector]) -> list[list[Column]]:
    """Gram-Schmidt; a vector that depends on those before it gives nulls."""
    out: list[list[Column]] = []
    for v in vectors:
        rest = [col(x) for x in v]
        for u in out:
            along = inner(v, u)
            rest = [x - along * y for x, y in zip(rest, u)]
        n = F.sqrt(inner(rest, rest))
        out.append([F.try_divide(x, n) for x in rest])
    return out


# Rays, planes, spheres.


def ray_plane(origin: Vector, direction: Vector, on: Vector, normal: Vector) -> tuple[Column, list[Column]]:
    """How far along a ray a plane is met, and where; nulls if it runs alongside or the other way."""
    t = F.try_divide(inner(normal, minus(on, origin)), inner(normal, direction))
    t = F.when(t >= 0, t)
    return t, [col(o) + t * d for o, d in zip(origin, direction)]


def plane_distance(point: Vector, on: Vector, normal: Vector) -> Column:
    """Signed."""
    return inner(minus(point, on), normal) * reciprocal_magnitude(normal)


def line_distance(point: Vector, a: Vector, b: Vector) -> Column:
    """From the line through two points."""
    along = minus(b, a)
    off = cross(minus(point, a), along)
    return F.try_divide(F.sqrt(inner(off, off)), F.sqrt(inner(along, along)))


def circumcentre(points: Sequence[Vector]) -> list[Column]:
    """The centre of the circle through three points of the plane, or of the sphere through four of space; nulls if they lie flat."""
    first = points[0]
    rows = [minus(p, first) for p in points[1:]]
    x = solve(rows, [inner(r, r) / 2 for r in rows])
    return [col(a) + b for a, b in zip(first, x)]


# Ranges (a struct of low and high) and boxes of them.


def span(low: Number, high: Number) -> Column:
    return F.struct(col(low).alias("low"), col(high).alias("high"))


def is_empty(r: Column) -> Column:
    return ~F.coalesce(r["low"] <= r["high"], F.lit(False))


def length(r: Column) -> Column:
    return F.when(is_empty(r), 0.0).otherwise(r["high"] - r["low"])


def middle(r: Column) -> Column:
    return F.when(~is_empty(r), (r["low"] + r["high"]) / 2)


def union(a: Column, b: Column) -> Column:
    return F.when(is_empty(a), b).when(is_empty(b), a).otherwise(span(F.least(a["low"], b["low"]), F.greatest(a["high"], b["high"])))


def intersection(a: Column, b: Column) -> Column:
    return span(F.greatest(a["low"], b["low"]), F.least(a["high"], b["high"]))


def contains(r: Column, x: Number) -> Column:
    return F.coalesce(col(x).between(r["low"], r["high"]), F.lit(False))


def volume(box: Sequence[Column]) -> Column:
    out = length(box[0])
    for r in box[1:]:
        out = out * length(r)
    return out


# Floating point.

EPSILON, LARGEST, SMALLEST = 2.0**-52, float.fromhex("0x1.fffffffffffffp+1023"), 2.0**-1022


def sign_bit(x: Column) -> Column:
    """Whether a number is negative, -0.0 included."""
    return (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))


def copy_sign(x: Column, of: Column) -> Column:
    return F.when(sign_bit(of), -F.abs(x)).otherwise(F.abs(x))


def is_finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) < float("inf"))


def frexp(x: Column) -> Column:
    """Struct of mantissa (in [0.5, 1), with the sign) and exponent; 0 has exponent 0."""
    size = F.abs(x)
    guess = F.floor(F.log2(F.when(size > 0, size))).cast("int") + 1
    guess = F.when(size / F.pow(F.lit(2.0), guess) >= 1, guess + 1).when(size / F.pow(F.lit(2.0), guess) < 0.5, guess - 1).otherwise(guess)
    e = F.coalesce(guess, F.lit(0))
    return F.struct((x / F.pow(F.lit(2.0), e)).alias("mantissa"), e.alias("exponent"))


def ldexp(mantissa: Column, exponent: Column) -> Column:
    return mantissa * F.pow(F.lit(2.0), exponent)


def float_place(x: Column) -> Column:
    """Normal doubles in ascending order as consecutive whole numbers, 0 for 0."""
    f = frexp(F.abs(x))
    place = (f["exponent"] + 1021).cast("long") * F.lit(1 << 52) + ((f["mantissa"] * 2 - 1) * float(1 << 52)).cast("long") + F.lit(1 << 52)
    return F.when(x == 0, F.lit(0).cast("long")).when(x < 0, -place).otherwise(place)


def float_distance(a: Column, b: Column) -> Column:
    """How many doubles lie from one to the other."""
    return F.abs(float_place(a) - float_place(b))


def _product(a: Column, b: Column) -> tuple[Column, Column]:
    """A product and its rounding error, by splitting both factors into halves."""

    def halves(x: Column) -> tuple[Column, Column]:
        c = x * 134217729.0
        high = c - (c - x)
        return high, x - high

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def difference_of_products(a: Column, b: Column, c: Column, d: Column) -> Column:
    """ab - cd without cancellation of the products' rounding."""
    (p, e), (q, f) = _product(a, b), _product(c, d)
    return (p - q) + (e - f)


def quotient(x: Column, y: Column) -> Column:
    """The whole number nearest to x / y, ties to even."""
    return F.rint(x / y).cast("long")


# Hashes and roots.


def fnv1a(*words: Column) -> Column:
    """32-bit FNV-1a over whole numbers, each taken as one word."""
    h = F.lit(2166136261).cast("long")
    for w in words:
        h = (h.bitwiseXOR(w.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))) * F.lit(16777619)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    return h


def newton(f: Callable[[Column], Column], slope: Callable[[Column], Column], start: Column, steps: int = 10) -> Column:
    """A root by Newton's method; the last value if the slope vanishes."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start.cast("double"), lambda x, _: x - F.coalesce(F.try_divide(f(x), slope(x)), F.lit(0.0)))


def from_cylindrical(r: Column, theta: Column, z: Column) -> list[Column]:
    return [r * F.cos(theta), r * F.sin(theta), z]


def from_spherical(r: Column, theta: Column, phi: Column) -> list[Column]:
    return [r * F.sin(theta) * F.cos(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(theta)]


def catmull_rom(p: Sequence[Number], t: Column) -> Column:
    """Between the second and third of four samples."""
    a, b, c, d = map(col, p)
    m0, m1 = (c - a) / 2, (d - b) / 2
    return b + t * (m0 + t * (3 * (c - b) - 2 * m0 - m1 + t * (2 * (b - c) + m0 + m1)))


def colour_bytes(rgb: Sequence[Column], alpha: Number | None = None) -> Column:
    """Channels in [0, 1] as an array of bytes from 0 to 255."""
    byte = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(col(x) * 255 + 0.5).cast("int")))
    return F.array(*(byte(x) for x in (*rgb, *(() if alpha is None else (alpha,)))))


def warp(point: Vector, direction: Vector, scale: Number) -> list[Column]:
    """A point moved along a direction, which may be constant or a field, by a number or a field."""
    return [col(p) + col(scale) * d for p, d in zip(point, direction)]


def multi_plane(point: Vector, planes: Sequence[tuple[Vector, Vector]]) -> Column:
    """The greatest of the planes' values: negative inside all of them."""
    return F.greatest(*(inner(minus(point, on), normal) for on, normal in planes)) if len(planes) > 1 else inner(minus(point, planes[0][0]), planes[0][1])


def sphere_gradient(point: Vector, centre: Vector) -> list[Column]:
    return [2 * x for x in minus(point, centre)]


def cylinder_gradient(point: Vector, centre: Vector, axis: Vector) -> list[Column]:
    d = minus(point, centre)
    along = inner(d, axis) / inner(axis, axis)
    return [2 * (x - along * a) for x, a in zip(d, axis)]
