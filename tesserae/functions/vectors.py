"""Column functions on vectors (arrays of numbers), matrices and points."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def magnitude_squared(v: Column) -> Column:
    return dot(v, v)


def magnitude(v: Column) -> Column:
    return F.sqrt(magnitude_squared(v))


def normalize(v: Column) -> Column:
    """Unit vector; the zero vector gives nulls."""
    n = magnitude(v)
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), n))


def cross(a: Column, b: Column) -> Column:
    c = lambda i, j: F.get(a, F.lit(i)) * F.get(b, F.lit(j)) - F.get(a, F.lit(j)) * F.get(b, F.lit(i))
    return F.array(c(1, 2), c(2, 0), c(0, 1))


def lerp(a: Column, b: Column, w: Column) -> Column:
    return a + (b - a) * w


def triangle_normal(a: Sequence[Column], b: Sequence[Column], c: Sequence[Column]) -> Column:
    u, v = F.array(*(y - x for x, y in zip(a, b))), F.array(*(y - x for x, y in zip(a, c)))
    return cross(u, v)


def project(v: Column, onto: Column) -> Column:
    s = F.try_divide(dot(v, onto), magnitude_squared(onto))
    return F.transform(onto, lambda x: s * x)


def composite(*fields: Column) -> Column:
    return F.array(*fields)


def swizzle(v: Column, order: Sequence[int]) -> Column:
    return F.array(*(F.get(v, F.lit(i)) for i in order))


def determinant3(m: Sequence[Sequence[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def solve2(m: Sequence[Sequence[Column]], v: Sequence[Column]) -> tuple[Column, Column]:
    det = m[0][0] * m[1][1] - m[0][1] * m[1][0]
    return F.try_divide(v[0] * m[1][1] - m[0][1] * v[1], det), F.try_divide(m[0][0] * v[1] - v[0] * m[1][0], det)


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """Struct of the lesser and greater real root of ax² + bx + c; nulls without one."""
    d = F.sqrt(F.when(b * b - 4 * a * c >= 0, b * b - 4 * a * c))
    return F.struct(F.try_divide(-b - d, 2 * a).alias("r1"), F.try_divide(-b + d, 2 * a).alias("r2"))


def affine(x: Column, y: Column, z: Column, m: Sequence[Sequence[float]]) -> tuple[Column, Column, Column]:
    """A point by the upper three rows of a 4 x 4 matrix."""
    return tuple(r[0] * x + r[1] * y + r[2] * z + r[3] for r in m[:3])


def rotation(degrees: float, axis: Sequence[float]) -> list[list[float]]:
    n = math.sqrt(sum(a * a for a in axis))
    x, y, z = (a / n for a in axis)
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    t = 1 - c
    return [
        [t * x * x + c, t * x * y - s * z, t * x * z + s * y, 0.0],
        [t * x * y + s * z, t * y * y + c, t * y * z - s * x, 0.0],
        [t * x * z - s * y, t * y * z + s * x, t * z * z + c, 0.0],
        [0.0, 0.0, 0.0, 1.0],
    ]


def to_cylindrical(x: Column, y: Column, z: Column) -> Column:
    """r, theta in [-pi/2, 3pi/2), z."""
    r = F.sqrt(x * x + y * y)
    a = F.asin(F.try_divide(y, r))
    theta = F.when((x == 0) & (y == 0), F.lit(0.0)).when(x < 0, math.pi - a).otherwise(a)
    return F.struct(r.alias("r"), theta.alias("theta"), z.alias("z"))


def to_spherical(x: Column, y: Column, z: Column) -> Column:
    """r, theta from the z axis, phi in [0, 2pi)."""
    r = F.sqrt(x * x + y * y + z * z)
    phi = F.atan2(y, x)
    return F.struct(
        r.alias("r"), F.coalesce(F.acos(F.try_divide(z, r)), F.lit(0.0)).alias("theta"), F.when(phi < 0, phi + 2 * math.pi).otherwise(phi).alias("phi")
    )


def log_value(v: Column, base: str = "e", minimum: float = 1.1754943508222875e-38) -> Column:
    x = F.greatest(v.cast("double"), F.lit(minimum))
    return {"e": F.log, "2": F.log2, "10": F.log10}[base](x)


def elevation(x: Column, y: Column, z: Column, low: Sequence[float], high: Sequence[float], to: tuple[float, float] = (0.0, 1.0)) -> Column:
    axis = [h - a for a, h in zip(low, high)]
    along = sum((p - a) * d for p, a, d in zip((x, y, z), low, axis)) / sum(d * d for d in axis)
    return to[0] + (to[1] - to[0]) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """CIE L*a*b* (D65) from sRGB in [0, 1]."""
    linear = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    rows = [((0.4124564, 0.3575761, 0.1804375), 0.95047), ((0.2126729, 0.7151522, 0.0721750), 1.0), ((0.0193339, 0.1191920, 0.9503041), 1.08883)]
    f = []
    for w, white in rows:
        t = sum(k * c for k, c in zip(w, linear)) / white
        f.append(F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116))
    return F.struct((116 * f[1] - 16).alias("l"), (500 * (f[0] - f[1])).alias("a"), (200 * (f[1] - f[2])).alias("b"))


def colour(value: Column, low: float, high: float, table: Sequence[tuple[float, float, float]]) -> Column:
    """RGB by linear interpolation in an evenly spaced table; values outside get its ends."""
    n = len(table) - 1
    at = F.greatest(F.lit(0.0), F.least(F.lit(float(n)), (value - low) / (high - low) * n))
    i = F.least(F.floor(at), F.lit(n - 1)).cast("int")
    part = lambda c: lerp(F.get(F.array(*(F.lit(float(t[c])) for t in table)), i), F.get(F.array(*(F.lit(float(t[c])) for t in table)), i + 1), at - i)
    return F.array(part(0), part(1), part(2))


# Implicit functions: negative inside.


def plane(x: Column, y: Column, z: Column, origin: Sequence[float], normal: Sequence[float]) -> Column:
    return sum((p - o) * n for p, o, n in zip((x, y, z), origin, normal))


def sphere(x: Column, y: Column, z: Column, centre: Sequence[float], radius: float) -> Column:
    return sum((p - c) * (p - c) for p, c in zip((x, y, z), centre)) - radius * radius


def box(x: Column, y: Column, z: Column, low: Sequence[float], high: Sequence[float]) -> Column:
    """Distance to the box outside it, minus that to the nearest face inside."""
    gaps = [F.greatest(a - p, p - b) for p, a, b in zip((x, y, z), low, high)]
    outside = F.sqrt(sum(F.pow(F.greatest(g, F.lit(0.0)), F.lit(2.0)) for g in gaps))
    return F.when(F.greatest(*gaps) > 0, outside).otherwise(F.greatest(*gaps))


def cylinder(x: Column, y: Column, z: Column, centre: Sequence[float], axis: Sequence[float], radius: float) -> Column:
    """Squared distance to the axis, less the squared radius."""
    d = [p - c for p, c in zip((x, y, z), centre)]
    along = sum(a * b for a, b in zip(d, axis))
    return sum(a * a for a in d) - along * along / sum(a * a for a in axis) - radius * radius


def frustum(x: Column, y: Column, z: Column, planes: Sequence[tuple[Sequence[float], Sequence[float]]]) -> Column:
    return F.greatest(*(plane(x, y, z, o, n) for o, n in planes))


multi_plane = frustum
