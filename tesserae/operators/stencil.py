"""Neighbourhood operators on structured points (i, j) or (i, j, k): medians, box means, gradients, moments, similarity of images.

A stencil joins only the offsets that it needs; each value is sent to its neighbours' rows once for each of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.primitives import by_rows


def axes_of(pixels: DataFrame) -> list[str]:
    return [c for c in "ijk" if c in pixels.columns]


def offsets(radius: int, n: int = 2) -> list[tuple[int, ...]]:
    return [o[::-1] for o in itertools.product(range(-radius, radius + 1), repeat=n)]


def ball(radius: int, n: int) -> list[tuple[int, ...]]:
    return [o for o in offsets(radius, n) if sum(x * x for x in o) <= radius * radius]


def neighbourhood(pixels: DataFrame, around: list[tuple[int, ...]], size: Sequence[int] | None = None) -> DataFrame:
    """A row for each pixel (ci, cj, ...) and pixel around it (i, j, ..., di, dj, ...): one equi-join on shifted indices.

    With a size, indices beyond the edge are clamped, so that edge values repeat; else they are left out, and rows
    are partitioned by their centre, which they are sent to, so that grouping by it moves nothing more.
    """
    axes = axes_of(pixels)
    each = F.inline(F.array(*(F.struct(*(F.lit(x).alias(f"d{c}") for c, x in zip(axes, o))) for o in around)))
    rows, kind = pixels.count() * (len(around) + 1), dict(pixels.dtypes)
    if size:
        centres = pixels.select(*(F.col(c).alias(f"c{c}") for c in axes), each)
        at = [F.greatest(F.lit(0), F.least(F.col(f"c{c}") + F.col(f"d{c}"), F.lit(n - 1))) for c, n in zip(axes, size)]
        centres = centres.select(*(f"c{c}" for c in axes), *(f"d{c}" for c in axes), *(x.cast(kind[c]).alias(c) for x, c in zip(at, axes)))
        centres, values = by_rows(rows, (centres, axes), (pixels, axes))
        return centres.join(values.hint("merge"), axes)
    own = [f"c{c}" for c in axes]
    sent = pixels.select("*", each).withColumns({f"c{c}": (F.col(c) - F.col(f"d{c}")).cast(kind[c]) for c in axes})
    sent, centres = by_rows(rows, (sent, own), (pixels.select(*(F.col(c).alias(f"c{c}") for c in axes)), own))
    return sent.join(centres.hint("merge"), own)


def centre(axes: list[str]) -> list[Column]:
    return [F.col(f"c{c}").alias(c) for c in axes]


def image_median(pixels: DataFrame, field: str, radius: int, size: Sequence[int]) -> DataFrame:
    axes = axes_of(pixels)
    near = neighbourhood(pixels.select(*axes, field), offsets(radius, len(axes)), size)
    middle = (2 * radius + 1) ** len(axes) // 2
    median = F.get(F.sort_array(F.collect_list(field)), F.lit(middle))  # a stencil's values
    return near.groupBy(*centre(axes)).agg(median.alias("median"))


def box_average(pixels: DataFrame, field: str, radius: int) -> DataFrame:
    """Means over a box, axis by axis: sums and counts of a row of values, then of these."""
    axes = axes_of(pixels)
    rows = pixels.select(*axes, F.col(field).cast("double").alias("_s"), F.lit(1).cast("long").alias("_n"))
    for a in axes:
        spread = rows.withColumn(a, F.explode(F.array(*(F.col(a) + d for d in range(-radius, radius + 1)))))
        rows = spread.groupBy(*axes).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    return pixels.select(*axes).join(rows, axes).select(*axes, (F.col("_s") / F.col("_n")).alias("average"))


def gradient(pixels: DataFrame, field: str, size: Sequence[int], spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Central differences; one-sided at the edges. Columns gx, gy and, in three dimensions, gz."""
    axes = axes_of(pixels)
    steps = {(a, s): tuple(s if b == a else 0 for b in axes) for a in axes for s in (1, -1)}
    near = neighbourhood(pixels.select(*axes, field), [(0,) * len(axes), *steps.values()])
    at = lambda o: F.max(F.when(sum((F.abs(F.col(f"d{c}") - x) for c, x in zip(axes[1:], o[1:])), F.abs(F.col(f"d{axes[0]}") - o[0])) == 0, F.col(field)))
    rows = near.groupBy(*centre(axes)).agg(at((0,) * len(axes)).alias("_c"), *(at(o).alias(f"_{a}{s}") for (a, s), o in steps.items()))

    def slope(a: str, h: float) -> Column:
        up, down = F.col(f"_{a}1"), F.col(f"_{a}-1")
        both = up.isNotNull() & down.isNotNull()
        return (F.coalesce(up, "_c") - F.coalesce(down, "_c")) * F.when(both, 0.5 / h).otherwise(1.0 / h)

    return rows.select(*axes, *(slope(a, h).alias(f"g{x}") for a, h, x in zip(axes, spacing, "xyz")))


def flow_derivatives(pixels: DataFrame, u: str, v: str, size: Sequence[int], w: str | None = None) -> DataFrame:
    """Divergence, vorticity (in a plane its z part; else vorticity_x, _y, _z) and Q criterion of a vector field."""
    axes = axes_of(pixels)
    names = [u, v] if w is None else [u, v, w]
    rows = None
    for name, f in zip("uvw", names):
        one = gradient(pixels, f, size).withColumnsRenamed({f"g{x}": f"{name}{x}" for x in "xyz"})
        rows = one if rows is None else rows.join(one, axes)
    g = lambda a, b: F.col(f"{a}{b}")
    if w is None:
        q = -(g("u", "x") * g("u", "x") + g("v", "y") * g("v", "y")) / 2 - g("u", "y") * g("v", "x")
        return rows.select(*axes, (g("u", "x") + g("v", "y")).alias("divergence"), (g("v", "x") - g("u", "y")).alias("vorticity"), q.alias("q_criterion"))
    q = -(g("u", "x") * g("u", "x") + g("v", "y") * g("v", "y") + g("w", "z") * g("w", "z")) / 2 - (g("u", "y") * g("v", "x") + g("u", "z") * g("w", "x") + g("v", "z") * g("w", "y"))
    curl = {"x": g("w", "y") - g("v", "z"), "y": g("u", "z") - g("w", "x"), "z": g("v", "x") - g("u", "y")}
    return rows.select(*axes, (g("u", "x") + g("v", "y") + g("w", "z")).alias("divergence"), *(c.alias(f"vorticity_{a}") for a, c in curl.items()), q.alias("q_criterion"))


def image_difference(a: DataFrame, b: DataFrame, field: str, threshold: float) -> DataFrame:
    """Absolute difference of each pixel, and whether it exceeds the threshold."""
    axes = axes_of(a)
    both = a.select(*axes, F.col(field).alias("_a")).join(b.select(*axes, F.col(field).alias("_b")), axes)
    return both.select(*axes, F.abs(F.col("_a") - F.col("_b")).alias("difference"), (F.abs(F.col("_a") - F.col("_b")) > threshold).alias("exceeds"))


def distance_squared(axes: list[str]) -> Column:
    return sum((F.col(f"d{c}") * F.col(f"d{c}") for c in axes[1:]), F.col(f"d{axes[0]}") * F.col(f"d{axes[0]}"))


def ssim(a: DataFrame, b: DataFrame, field: str, radius: int = 3, peak: float = 1.0) -> DataFrame:
    """Structural similarity in a Gaussian-weighted disc or ball (sigma = radius / 3), truncated at the edges."""
    axes = axes_of(a)
    both = a.select(*axes, F.col(field).alias("x")).join(b.select(*axes, F.col(field).alias("y")), axes)
    near = neighbourhood(both, ball(radius, len(axes))).withColumn("w", F.exp(-distance_squared(axes) / (2 * (radius / 3) ** 2)))
    s = near.groupBy(*centre(axes)).agg(F.sum("w").alias("w"), *(F.sum(F.expr(f"w * {e}")).alias(n) for n, e in (("x", "x"), ("y", "y"), ("xx", "x * x"), ("yy", "y * y"), ("xy", "x * y"))))
    s = s.select(*axes, *((F.col(c) / F.col("w")).alias(c) for c in ("x", "y", "xx", "yy", "xy")))
    vx, vy = F.greatest(F.col("xx") - F.col("x") * F.col("x"), F.lit(0.0)), F.greatest(F.col("yy") - F.col("y") * F.col("y"), F.lit(0.0))
    cov = F.col("xy") - F.col("x") * F.col("y")
    c1, c2 = (0.01 * peak) ** 2, (0.03 * peak) ** 2
    value = (2 * F.col("x") * F.col("y") + c1) * (2 * cov + c2) / ((F.col("x") ** 2 + F.col("y") ** 2 + c1) * (vx + vy + c2))
    return s.select(*axes, value.alias("ssim"))


def moments(pixels: DataFrame, field: str, radius: int, order: int) -> DataFrame:
    """Sums of di^p dj^q (dk^r) f over a disc or ball, for all powers whose sum is the order at most: columns m_pq or m_pqr."""
    axes = axes_of(pixels)
    near = neighbourhood(pixels.select(*axes, field), ball(radius, len(axes)))
    powers = [p for p in itertools.product(range(order + 1), repeat=len(axes)) if sum(p) <= order]
    term = lambda p: F.sum(F.expr(" * ".join([field, *(f"power(d{c}, {n})" for c, n in zip(axes, p))])))
    return near.groupBy(*centre(axes)).agg(*(term(p).alias("m_" + "".join(map(str, p))) for p in sorted(powers, key=lambda p: (sum(p), [-x for x in p]))))


def cubic_spline(d2: Column, radius: float, n: int) -> Column:
    """The normalised cubic spline kernel of a smoothing length of half the radius."""
    h = radius / 2
    q = F.sqrt(d2) / h
    norm = {1: 2 / 3, 2: 10 / (7 * math.pi), 3: 1 / math.pi}[n] / h**n
    return norm * F.when(q < 1, 1 - 1.5 * q * q + 0.75 * q * q * q).when(q < 2, 0.25 * F.pow(2 - q, F.lit(3.0))).otherwise(0.0)


def splat(points: DataFrame, at: Sequence[str], value: str, size: Sequence[int], radius: float, kernel: str = "gaussian") -> DataFrame:
    """Each point adds value times a kernel to the lattice points within the radius: exp(-3 d² / r²), or the cubic spline."""
    axes = list("ijk"[: len(at)])
    each = F.inline(F.array(*(F.struct(*(F.lit(x).alias(f"d{c}") for c, x in zip(axes, o))) for o in offsets(math.ceil(radius) + 1, len(axes)))))
    spread = points.select(*(F.col(x).alias(f"_{c}") for x, c in zip(at, axes)), F.col(value).alias("_f"), each)
    for c in axes:
        spread = spread.withColumn(c, F.floor(f"_{c}") + F.col(f"d{c}"))
    d2 = sum(((F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}")) for c in axes[1:]), (F.col("i") - F.col("_i")) * (F.col("i") - F.col("_i")))
    inside = d2 <= radius * radius
    for c, n in zip(axes, size):
        inside = inside & F.col(c).between(0, n - 1)
    weight = F.exp(-3 * d2 / (radius * radius)) if kernel == "gaussian" else cubic_spline(d2, radius, len(axes))
    return spread.where(inside).groupBy(*axes).agg(F.sum(F.col("_f") * weight).alias("splat"))


def gaussian_splat(points: DataFrame, x: str, y: str, value: str, size: Sequence[int], radius: float) -> DataFrame:
    return splat(points, (x, y), value, size, radius)
