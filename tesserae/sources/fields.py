"""Synthetic grids: each a range with expressions, so of any size and never held on the driver."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def uniform_grid(spark: SparkSession, dims: Sequence[int], origin: Sequence[float] = (0, 0, 0), spacing: Sequence[float] = (1, 1, 1)) -> DataFrame:
    """id, i, j, k and coordinates x, y, z of a uniform grid; i runs fastest."""
    nx, ny, nz = (*dims, 1, 1)[:3]
    n = F.col("id")
    ijk = {"i": n % nx, "j": F.floor(n / nx) % ny, "k": F.floor(n / (nx * ny))}
    rows = spark.range(nx * ny * nz).select("id", *(c.alias(a) for a, c in ijk.items()))
    return rows.select("*", *((F.lit(float(o)) + F.lit(float(s)) * F.col(a)).alias(c) for a, c, o, s in zip("ijk", "xyz", (*origin, 0, 0), (*spacing, 1, 1))))


def rectilinear_grid(spark: SparkSession, xs: Sequence[float], ys: Sequence[float], zs: Sequence[float] = (0.0,)) -> DataFrame:
    """A grid with coordinates given for each axis, as literals of the plan."""
    rows = uniform_grid(spark, (len(xs), len(ys), len(zs))).select("id", "i", "j", "k")
    axis = lambda values, index: F.get(F.array(*(F.lit(float(v)) for v in values)), F.col(index).cast("int"))
    return rows.select("*", axis(xs, "i").alias("x"), axis(ys, "j").alias("y"), axis(zs, "k").alias("z"))


def tangle(spark: SparkSession, dims: Sequence[int]) -> DataFrame:
    """Quartic field on the unit cube: each axis scaled to 3(2t - 1), then (sum of x⁴ - 5x² + 11.8) · 0.2 + 0.5."""
    n = [max(d - 1, 1) for d in dims]
    rows = uniform_grid(spark, dims, (0, 0, 0), [1 / m for m in n])
    term = lambda c: (lambda t: t * t * t * t - 5 * t * t)(3 * (2 * F.col(c) - 1))
    return rows.withColumn("tangle", (term("x") + term("y") + term("z") + 11.8) * 0.2 + 0.5)


def wavelet(spark: SparkSession, low: Sequence[int] = (-10, -10, -10), high: Sequence[int] = (10, 10, 10), centre: Sequence[float] = (0, 0, 0), frequency: Sequence[float] = (60, 30, 40), magnitude: Sequence[float] = (10, 18, 5), deviation: float = 0.5, peak: float = 255.0) -> DataFrame:
    """A Gaussian bump plus a wave along each axis."""
    dims = [b - a + 1 for a, b in zip(low, high)]
    rows = uniform_grid(spark, dims, low)
    scale = [1.0 / (b - a) if b > a else 1.0 for a, b in zip(low, high)]
    at = [(F.lit(float(c)) - F.col(x)) * s for c, x, s in zip(centre, "xyz", scale)]
    bump = peak * F.exp(-(at[0] * at[0] + at[1] * at[1] + at[2] * at[2]) / (2 * deviation * deviation))
    waves = magnitude[0] * F.sin(frequency[0] * at[0]) + magnitude[1] * F.sin(frequency[1] * at[1]) + magnitude[2] * F.cos(frequency[2] * at[2])
    return rows.withColumn("wavelet", bump + waves)


def oscillator(spark: SparkSession, dims: Sequence[int], time: float, periodic: Sequence[tuple] = (), damped: Sequence[tuple] = (), decaying: Sequence[tuple] = ()) -> DataFrame:
    """Sum of oscillators (x, y, z, radius, omega, zeta) on the unit cube at a time."""
    rows = uniform_grid(spark, dims, (0, 0, 0), [1 / max(d - 1, 1) for d in dims])

    def near(o: tuple) -> Column:
        d2 = sum(((F.col(c) - a) * (F.col(c) - a) for c, a in zip("yz", o[1:3])), (F.col("x") - o[0]) * (F.col("x") - o[0]))
        return F.exp(-d2 / (2 * o[3] * o[3]))

    value = F.lit(0.0)
    for o in periodic:
        value = value + math.sin(o[4] * time) * near(o) if o[4] else value
    for o in damped:
        phi = math.acos(min(1.0, o[5]))
        value = value + (1 - math.exp(-o[5] * o[4] * time) * math.sin(math.sqrt(max(0.0, 1 - o[5] ** 2)) * o[4] * time + phi) / math.sin(phi)) * near(o)
    for o in decaying:
        value = value + math.exp(-time / (o[4] or 1.0)) * near(o)
    return rows.withColumn("oscillation", value)


#: The middles of a cube's edges.
DIRECTIONS = [(x, y, 0) for x in (1, -1) for y in (1, -1)] + [(x, 0, z) for x in (1, -1) for z in (1, -1)] + [(0, y, z) for y in (1, -1) for z in (1, -1)]


def gradient_noise(spark: SparkSession, dims: Sequence[int], cell: int = 8, seed: int = 0) -> DataFrame:
    """Perlin noise: a hashed direction at every cell-th point; the products with the offsets from the corners, smoothly interpolated."""
    rows = uniform_grid(spark, dims)
    mask = F.lit(0x7FFFFFFF).cast("long")

    def direction(*k: Column) -> list[Column]:
        mixed = [x.cast("long") * f for x, f in zip((*k, F.lit(seed)), (73856093, 19349663, 83492791, 2654435761))]
        h = (mixed[0].bitwiseXOR(mixed[1]).bitwiseXOR(mixed[2]).bitwiseXOR(mixed[3])).bitwiseAND(mask)
        at = (F.floor(h / 16) % len(DIRECTIONS)).cast("int")
        return [F.get(F.array(*(F.lit(float(d[axis])) for d in DIRECTIONS)), at) for axis in range(3)]

    base = [F.floor(F.col(a) / cell) for a in "ijk"]
    offset = [F.col(a) / cell - b for a, b in zip("ijk", base)]
    fade = [f * f * f * (f * (f * 6 - 15) + 10) for f in offset]
    value = F.lit(0.0)
    for corner in itertools.product((0, 1), repeat=3):
        g = direction(*(b + c for b, c in zip(base, corner)))
        along = sum((x * (o - c) for x, o, c in zip(g[1:], offset[1:], corner[1:])), g[0] * (offset[0] - corner[0]))
        weight = F.lit(1.0)
        for t, c in zip(fade, corner):
            weight = weight * (t if c else 1 - t)
        value = value + weight * along
    return rows.withColumn("noise", value)


def curvilinear_grid(spark: SparkSession, dims: Sequence[int], x: Column, y: Column, z: Column) -> DataFrame:
    """A structured grid whose coordinates are expressions of i, j, k."""
    return uniform_grid(spark, dims).select("id", "i", "j", "k", x.alias("x"), y.alias("y"), z.alias("z"))


def explicit_cells(flat: DataFrame, counts: DataFrame) -> DataFrame:
    """cell, shape, conn from a flat connectivity (pos, id) and cells (cell, shape, start, n)."""
    each = counts.select("cell", "shape", F.posexplode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("k", "pos"))
    joined = each.join(flat, "pos")
    return joined.groupBy("cell", "shape").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("conn"))  # a cell's corners


def amr_blocks(spark: SparkSession, levels: int, size: int) -> DataFrame:
    """block, level, lo_x .. hi_z: nested grids of size cells to a side, each level over the middle half of the one before, in eighths."""
    rows = []
    for level in range(levels):
        low, wide = 0.5 - 0.5 ** (level + 1), 0.5**level
        parts = 1 if level == 0 else 2
        for n, corner in enumerate(itertools.product(range(parts), repeat=3)):
            at = [low + c * wide / parts for c in corner]
            rows.append((len(rows), level, n, size, *(v for a in at for v in (a, a + wide / parts))))
    return spark.createDataFrame(rows, "block long, level int, number int, cells int, " + ", ".join(f"lo_{c} double, hi_{c} double" for c in "xyz"))
