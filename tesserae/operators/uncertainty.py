"""Uncertain contours: probabilities that an iso-value crosses a cell whose point values are random."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def below(iso: float, low: Column, high: Column) -> Column:
    """Probability that a uniform value is below the iso-value."""
    return F.when(high <= iso, 1.0).when(low >= iso, 0.0).otherwise(F.try_divide(iso - low, high - low))


def uniform_crossing(cells: DataFrame, points: DataFrame, low: str, high: str, iso: float) -> DataFrame:
    """cell, crossing, nonzero (cases of signs that can occur), entropy of the cases in bits.

    Points are independent, so the entropy of the cases is the sum of the points' own.
    """
    flat = cells.select("cell", F.explode("conn").alias("id")).join(points.select("id", low, high), "id")
    p = below(iso, F.col(low), F.col(high))
    rows = flat.select("cell", p.alias("p"))
    h = F.when((F.col("p") > 0) & (F.col("p") < 1), -F.col("p") * F.log2("p") - (1 - F.col("p")) * F.log2(1 - F.col("p"))).otherwise(0.0)
    own = rows.groupBy("cell").agg(F.product("p").alias("all"), F.product(1 - F.col("p")).alias("none"), F.sum(F.when((F.col("p") > 0) & (F.col("p") < 1), 1).otherwise(0)).alias("open"), F.sum(h).alias("entropy"))
    return own.select("cell", (1 - F.col("all") - F.col("none")).alias("crossing"), F.pow(F.lit(2.0), F.col("open")).cast("long").alias("nonzero"), "entropy")


def uniform_monte_carlo(cells: DataFrame, points: DataFrame, low: str, high: str, iso: float, draws: int, seed: int = 0) -> DataFrame:
    """cell, crossing: the share of draws in which a cell's values lie on both sides. A point's draws depend on its id and the seed alone, so cells share them."""
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "id", "draw").cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    drawn = points.select("id", low, high, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = drawn.select("id", "draw", (F.col(low) + (F.col(high) - F.col(low)) * u >= iso).alias("up"))
    flat = cells.select("cell", F.explode("conn").alias("id")).join(drawn, "id")
    each = flat.groupBy("cell", "draw").agg((F.bool_or("up") & ~F.bool_and("up")).alias("crossed"))
    return each.groupBy("cell").agg(F.avg(F.col("crossed").cast("double")).alias("crossing"))


def gaussian_below(iso: float, mean: Column, variance: Column) -> Column:
    """Normal distribution function, by the complementary error function's rational approximation (1.2e-7)."""
    z = (iso - mean) / F.sqrt(2 * variance)
    a = F.abs(z)
    t = 1 / (1 + 0.5 * a)
    c = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly = reduce(lambda s, k: s * t + k, reversed(c[:-1]), F.lit(c[-1]))
    erfc = t * F.exp(-a * a + poly)
    return F.when(z >= 0, 1 - erfc / 2).otherwise(erfc / 2)


def gaussian_crossing(cells: DataFrame, points: DataFrame, mean: str, variance: str, iso: float) -> DataFrame:
    """cell, crossing for independent normal values."""
    flat = cells.select("cell", F.explode("conn").alias("id")).join(points.select("id", mean, variance), "id")
    rows = flat.select("cell", gaussian_below(iso, F.col(mean), F.col(variance)).alias("p"))
    return rows.groupBy("cell").agg((1 - F.product("p") - F.product(1 - F.col("p"))).alias("crossing"))


def in_rectangle(rows: DataFrame, box: tuple[float, float, float, float], lo_x: str, hi_x: str, lo_y: str, hi_y: str) -> DataFrame:
    """Adds the probability that a pair of independent uniform values falls in a rectangle."""

    def share(lo: Column, hi: Column, a: float, b: float) -> Column:
        return F.when(hi > lo, F.greatest(F.lit(0.0), F.least(hi, F.lit(b)) - F.greatest(lo, F.lit(a))) / (hi - lo)).otherwise(lo.between(a, b).cast("double"))

    return rows.withColumn("probability", share(F.col(lo_x), F.col(hi_x), box[0], box[1]) * share(F.col(lo_y), F.col(hi_y), box[2], box[3]))
