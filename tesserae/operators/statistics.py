"""Descriptive statistics with moments, entropy and N-dimensional histograms."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.density import bin_of, histogram


def moments(value: Column) -> list[Column]:
    """The summary columns; a degenerate sample has 0 where the moment is undefined. Kurtosis is not excess."""
    x = value.cast("double")
    zero = F.lit(0.0)
    spread = F.coalesce(F.var_pop(x), zero) > 0
    return [
        F.count(x).alias("n"),
        F.min(x).alias("minimum"),
        F.max(x).alias("maximum"),
        F.coalesce(F.sum(x), zero).alias("total"),
        F.coalesce(F.avg(x), zero).alias("mean"),
        F.coalesce(F.when(F.count(x) > 1, F.var_samp(x)), zero).alias("sample_variance"),
        F.coalesce(F.when(F.count(x) > 1, F.stddev_samp(x)), zero).alias("sample_stddev"),
        F.coalesce(F.var_pop(x), zero).alias("population_variance"),
        F.coalesce(F.stddev_pop(x), zero).alias("population_stddev"),
        F.coalesce(F.when(spread, F.skewness(x)), zero).alias("skewness"),
        F.coalesce(F.when(spread, F.kurtosis(x) + 3), zero).alias("kurtosis"),
    ]


def statistics(df: DataFrame, field: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(*moments(F.col(field)))


def statistics_partitioned(df: DataFrame, field: str, partition: str) -> DataFrame:
    """A row for each partition and one (null partition) over all."""
    return df.rollup(partition).agg(*moments(F.col(field)))


def entropy(df: DataFrame, field: str, n_bins: int = 10, value_range: tuple[float, float] | None = None) -> DataFrame:
    """Entropy in bits of the histogram."""
    bins = histogram(df, field, n_bins, value_range)
    total = bins.agg(F.sum("freq").alias("total"))
    p = F.col("freq") / F.col("total")
    return bins.crossJoin(F.broadcast(total)).where("freq > 0").agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"))


def nd_histogram(df: DataFrame, fields: dict[str, int]) -> DataFrame:
    """Sparse counts by bins of several fields: <field>_bin for each, and frequency."""
    data = df.select(*(F.col(f).cast("double").alias(f) for f in fields)).dropna()
    limits = [x for f in fields for x in (F.min(f).alias(f"_lo_{f}"), F.max(f).alias(f"_hi_{f}"))]
    rows = data.crossJoin(F.broadcast(data.agg(*limits)))  # one row
    bins = [bin_of(F.col(f), F.col(f"_lo_{f}"), (F.col(f"_hi_{f}") - F.col(f"_lo_{f}")) / n, n).alias(f"{f}_bin") for f, n in fields.items()]
    return rows.groupBy(*bins).agg(F.count("*").alias("frequency"))


def nd_entropy(df: DataFrame, fields: dict[str, int]) -> DataFrame:
    bins = nd_histogram(df, fields)
    total = bins.agg(F.sum("frequency").alias("total"))
    p = F.col("frequency") / F.col("total")
    return bins.crossJoin(F.broadcast(total)).agg(F.coalesce(-F.sum(p * F.log2(p)), F.lit(0.0)).alias("entropy"))


def marginal(bins: DataFrame, keep: list[str], condition: Column | None = None) -> DataFrame:
    """Frequencies summed over the dimensions left out, given a condition on bins."""
    rows = bins if condition is None else bins.where(condition)
    return rows.groupBy(*keep).agg(F.sum("frequency").alias("frequency")).where("frequency > 0")


def average_by_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean of each key; integers divide in integers."""
    mean = F.avg(value)
    if df.schema[value].dataType.typeName() in ("byte", "short", "integer", "long"):
        mean = F.expr(f"sum(`{value}`) div count(`{value}`)")
    return df.groupBy(key).agg(mean.alias("mean"))


def field_range(df: DataFrame, field: str, finite_only: bool = False, mask: Column | None = None) -> DataFrame:
    x = F.col(field)
    keep = F.lit(True) if mask is None else mask
    if finite_only:
        keep = keep & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return df.where(keep).agg(F.min(x).alias("low"), F.max(x).alias("high"))


def density_of_cells(df: DataFrame, at: Sequence[str], mass: str | None, dims: Sequence[int], origin: Sequence[float], spacing: Sequence[float], divide: bool = True) -> DataFrame:
    """Mass (or number) of particles in each cell of a uniform grid of any dimension; cells without any have 0, particles outside are dropped."""
    index = [F.floor((F.col(c) - o) / h) for c, o, h in zip(at, origin, spacing)]
    inside = reduce(lambda c, x: c & x, (i.between(0, n - 1) for i, n in zip(index, dims)))
    weight = F.lit(1.0) if mass is None else F.col(mass).cast("double")
    cell = reduce(lambda s, x: s + x, (i * math.prod(dims[:k]) for k, i in enumerate(index)))
    sums = df.where(inside).groupBy(cell.cast("long").alias("cell")).agg(F.sum(weight).alias("w"))
    cells = df.sparkSession.range(math.prod(dims)).select(F.col("id").alias("cell"))
    return cells.join(sums, "cell", "left").select("cell", (F.coalesce("w", F.lit(0.0)) / (math.prod(spacing) if divide else 1.0)).alias("density"))


def density_of_points(df: DataFrame, at: Sequence[str], mass: str, dims: Sequence[int], origin: Sequence[float], spacing: Sequence[float]) -> DataFrame:
    """Each particle spreads over the corners of its cell; the first corner gets the product of the parametric coordinates."""
    n = len(dims)
    rows = df.select(F.col(mass).cast("double").alias("m"), *(((F.col(c) - o) / h).alias(f"u{k}") for k, (c, o, h) in enumerate(zip(at, origin, spacing))))
    rows = rows.where(reduce(lambda c, x: c & x, (F.col(f"u{k}").between(0, dims[k]) for k in range(n))))
    rows = rows.withColumns({f"i{k}": F.least(F.floor(f"u{k}"), F.lit(dims[k] - 1)) for k in range(n)})

    def corner(up: tuple[int, ...]) -> Column:
        point = reduce(lambda s, x: s + x, ((F.col(f"i{k}") + up[k]) * math.prod(d + 1 for d in dims[:k]) for k in range(n)))
        share = [F.col(f"u{k}") - F.col(f"i{k}") for k in range(n)]
        return F.struct(point.cast("long").alias("point"), reduce(lambda s, x: s * x, (1 - p if u else p for u, p in zip(up, share)), F.col("m")).alias("w"))

    sums = rows.select(F.inline(F.array(*map(corner, itertools.product((0, 1), repeat=n))))).groupBy("point").agg(F.sum("w").alias("w"))
    points = df.sparkSession.range(math.prod(d + 1 for d in dims)).select(F.col("id").alias("point"))
    return points.join(sums, "point", "left").select("point", (F.coalesce("w", F.lit(0.0)) / math.prod(spacing)).alias("density"))


def particle_density(df: DataFrame, x: str, y: str, mass: str | None, dims: Sequence[int], origin: Sequence[float], spacing: Sequence[float], divide: bool = True) -> DataFrame:
    return density_of_cells(df, (x, y), mass, dims, origin, spacing, divide)


def particle_density_cic(df: DataFrame, x: str, y: str, mass: str, dims: Sequence[int], origin: Sequence[float], spacing: Sequence[float]) -> DataFrame:
    return density_of_points(df, (x, y), mass, dims, origin, spacing)


def hist_sampling(df: DataFrame, field: str, key: str, fraction: float = 0.1, n_bins: int = 10, seed: int = 0) -> DataFrame:
    """Importance sampling: bins get equal shares of the sample, the scarcest first; a row is taken if its hash falls below target / count.

    The targets are a fold over the bins' counts, one row that is broadcast.
    """
    rows = histogram(df, field, n_bins).select(F.struct("freq", "bin").alias("b"))
    sized = rows.agg(F.sort_array(F.collect_list("b")).alias("bins"))  # n_bins structs
    start = F.struct((fraction * F.aggregate("bins", F.lit(0).cast("long"), lambda a, b: a + b["freq"])).alias("left"), F.array().cast("array<struct<bin: bigint, share: double>>").alias("done"))

    def take(a: Column, b: Column) -> Column:
        target = F.least(b["freq"].cast("double"), a["left"] / (n_bins - F.size(a["done"])))
        share = F.when(b["freq"] > 0, target / b["freq"]).otherwise(0.0)
        return F.struct((a["left"] - target).alias("left"), F.concat(a["done"], F.array(F.struct(b["bin"].cast("long").alias("bin"), share.alias("share")))).alias("done"))

    shares = sized.select(F.transform(F.sort_array(F.aggregate("bins", start, take)["done"]), lambda x: x["share"]).alias("_shares"))
    limits = df.agg(F.coalesce(F.min(F.col(field).cast("double")), F.lit(0.0)).alias("_low"), F.coalesce(F.max(F.col(field).cast("double")), F.lit(0.0)).alias("_high"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)
    binned = df.crossJoin(F.broadcast(limits)).crossJoin(F.broadcast(shares)).withColumn("_bin", bin_of(F.col(field).cast("double"), F.col("_low"), (F.col("_high") - F.col("_low")) / n_bins, n_bins))
    return binned.where(u < F.get("_shares", F.col("_bin").cast("int"))).drop("_bin", "_low", "_high", "_shares")
