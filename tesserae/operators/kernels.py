"""User kernels over fields, cells, points, keys and neighbourhoods; scatters and masks that choose which rows a kernel sees.

A kernel is a function of columns to a column (or of aggregates, for reductions), so it stays within the optimizer's reach.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.stencil import axes_of, centre, neighbourhood


def map_field(df: DataFrame, out: str, kernel: Callable[..., Column], *inputs: str) -> DataFrame:
    return df.withColumn(out, kernel(*map(F.col, inputs)))


def visit_cells(cells: DataFrame, points: DataFrame, out: str, kernel: Callable[[Column], Column], *fields: str) -> DataFrame:
    """cell, out: the kernel gets the array of a cell's point values (structs of the fields, and k, the corner) in the order of conn."""
    flat = cells.select("cell", F.posexplode("conn").alias("k", "id")).join(points.select("id", *fields), "id")
    own = flat.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("k", *fields))).alias("_p"))  # a cell's corners
    return own.select("cell", kernel(F.col("_p")).alias(out))


def visit_points(cells: DataFrame, cell_fields: Sequence[str], out: str, kernel: Callable[..., Column]) -> DataFrame:
    """id, out: the kernel gets columns of the cells around each point and returns an aggregate of them."""
    flat = cells.select(*cell_fields, F.explode("conn").alias("id"))
    return flat.groupBy("id").agg(kernel(*map(F.col, cell_fields)).alias(out))


def reduce_by_key(df: DataFrame, key: str, out: str, kernel: Callable[..., Column], *inputs: str) -> DataFrame:
    return df.groupBy(key).agg(kernel(*map(F.col, inputs)).alias(out))


def visit_neighbourhood(pixels: DataFrame, field: str, around: list[tuple[int, ...]], out: str, kernel: Callable[..., Column], size: Sequence[int] | None = None) -> DataFrame:
    """i, j (k), out: the kernel gets the field and the offsets di, dj (dk) and returns an aggregate over the neighbourhood."""
    axes = axes_of(pixels)
    near = neighbourhood(pixels.select(*axes, field), around, size)
    return near.groupBy(*centre(axes)).agg(kernel(F.col(field), *(F.col(f"d{c}") for c in axes)).alias(out))


def scatter_uniform(df: DataFrame, times: int) -> DataFrame:
    """Each row so many times, with visit, its number among them."""
    return df.withColumn("visit", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times > 0 else df.withColumn("visit", F.lit(0)).limit(0)


def scatter_counting(df: DataFrame, counts: str) -> DataFrame:
    """Each row as often as its count says, with visit; rows of count 0 are left out."""
    return df.where(F.col(counts) > 0).withColumn("visit", F.explode(F.sequence(F.lit(0), (F.col(counts) - 1).cast("int"))))


def scatter_permutation(df: DataFrame, index: str, permutation: DataFrame, at: str, source: str) -> DataFrame:
    """For each row of the permutation (at, source) the input's row with that index."""
    return permutation.select(F.col(at).alias("visit_at"), F.col(source).alias(index)).join(df, index)


def mask_select(df: DataFrame, flag: str) -> DataFrame:
    return df.where(F.col(flag).cast("boolean"))


def mask_indices(df: DataFrame, index: str, chosen: DataFrame, column: str) -> DataFrame:
    """Rows whose index is chosen, once each."""
    return df.join(chosen.select(F.col(column).alias(index)).distinct(), index, "left_semi")


def runtime_vectors(df: DataFrame, index: str, value: str, size: int) -> DataFrame:
    """index, v: consecutive values in arrays of a length that is known at run time only."""
    place = F.floor(F.col(index) / size)
    return df.groupBy(place.cast("long").alias(index)).agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(index).alias("_i"), F.col(value).alias("_v")))), lambda x: x["_v"]).alias("v"))  # size values


def strided(df: DataFrame, index: str, n: int, stride: int = 1, offset: int = 0, modulo: int = 0, divisor: int = 1) -> DataFrame:
    """A view of n elements: the one at i is the input's at ((i / divisor) % modulo) * stride + offset."""
    i = F.floor(F.col("i") / divisor)
    i = i % modulo if modulo else i
    view = df.sparkSession.range(n).select(F.col("id").alias("i")).withColumn(index, (i * stride + offset).cast("long"))
    return view.join(df, index)


def multiplexed(choice: Column, *columns: Column) -> Column:
    """One of several columns, by number."""
    return F.get(F.array(*columns), choice.cast("int"))


def discard(df: DataFrame) -> None:
    """Computes all rows and keeps none."""
    df.write.format("noop").mode("overwrite").save()
