"""Thresholds, masks, structured extraction and point extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.primitives import scan


def threshold(cells: DataFrame, field: str, low: float, high: float, invert: bool = False) -> DataFrame:
    inside = F.col(field).cast("double").between(low, high)
    return cells.where(~inside if invert else inside)


def threshold_by_points(cells: DataFrame, points: DataFrame, cell: str, field: str, low: float, high: float, all_in_range: bool = False, invert: bool = False) -> DataFrame:
    """Cells of which any (or all) points are in range; points carry their cell's id."""
    inside = F.col(field).cast("double").between(low, high)
    verdict = (F.bool_and if all_in_range else F.bool_or)(inside)
    chosen = points.groupBy(cell).agg(verdict.alias("_in")).where(~F.col("_in") if invert else F.col("_in"))
    return cells.join(chosen.select(cell), cell, "left_semi")


def threshold_vector(rows: DataFrame, field: str, low: float, high: float, mode: str = "any", component: int = 0) -> DataFrame:
    inside = lambda x: x.cast("double").between(low, high)
    v = F.col(field)
    return rows.where({"any": F.exists(v, inside), "all": F.forall(v, inside), "component": inside(F.get(v, F.lit(component)))}[mode])


def threshold_points(points: DataFrame, field: str, below: float | None = None, above: float | None = None) -> DataFrame:
    """Points at most `below` and at least `above`; the bounds are cast to the field's type first."""
    kind = points.schema[field].dataType
    for bound, keep in ((below, lambda b: F.col(field) <= b), (above, lambda b: F.col(field) >= b)):
        if bound is not None:
            points = points.where(keep(F.lit(bound).cast(kind)))
    return points


def mask(rows: DataFrame, index: str, stride: int, n: int) -> DataFrame:
    """Every stride-th of n elements; what is left at the end of less than a stride is dropped."""
    return rows.where((F.col(index) % stride == 0) & (F.col(index) < n // stride * stride))


def mask_points(points: DataFrame, order: str, stride: int) -> DataFrame:
    """Every stride-th point in an order column, floor(n / stride) of them, with its place n."""
    placed = scan(points, F.lit(1), order, out="n").withColumn("n", (F.col("n") - 1).cast("long"))
    whole = points.agg((F.floor(F.count("*") / stride) * stride).alias("_most"))  # one row
    return placed.where(F.col("n") % stride == 0).crossJoin(F.broadcast(whole)).where("n < _most").drop("_most")


def extract_structured(points: DataFrame, axes: list[str], low: list[int], high: list[int], rate: list[int], include_boundary: bool = False) -> DataFrame:
    """Points of the box [low, high) at every rate-th index of each axis, numbered anew."""
    for a, lo, hi, r in zip(axes, low, high, rate):
        i = F.col(a)
        hit = (i - lo) % r == 0
        if include_boundary:
            hit = hit | (i == hi - 1)
        points = points.where(i.between(lo, hi - 1) & hit).withColumn(a, F.ceil((i - lo) / r).cast("long"))
    return points


def extract_points(points: DataFrame, value: Column, inside: bool = True) -> DataFrame:
    return points.where(value <= 0 if inside else value > 0)


def extract_geometry(points: DataFrame, cell: str, value: Column, inside: bool = True, boundary: bool = False, only_boundary: bool = False) -> DataFrame:
    """Ids of cells whose points all lie inside (at most 0) or outside (at least 0), and of those on the boundary if asked for."""
    v = points.select(cell, value.alias("_v")).groupBy(cell).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    crossing = (F.col("lo") <= 0) & (F.col("hi") >= 0)
    whole = F.col("hi") <= 0 if inside else F.col("lo") >= 0
    return v.where(crossing if only_boundary else (whole | crossing if boundary else whole)).select(cell)


def remove_ghosts(cells: DataFrame, ghost: str, types: int = 0xFF) -> DataFrame:
    return cells.where(F.col(ghost).bitwiseAND(types) == 0)


def cell_average(points: DataFrame, cell: str, *fields: str) -> DataFrame:
    return points.groupBy(cell).agg(*(F.avg(f).alias(f) for f in fields))


def point_average(incidence: DataFrame, points: DataFrame, point: str, cell_field: str) -> DataFrame:
    """Mean over the cells of each point; null for a point without cells."""
    means = incidence.groupBy(point).agg(F.avg(cell_field).alias(cell_field))
    return points.join(means, point, "left")
