"""Connectivity: components of graphs, of cells that share edges, of equal neighbouring pixels; renumbering."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.operators.primitives import cut_lineage, scan


def least_labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, label (the least node it is connected with), by stars of edges that shrink until each component is one star.

    edges: a, b. In a round every node's neighbours are linked to the least of them, first the greater
    ones, then the lesser; the number of rounds grows with the logarithm of a component's width.
    """
    now = cut_lineage(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        down = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut_lineage(down.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("_l")), "node", "left").select("node", F.coalesce("_l", "node").alias("label"))
        seen = state
    raise RuntimeError(f"no components after {max_rounds} rounds")


def renumber(df: DataFrame, column: str, out: str) -> DataFrame:
    """Adds dense numbers from 0 in the order of a numeric column's distinct values."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    numbered = scan(distinct, F.lit(1), column, out=out).withColumn(out, (F.col(out) - 1).cast("long"))
    return df.join(numbered, column, "left")


def graph_connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (numbered by least node)."""
    return renumber(least_labels(nodes, edges), "label", "component").select("node", "component")


def cell_connectivity(incidence: DataFrame) -> DataFrame:
    """cell, component of cells that share an edge. incidence: cell, edge. Cells of an edge are linked to the least of them, not all pairs."""
    least = incidence.groupBy("edge").agg(F.min("cell").alias("b"))
    star = incidence.join(least, "edge").where("cell != b").select(F.col("cell").alias("a"), "b")
    return graph_connectivity(incidence.select(F.col("cell").alias("node")).distinct(), star).withColumnRenamed("node", "cell")


def image_connectivity(pixels: DataFrame, value: str) -> DataFrame:
    """id, component of pixels (i, j, id) or voxels (i, j, k, id) of equal value that touch, corners included."""
    axes = [c for c in "ijk" if c in pixels.columns]
    ahead = [o for o in itertools.product((-1, 0, 1), repeat=len(axes)) if o > (0,) * len(axes)]
    offsets = F.array(*(F.struct(*(F.lit(x).alias(f"d{c}") for c, x in zip(axes, o))) for o in ahead))
    near = pixels.select(F.col("id").alias("a"), value, *axes, F.inline(offsets)).select("a", value, *((F.col(c) + F.col(f"d{c}")).alias(c) for c in axes))
    edges = near.join(pixels.select(*axes, value, F.col("id").alias("b")), [*axes, value]).select("a", "b")
    return graph_connectivity(pixels.select(F.col("id").alias("node")), edges).withColumnRenamed("node", "id")


def pointer_jump(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root of a forest given by node, parent (a root is its own parent), doubling the jumps each round."""
    now = parents.select("node", F.col("parent").alias("root"))
    for _ in range(rounds):
        up = now.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = cut_lineage(now.join(up, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
        now = new.select("node", "root")
        if new.where("moved").isEmpty():
            return now
    raise RuntimeError("the parents hold a cycle")


def degree(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array("a", "b")).alias("node"))
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def is_star(parents: DataFrame) -> Column:
    return F.col("parent") == F.col("node")
