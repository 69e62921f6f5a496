"""Scalar topology within blocks, wavelet transforms, and flow-map exponents."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIRS = "block long, saddle long, extremum long, persistence double"


def _sweep(ids: np.ndarray, values: np.ndarray, edges: np.ndarray, upward: bool) -> list[tuple[int, int, float]]:
    """(saddle, extremum, persistence) of a sweep over a graph: where two components meet, the younger one ends."""
    order = np.lexsort((ids, values))
    if not upward:
        order = order[::-1]
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    near: list[list[int]] = [[] for _ in ids]
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    up = np.arange(len(ids))
    birth = np.arange(len(ids))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for v in order:
        roots = {find(n) for n in near[v] if rank[n] < rank[v]}
        if not roots:
            continue
        oldest, *rest = sorted(roots, key=lambda r: rank[birth[r]])
        for r in rest:
            out.append((int(ids[v]), int(ids[birth[r]]), float(abs(values[v] - values[birth[r]]))))
            up[r] = oldest
        up[v] = oldest
    last = order[-1]
    for r in {find(x) for x in range(len(ids))}:
        out.append((int(ids[last]), int(ids[birth[r]]), float(abs(values[last] - values[birth[r]]))))
    return out


def persistence_pairs(points: DataFrame, edges: DataFrame, field: str, upward: bool = True) -> DataFrame:
    """Merge tree of each block as saddle - extremum pairs (the global extremum pairs with the sweep's last vertex).

    points: block, id, field; edges: block, a, b. A block is a bounded piece of the mesh and the unit of work.
    """
    v = points.select("block", F.col("id").alias("a"), F.lit(-1).cast("long").alias("b"), F.col(field).cast("double").alias("f"))
    e = edges.select("block", "a", "b", F.lit(None).cast("double").alias("f"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        vertices, links = pdf[pdf.b < 0], pdf[pdf.b >= 0]
        ids = vertices.a.to_numpy()
        place = pd.Series(np.arange(len(ids)), index=ids)
        found = _sweep(ids, vertices.f.to_numpy(), np.column_stack([place[links.a].to_numpy(), place[links.b].to_numpy()]) if len(links) else np.zeros((0, 2), int), upward)
        return pd.DataFrame([(pdf.block.iloc[0], *p) for p in found], columns=["block", "saddle", "extremum", "persistence"])

    return v.unionByName(e).groupBy("block").applyInPandas(run, PAIRS)


def top_branches(pairs: DataFrame, k: int, presimplify: float = 0.0) -> DataFrame:
    """The k most persistent branches above a threshold: a top-k report."""
    return pairs.where(F.col("persistence") > presimplify).orderBy(F.desc("persistence"), "extremum").limit(k)


def haar(df: DataFrame, index: str, value: str) -> DataFrame:
    """One level of the orthonormal Haar transform: index, approximation, detail of each pair; an odd tail pairs with 0."""
    pair = df.groupBy(F.expr(f"{index} div 2").alias(index)).agg(
        F.coalesce(F.max(F.when(F.col(index) % 2 == 0, F.col(value))), F.lit(0.0)).alias("_a"), F.coalesce(F.max(F.when(F.col(index) % 2 == 1, F.col(value))), F.lit(0.0)).alias("_b")
    )
    root = math.sqrt(0.5)
    return pair.select(index, ((F.col("_a") + F.col("_b")) * root).alias("approximation"), ((F.col("_a") - F.col("_b")) * root).alias("detail"))


def inverse_haar(df: DataFrame, index: str, out: str) -> DataFrame:
    root = math.sqrt(0.5)
    both = F.array(
        F.struct((F.col(index) * 2).alias(index), ((F.col("approximation") + F.col("detail")) * root).alias(out)),
        F.struct((F.col(index) * 2 + 1).alias(index), ((F.col("approximation") - F.col("detail")) * root).alias(out)),
    )
    return df.select(F.inline(both))


def compress(df: DataFrame, index: str, value: str, threshold: float) -> DataFrame:
    """Values rebuilt from one level of coefficients of which small details are dropped."""
    level = haar(df, index, value)
    return inverse_haar(level.withColumn("detail", F.when(F.abs("detail") >= threshold, F.col("detail")).otherwise(0.0)), index, value)


def ftle(moved: DataFrame, spacing: float, time: float) -> DataFrame:
    """i, j, exponent: log of the greatest eigenvalue of JᵀJ over 2 * time, with J from central differences of the flow map.

    moved: i, j, x, y, the final positions of particles seeded on a plane grid.
    """
    side = lambda di, dj, tag: moved.select((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j"), F.col("x").alias(f"x{tag}"), F.col("y").alias(f"y{tag}"))
    rows = moved.select("i", "j")
    for di, dj, tag in ((1, 0, "e"), (-1, 0, "w"), (0, 1, "n"), (0, -1, "s")):
        rows = rows.join(side(di, dj, tag), ["i", "j"])
    d = lambda c, p, m: (F.col(f"{c}{p}") - F.col(f"{c}{m}")) / (2 * spacing)
    a, b, c, e = d("x", "e", "w"), d("x", "n", "s"), d("y", "e", "w"), d("y", "n", "s")
    p, q, r = a * a + c * c, a * b + c * e, b * b + e * e
    top = (p + r) / 2 + F.sqrt((p - r) * (p - r) / 4 + q * q)
    return rows.select("i", "j", (F.log(F.greatest(top, F.lit(1e-300))) / (2 * time)).alias("exponent"))
