"""Queries of topology, wavelets, cleaning and sweeping of meshes, splats and locators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.operators import flow, mesh, stencil, topology
from tesserae.plans.field_queries import rounded
from tesserae.plans.mesh_queries import GRID, NX, NY, SHEET, lattice, quads, sheet_points, suppliers, triangles
from tesserae.plans.registry import Registry, table
from tesserae.sources import fields

R = Registry()


def _blocks(spark):
    """The lattice in blocks of six columns, with edges along rows and columns."""
    p = lattice(spark).select(F.floor(F.col("i") / 6).alias("block"), "id", "i", "j", "f")
    ends = F.array(F.struct((F.col("i") + 1).alias("i2"), F.col("j").alias("j2")), F.struct(F.col("i").alias("i2"), (F.col("j") + 1).alias("j2")))
    e = p.select("block", F.col("id").alias("a"), F.inline(ends)).join(p.select("block", F.col("id").alias("b"), F.col("i").alias("i2"), F.col("j").alias("j2")), ["block", "i2", "j2"])
    return p, e.select("block", "a", "b")


@R.add("contour_tree_minima", GRID + """, e AS (SELECT x.i // 6 AS block, x.id AS a, min(y.f * 1000 + y.id) AS m, any_value(x.f * 1000 + x.id) AS own FROM l x JOIN l y ON x.i // 6 = y.i // 6 AND abs(x.i - y.i) + abs(x.j - y.j) = 1 GROUP BY 1, 2)
  SELECT CAST(block AS BIGINT) AS block, a AS extremum FROM e WHERE own < m""")
def contour_tree_minima(spark, d):
    """Every minimum of a block ends one branch of its merge tree."""
    points, edges = _blocks(spark)
    return topology.persistence_pairs(points, edges, "f").select("block", "extremum")


@R.add("contour_tree_pairs")
def contour_tree_pairs(spark, d):
    points, edges = _blocks(spark)
    return topology.persistence_pairs(points, edges, "f", upward=False)


@R.add("top_branches")
def top_branches(spark, d):
    points, edges = _blocks(spark)
    return topology.top_branches(topology.persistence_pairs(points, edges, "f"), 10, 1.0)


HAAR = "SELECT event_id // 2 AS event_id, round((coalesce(max(value) FILTER (WHERE event_id % 2 = 0), 0) {s} coalesce(max(value) FILTER (WHERE event_id % 2 = 1), 0)) * sqrt(0.5), 5) AS {n} FROM events GROUP BY 1"


@R.add("wavelet_transform", f"SELECT * FROM ({HAAR.format(s='+', n='approximation')}) JOIN ({HAAR.format(s='-', n='detail')}) USING (event_id)")
def wavelet_transform(spark, d):
    return rounded(topology.haar(table(spark, d, "events"), "event_id", "value"), 5)


@R.add("wavelet_compress", """WITH p AS (SELECT event_id // 2 AS k, coalesce(max(value) FILTER (WHERE event_id % 2 = 0), 0) AS a, coalesce(max(value) FILTER (WHERE event_id % 2 = 1), 0) AS b FROM events GROUP BY 1)
  SELECT k * 2 AS event_id, round(CASE WHEN abs(a - b) * sqrt(0.5) >= 20 THEN a ELSE (a + b) / 2 END, 5) AS value FROM p UNION ALL SELECT k * 2 + 1, round(CASE WHEN abs(a - b) * sqrt(0.5) >= 20 THEN b ELSE (a + b) / 2 END, 5) FROM p""")
def wavelet_compress(spark, d):
    return rounded(topology.compress(table(spark, d, "events").select("event_id", "value"), "event_id", "value", 20.0), 5)


@R.add("lyapunov_exponents")
def lyapunov_exponents(spark, d):
    grid = fields.uniform_grid(spark, (31, 31)).select("id", F.sin(F.col("y") / 5).alias("u"), F.cos(F.col("x") / 5).alias("v"), F.lit(0.0).alias("w"))
    seeds = fields.uniform_grid(spark, (15, 15), (8, 8), (1, 1))
    end = flow.particles(seeds, [flow.field_array(grid, ["u", "v", "w"], (31, 31, 1))], 0.1, 30)
    return rounded(topology.ftle(end.join(seeds.select("id", "i", "j"), "id"), 1.0, 3.0), 4)


@R.add("point_cloud", f"SELECT range AS cell, 'vertex' AS shape, [range] AS conn FROM range({NX * NY})")
def point_cloud(spark, d):
    return mesh.point_cloud(sheet_points(spark))


@R.add("clean_grid", SHEET + """, b AS (SELECT *, floor(x / 2.5) AS bx, floor(y / 2.5) AS by_, floor(z / 2.5) AS bz FROM v), nn AS (SELECT *, min(id) OVER (PARTITION BY bx, by_, bz) AS n FROM b)
  SELECT cell, [a.n, b.n, c.n] AS conn FROM t JOIN nn a ON t.a = a.id JOIN nn b ON t.b = b.id JOIN nn c ON t.c = c.id WHERE a.n <> b.n AND b.n <> c.n AND a.n <> c.n""")
def clean_grid(spark, d):
    return mesh.clean_grid(triangles(spark), sheet_points(spark), 2.5, ["f"])[0].select("cell", "conn")


@R.add("triangle_winding", SHEET + " SELECT cell, CASE WHEN (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) > 0 THEN [t.c, t.b, t.a] ELSE [t.a, t.b, t.c] END AS conn FROM s JOIN t USING (cell)")
def triangle_winding(spark, d):
    return mesh.winding(triangles(spark), sheet_points(spark), (0.0, 0.0, -1.0)).select("cell", "conn")


@R.add("extrude_rotational", "SELECT p.range + q.range * 20 AS id, round((1 + p.range * 0.5) * cos(q.range * pi() / 4), 6) + 0.0 AS x, round((1 + p.range * 0.5) * sin(q.range * pi() / 4), 6) + 0.0 AS y, p.range * 1.0 AS z FROM range(20) p, range(8) q")
def extrude_rotational(spark, d):
    points = spark.range(20).select("id", (1 + F.col("id") * 0.5).alias("r"), F.col("id").cast("double").alias("z"))
    out = mesh.revolve(points, 8, 20)
    return out.select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), "z")


@R.add("tube")
def tube(spark, d):
    t = F.col("id") / 5.0
    lines = spark.range(60).select((F.col("id") % 3).alias("line"), F.floor(F.col("id") / 3).alias("k"), F.cos(t).alias("x"), F.sin(t).alias("y"), (t / 2).alias("z"))
    return rounded(mesh.tube(lines, 0.1, 6), 5)


@R.add("slice_multiple", SHEET + ", g AS (SELECT cell, 0 AS plane FROM s WHERE NOT ((ax >= 7.25) = (bx >= 7.25) AND (bx >= 7.25) = (cx >= 7.25)) UNION ALL SELECT cell, 1 FROM s WHERE NOT ((ay >= 4.25) = (by_ >= 4.25) AND (by_ >= 4.25) = (cy >= 4.25))) SELECT * FROM g")
def slice_multiple(spark, d):
    cut = lambda value, n: mesh.contour_lines(triangles(spark), sheet_points(spark).withColumn("f", value), "f", 0.0).select("cell", F.lit(n).alias("plane"))
    return cut(F.col("x") - 7.25, 0).unionByName(cut(F.col("y") - 4.25, 1))


@R.add("gaussian_splat", "WITH s AS (SELECT s_suppkey * 37 % 1000 / 10.0 AS x, s_suppkey * 91 % 1000 / 10.0 AS y, s_acctbal AS f FROM supplier), g AS (SELECT a.range AS i, b.range AS j FROM range(101) a, range(101) b) SELECT i, j, round(sum(f * exp(-3 * ((i-x)*(i-x) + (j-y)*(j-y)) / 6.25)), 3) AS splat FROM g JOIN s ON (i-x)*(i-x) + (j-y)*(j-y) <= 6.25 GROUP BY 1, 2")
def gaussian_splat(spark, d):
    return rounded(stencil.gaussian_splat(suppliers(spark, d), "x", "y", "f", (101, 101), 2.5), 3)


@R.add("rectilinear_locate", "SELECT event_id, (value >= 10)::BIGINT + (value >= 50)::BIGINT + (value >= 200)::BIGINT + (value >= 400)::BIGINT - 1 AS cell FROM events WHERE value BETWEEN 10 AND 495")
def rectilinear_locate(spark, d):
    axis = [10.0, 50.0, 200.0, 400.0, 495.0]
    v = F.col("value")
    cell = sum(((v >= a).cast("long") for a in axis[1:-1]), (v >= axis[0]).cast("long")) - 1
    return table(spark, d, "events").where(v.between(axis[0], axis[-1])).select("event_id", cell.alias("cell"))


@R.add("matrix_determinant", "SELECT vec_id, round(e[1]*(e[5]*e[9]-e[6]*e[8]) - e[2]*(e[4]*e[9]-e[6]*e[7]) + e[3]*(e[4]*e[8]-e[5]*e[7]), 6) AS determinant FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def matrix_determinant(spark, d):
    e = F.col("embedding").cast("array<double>")
    m = [[F.get(e, F.lit(3 * i + j)) for j in range(3)] for i in range(3)]
    return rounded(table(spark, d, "embeddings").select("vec_id", V.determinant3(m).alias("determinant")), 6)


@R.add("solve_linear_system", "SELECT vec_id, round((x*d - b*y) / (a*d - b*c), 4) AS u, round((a*y - x*c) / (a*d - b*c), 4) AS v FROM (SELECT vec_id, embedding[1]::DOUBLE + 1 AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE + 1 AS d, embedding[5]::DOUBLE AS x, embedding[6]::DOUBLE AS y FROM embeddings)")
def solve_linear_system(spark, d):
    e = F.col("embedding").cast("array<double>")
    k = [F.get(e, F.lit(i)) for i in range(6)]
    u, v = V.solve2([[k[0] + 1, k[1]], [k[2], k[3] + 1]], [k[4], k[5]])
    return rounded(table(spark, d, "embeddings").select("vec_id", u.alias("u"), v.alias("v")), 4)


@R.add("coordinates_by_plane", "SELECT p.range * 10 + q.range AS id, round((2 + q.range * 0.1) * cos(p.range * pi() / 3), 6) + 0.0 AS x, round((2 + q.range * 0.1) * sin(p.range * pi() / 3), 6) + 0.0 AS y, q.range * 0.5 AS z FROM range(6) p, range(10) q")
def coordinates_by_plane(spark, d):
    """Cylindrical coordinates repeated on planes about an axis."""
    points = spark.range(10).select("id", (2 + F.col("id") * 0.1).alias("r"), (F.col("id") * 0.5).alias("z"))
    out = mesh.revolve(points, 6, 10, 2 * math.pi)
    return out.select("id", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"), "z")


@R.add("random_normal")
def random_normal(spark, d):
    u = lambda k: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(k)), "id").cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return spark.range(1000).select("id", F.round(F.sqrt(-2 * F.log(u(1))) * F.cos(2 * math.pi * u(2)), 6).alias("normal"))


@R.add("neighbourhood_of_quads", f"SELECT range AS id, (CASE WHEN range % {NX} IN (0, {NX - 1}) THEN 1 ELSE 2 END) * (CASE WHEN range // {NX} IN (0, {NY - 1}) THEN 1 ELSE 2 END)::BIGINT AS cells FROM range({NX * NY})")
def neighbourhood_of_quads(spark, d):
    return quads(spark).select(F.explode("conn").alias("id")).groupBy("id").agg(F.count("*").alias("cells"))
