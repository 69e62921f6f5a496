"""Queries of stencils, spatial joins and meshes, over lattices built by expressions and over supplier, part and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import mesh, quality, spatial, stencil
from tesserae.plans.field_queries import rounded
from tesserae.plans.registry import Registry, table

R = Registry()
NX, NY = 24, 18


def lattice(spark: SparkSession, nx: int = NX, ny: int = NY) -> DataFrame:
    """id, i, j and two fields of a regular grid; b differs from a here and there."""
    i, j = F.col("id") % nx, F.floor(F.col("id") / nx)
    f = ((i * 37 + j * 91 + i * j * 5) % 101).cast("double")
    return spark.range(nx * ny).select("id", i.alias("i"), j.alias("j"), f.alias("f"), (f + F.when(F.col("id") % 11 == 0, 7.0).otherwise(0.5)).alias("g"))


GRID = f"""WITH p AS (SELECT range AS id, range % {NX} AS i, range // {NX} AS j, CAST(((range % {NX}) * 37 + (range // {NX}) * 91 + (range % {NX}) * (range // {NX}) * 5) % 101 AS DOUBLE) AS f FROM range({NX * NY})),
  l AS (SELECT *, f + CASE WHEN id % 11 = 0 THEN 7.0 ELSE 0.5 END AS g FROM p)"""
NEAR = "FROM l c JOIN l n ON abs(n.i - c.i) <= {r} AND abs(n.j - c.j) <= {r}"


@R.add("image_median", GRID + f""", o AS (SELECT a.range - 1 AS di, b.range - 1 AS dj FROM range(3) a, range(3) b)
  SELECT c.i, c.j, quantile_disc(n.f, 0.5) AS median FROM l c, o JOIN l n ON n.i = least(greatest(c.i + di, 0), {NX - 1}) AND n.j = least(greatest(c.j + dj, 0), {NY - 1}) GROUP BY 1, 2""")
def image_median(spark, d):
    return stencil.image_median(lattice(spark), "f", 1, (NX, NY))


@R.add("box_average", GRID + f" SELECT c.i, c.j, round(avg(n.f), 6) AS average {NEAR.format(r=2)} GROUP BY 1, 2")
def box_average(spark, d):
    return rounded(stencil.box_average(lattice(spark), "f", 2), 6)


@R.add("gradient", GRID + """ SELECT c.i, c.j, round(coalesce((e.f - w.f) * 0.5, e.f - c.f, c.f - w.f), 6) AS gx, round(coalesce((n.f - s.f) * 0.5, n.f - c.f, c.f - s.f), 6) AS gy
  FROM l c LEFT JOIN l e ON e.i = c.i + 1 AND e.j = c.j LEFT JOIN l w ON w.i = c.i - 1 AND w.j = c.j LEFT JOIN l n ON n.i = c.i AND n.j = c.j + 1 LEFT JOIN l s ON s.i = c.i AND s.j = c.j - 1""")
def gradient(spark, d):
    return rounded(stencil.gradient(lattice(spark), "f", (NX, NY)), 6)


@R.add("flow_derivatives", GRID + """, d AS (SELECT c.i, c.j, coalesce((e.f - w.f) * 0.5, e.f - c.f, c.f - w.f) AS ux, coalesce((n.f - s.f) * 0.5, n.f - c.f, c.f - s.f) AS uy,
  coalesce((e.g - w.g) * 0.5, e.g - c.g, c.g - w.g) AS vx, coalesce((n.g - s.g) * 0.5, n.g - c.g, c.g - s.g) AS vy
  FROM l c LEFT JOIN l e ON e.i = c.i + 1 AND e.j = c.j LEFT JOIN l w ON w.i = c.i - 1 AND w.j = c.j LEFT JOIN l n ON n.i = c.i AND n.j = c.j + 1 LEFT JOIN l s ON s.i = c.i AND s.j = c.j - 1)
  SELECT i, j, round(ux + vy, 6) AS divergence, round(vx - uy, 6) AS vorticity, round(-(ux*ux + vy*vy) / 2 - uy*vx, 6) AS q_criterion FROM d""")
def flow_derivatives(spark, d):
    return rounded(stencil.flow_derivatives(lattice(spark), "f", "g", (NX, NY)), 6)


@R.add("image_difference", GRID + " SELECT i, j, round(abs(f - g), 6) AS difference, abs(f - g) > 2 AS exceeds FROM l")
def image_difference(spark, d):
    p = lattice(spark)
    return rounded(stencil.image_difference(p, p.select("i", "j", F.col("g").alias("f")), "f", 2.0), 6)


@R.add("ssim", GRID + f""", w AS (SELECT c.i, c.j, n.f / 101 AS x, n.g / 101 AS y, exp(-((n.i - c.i)*(n.i - c.i) + (n.j - c.j)*(n.j - c.j)) / 2.0) AS w {NEAR.format(r=3)} AND (n.i - c.i)*(n.i - c.i) + (n.j - c.j)*(n.j - c.j) <= 9),
  s AS (SELECT i, j, sum(w*x)/sum(w) AS x, sum(w*y)/sum(w) AS y, sum(w*x*x)/sum(w) AS xx, sum(w*y*y)/sum(w) AS yy, sum(w*x*y)/sum(w) AS xy FROM w GROUP BY 1, 2)
  SELECT i, j, round((2*x*y + 0.0001) * (2*(xy - x*y) + 0.0009) / ((x*x + y*y + 0.0001) * (greatest(xx - x*x, 0) + greatest(yy - y*y, 0) + 0.0009)), 6) AS ssim FROM s""")
def ssim(spark, d):
    p = lattice(spark)
    a, b = p.select("i", "j", (F.col("f") / 101).alias("f")), p.select("i", "j", (F.col("g") / 101).alias("f"))
    return rounded(stencil.ssim(a, b, "f"), 6)


@R.add("moments", GRID + f""" SELECT c.i, c.j, sum(n.f) AS m_00, sum((n.i - c.i) * n.f) AS m_10, sum((n.j - c.j) * n.f) AS m_01 {NEAR.format(r=2)} AND (n.i - c.i)*(n.i - c.i) + (n.j - c.j)*(n.j - c.j) <= 4 GROUP BY 1, 2""")
def moments(spark, d):
    return stencil.moments(lattice(spark), "f", 2, 1)


POINTS = "SELECT s_suppkey AS id, s_suppkey * 37 % 1000 / 10.0 AS x, s_suppkey * 91 % 1000 / 10.0 AS y, s_acctbal AS f FROM supplier"
PARTS = "SELECT p_partkey AS id, p_partkey * 53 % 1000 / 10.0 AS x, p_partkey * 71 % 1000 / 10.0 AS y FROM part"


def suppliers(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (k * 37 % 1000 / 10.0).alias("x"), (k * 91 % 1000 / 10.0).alias("y"), F.col("s_acctbal").alias("f"))


def parts(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("id"), (k * 53 % 1000 / 10.0).alias("x"), (k * 71 % 1000 / 10.0).alias("y"))


@R.add("within_distance", f"WITH a AS ({PARTS}), b AS ({POINTS}) SELECT a.id AS q_id, b.id AS p_id, round((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), 4) AS d2 FROM a, b WHERE (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) <= 16.00001")
def within_distance(spark, d):
    return spatial.within_distance(parts(spark, d), suppliers(spark, d), ["x", "y"], 4.0000012, digits=4)


@R.add("nearest_point", f"WITH a AS ({PARTS}), b AS ({POINTS}), r AS (SELECT a.id AS q_id, b.id AS p_id, round((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y), 4) AS d2 FROM a, b) SELECT q_id, min(d2) AS d2 FROM r GROUP BY 1")
def nearest_point(spark, d):
    return rounded(spatial.nearest(parts(spark, d), suppliers(spark, d), ["x", "y"], 5.0)).select("q_id", "d2")


@R.add("friends_of_friends", f"""WITH RECURSIVE b AS ({POINTS}), s AS (SELECT p.id AS a, q.id AS b FROM b p JOIN b q ON (p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) <= 30.25001),
  w AS (SELECT DISTINCT a AS id, a AS r FROM s UNION SELECT w.id, s.b FROM w JOIN s ON w.r = s.a), l AS (SELECT id, min(r) AS label FROM w GROUP BY 1) SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS halo FROM l""")
def friends_of_friends(spark, d):
    return spatial.friends_of_friends(suppliers(spark, d), ["x", "y"], 5.5000009)


@R.add("locate_in_boxes", f"WITH a AS ({PARTS}), b AS ({POINTS}) SELECT a.id, b.id AS box FROM a JOIN b ON a.x BETWEEN b.x - 3 AND b.x + 3 AND a.y BETWEEN b.y - 2 AND b.y + 2")
def locate_in_boxes(spark, d):
    boxes = suppliers(spark, d).select(F.col("id").alias("box"), (F.col("x") - 3).alias("lo_x"), (F.col("x") + 3).alias("hi_x"), (F.col("y") - 2).alias("lo_y"), (F.col("y") + 2).alias("hi_y"))
    return spatial.locate_in_boxes(parts(spark, d), boxes, ["x", "y"], 6.0)


@R.add("probe", GRID + f""", q AS ({PARTS}), u AS (SELECT id, x / 4.0 AS u, y / 5.0 AS v, x / 4.0 <= {NX - 1} AND y / 5.0 <= {NY - 1} AS inside FROM q), c AS (SELECT *, least(floor(u), {NX - 2}) AS ci, least(floor(v), {NY - 2}) AS cj FROM u)
  SELECT c.id, round((1-u+ci)*(1-v+cj)*a.f + (u-ci)*(1-v+cj)*b.f + (1-u+ci)*(v-cj)*e.f + (u-ci)*(v-cj)*h.f, 6) AS f, CASE WHEN inside THEN 0 ELSE 2 END AS hidden
  FROM c LEFT JOIN l a ON inside AND a.i = ci AND a.j = cj LEFT JOIN l b ON inside AND b.i = ci + 1 AND b.j = cj LEFT JOIN l e ON inside AND e.i = ci AND e.j = cj + 1 LEFT JOIN l h ON inside AND h.i = ci + 1 AND h.j = cj + 1""")
def probe(spark, d):
    out = spatial.probe(parts(spark, d), lattice(spark), "f", (NX, NY), (0.0, 0.0), (4.0, 5.0))
    return rounded(out.withColumn("f", F.when(~F.isnan("f"), F.col("f"))), 6)  # null for NaN, which SQL results can't compare


@R.add("merge_points", f"WITH b AS ({POINTS}) SELECT min(id) AS id, count(*) AS merged, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(f), 4) AS f FROM b GROUP BY floor(x / 10), floor(y / 10)")
def merge_points(spark, d):
    out = spatial.merge_points(suppliers(spark, d), ["x", "y"], 10.0, ["f"])
    return out.select("id", "merged", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("f", 4).alias("f"))


@R.add("merge_datasets", "SELECT c_custkey AS id, c_acctbal AS a, NULL::DOUBLE AS b FROM customer UNION ALL SELECT s_suppkey + (SELECT count(*) FROM customer), NULL, s_acctbal FROM supplier")
def merge_datasets(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("b"))
    out = spatial.merge_partitions([a, b], "id")
    return out.select("id", *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("a", "b")))


BLOCKS = "SELECT range AS block, range % 3 AS level, range * 13 % 40 * 1.0 AS lo_x, range * 13 % 40 + 8.0 / (1 + range % 3) AS hi_x, range * 7 % 30 * 1.0 AS lo_y, range * 7 % 30 + 8.0 / (1 + range % 3) AS hi_y FROM range(60)"


@R.add("amr_blanking", f"""WITH b AS ({BLOCKS}) SELECT block, level, row_number() OVER (PARTITION BY level ORDER BY block) - 1 AS number,
  CASE WHEN EXISTS (SELECT 1 FROM b f WHERE f.level = b.level + 1 AND f.lo_x < b.hi_x AND b.lo_x < f.hi_x AND f.lo_y < b.hi_y AND b.lo_y < f.hi_y) THEN 8 ELSE 0 END AS ghost FROM b""")
def amr_blanking(spark, d):
    i = F.col("id")
    size = 8.0 / (1 + i % 3)
    x, y = (i * 13 % 40).cast("double"), (i * 7 % 30).cast("double")
    blocks = spark.range(60).select(i.alias("block"), (i % 3).alias("level"), x.alias("lo_x"), (x + size).alias("hi_x"), y.alias("lo_y"), (y + size).alias("hi_y"))
    return spatial.amr_blanking(blocks, 8.0).withColumn("number", F.col("number").cast("long"))


# Meshes: a bent sheet of quadrilaterals, or triangles, and a block of hexahedra.


def sheet_points(spark):
    i, j = (F.col("id") % NX).cast("double"), F.floor(F.col("id") / NX).cast("double")
    return spark.range(NX * NY).select("id", (i + 0.1 * (j % 3)).alias("x"), (j + 0.05 * (i % 4)).alias("y"), (0.02 * i * j).alias("z"), ((i - 11) * (i - 11) + (j - 8) * (j - 8) + 0.5).alias("f"))


def quads(spark):
    a = F.floor(F.col("id") / (NX - 1)) * NX + F.col("id") % (NX - 1)
    return spark.range((NX - 1) * (NY - 1)).select(F.col("id").alias("cell"), F.lit("quad").alias("shape"), F.array(a, a + 1, a + NX + 1, a + NX).alias("conn"))


def triangles(spark):
    return mesh.triangulate(quads(spark)).select(F.expr("cell * 2 + IF(b - a = 1, 0, 1)").alias("cell"), F.lit("triangle").alias("shape"), F.array("a", "b", "c").alias("conn"))


SHEET = f"""WITH p AS (SELECT range AS id, CAST(range % {NX} AS DOUBLE) AS i, CAST(range // {NX} AS DOUBLE) AS j FROM range({NX * NY})),
  v AS (SELECT id, i + 0.1 * (j % 3) AS x, j + 0.05 * (i % 4) AS y, 0.02 * i * j AS z, (i - 11) * (i - 11) + (j - 8) * (j - 8) + 0.5 AS f FROM p),
  k AS (SELECT range AS q, range // {NX - 1} * {NX} + range % {NX - 1} AS a FROM range({(NX - 1) * (NY - 1)})),
  t AS (SELECT q * 2 AS cell, a, a + 1 AS b, a + {NX + 1} AS c FROM k UNION ALL SELECT q * 2 + 1, a, a + {NX + 1}, a + {NX} FROM k),
  s AS (SELECT cell, a.x AS ax, a.y AS ay, a.z AS az, a.f AS af, b.x AS bx, b.y AS by_, b.z AS bz, b.f AS bf, c.x AS cx, c.y AS cy, c.z AS cz, c.f AS cf FROM t JOIN v a ON t.a = a.id JOIN v b ON t.b = b.id JOIN v c ON t.c = c.id),
  e AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)+(bz-az)*(bz-az)) AS l0, sqrt((cx-bx)*(cx-bx)+(cy-by_)*(cy-by_)+(cz-bz)*(cz-bz)) AS l1, sqrt((cx-ax)*(cx-ax)+(cy-ay)*(cy-ay)+(cz-az)*(cz-az)) AS l2 FROM s),
  m AS (SELECT *, sqrt(pow((by_-ay)*(cz-az)-(bz-az)*(cy-ay), 2) + pow((bz-az)*(cx-ax)-(bx-ax)*(cz-az), 2) + pow((bx-ax)*(cy-ay)-(by_-ay)*(cx-ax), 2)) / 2 AS area FROM e)"""
TRIANGLE_SQL = {
    "area": "area",
    "max_angle": "degrees(acos(least((l0*l0+l1*l1-l2*l2)/(2*l0*l1), (l1*l1+l2*l2-l0*l0)/(2*l1*l2), (l0*l0+l2*l2-l1*l1)/(2*l0*l2))))",
    "min_angle": "degrees(acos(greatest((l0*l0+l1*l1-l2*l2)/(2*l0*l1), (l1*l1+l2*l2-l0*l0)/(2*l1*l2), (l0*l0+l2*l2-l1*l1)/(2*l0*l2))))",
    "aspect_ratio": "greatest(l0, l1, l2) * (l0 + l1 + l2) / (4 * sqrt(3) * area)",
    "condition": "(l0*l0 + l2*l2 - (l0*l0 + l2*l2 - l1*l1)/2) / (2 * area * sqrt(3))",
    "shape": "2 * area * sqrt(3) / (l0*l0 + l2*l2 - (l0*l0 + l2*l2 - l1*l1)/2)",
    "scaled_jacobian": "4 * area / sqrt(3) / greatest(l0*l1, l1*l2, l2*l0)",
}


def _quality(metric: str) -> None:
    @R.add(f"quality_triangle_{metric}", f"{SHEET} SELECT cell, round({TRIANGLE_SQL[metric]}, 5) AS quality FROM m")
    def run(spark, d):
        return rounded(quality.quality(triangles(spark), sheet_points(spark), metric), 5)


for _metric in TRIANGLE_SQL:
    _quality(_metric)


@R.add("relative_size_squared", f"{SHEET}, r AS (SELECT cell, area / avg(area) OVER () AS r FROM m) SELECT cell, round(pow(least(r, 1 / r), 2), 5) AS quality FROM r")
def relative_size_squared(spark, d):
    return rounded(quality.relative_size_squared(triangles(spark), sheet_points(spark)), 5)


@R.add("quality_triangle_shape_and_size", f"{SHEET}, r AS (SELECT cell, area / avg(area) OVER () AS r, {TRIANGLE_SQL['shape']} AS shape FROM m) SELECT cell, round(shape * pow(least(r, 1 / r), 2), 5) AS quality FROM r")
def quality_triangle_shape_and_size(spark, d):
    return rounded(quality.shape_and_size(triangles(spark), sheet_points(spark)), 5)


@R.add("cell_measures", f"{SHEET} SELECT cell, round(area, 5) AS measure FROM m")
def cell_measures(spark, d):
    return rounded(mesh.corners(triangles(spark), sheet_points(spark)).select("cell", mesh.measure(F.col("shape"), F.col("p")).alias("measure")), 5)


@R.add("triangulate", SHEET + " SELECT cell, a, b, c FROM t")
def triangulate(spark, d):
    return triangles(spark).select("cell", *(F.col("conn")[k].alias(c) for k, c in enumerate("abc")))


@R.add("shrink", SHEET + ", m3 AS (SELECT cell, (ax+bx+cx)/3 AS mx, (ay+by_+cy)/3 AS my, (az+bz+cz)/3 AS mz FROM s), w AS (SELECT cell, 0 AS k, ax AS x, ay AS y, az AS z FROM s UNION ALL SELECT cell, 1, bx, by_, bz FROM s UNION ALL SELECT cell, 2, cx, cy, cz FROM s) SELECT cell, k, round(mx + 0.5*(x-mx), 6) AS x, round(my + 0.5*(y-my), 6) AS y, round(mz + 0.5*(z-mz), 6) AS z FROM w JOIN m3 USING (cell)")
def shrink(spark, d):
    return rounded(mesh.shrink(triangles(spark), sheet_points(spark)), 6)


@R.add("contour", SHEET + """, h AS (SELECT cell, ax + (60-af)/(bf-af)*(bx-ax) AS x, ay + (60-af)/(bf-af)*(by_-ay) AS y FROM s WHERE (af >= 60) <> (bf >= 60)
  UNION ALL SELECT cell, bx + (60-bf)/(cf-bf)*(cx-bx), by_ + (60-bf)/(cf-bf)*(cy-by_) FROM s WHERE (bf >= 60) <> (cf >= 60)
  UNION ALL SELECT cell, cx + (60-cf)/(af-cf)*(ax-cx), cy + (60-cf)/(af-cf)*(ay-cy) FROM s WHERE (cf >= 60) <> (af >= 60))
  SELECT cell, round(sum(x), 5) AS sx, round(sum(y), 5) AS sy, count(*) AS n FROM h GROUP BY 1""")
def contour(spark, d):
    lines = mesh.contour_lines(triangles(spark), sheet_points(spark), "f", 60.0)
    return rounded(lines.select("cell", (F.col("x0") + F.col("x1")).alias("sx"), (F.col("y0") + F.col("y1")).alias("sy"), F.lit(2).cast("long").alias("n")), 5)


@R.add("clip_with_field")
def clip_with_field(spark, d):
    return rounded(mesh.clip_area(triangles(spark), sheet_points(spark), "f", 60.0), 5)


@R.add("slice_plane", SHEET + """, g AS (SELECT cell, ax, ay, ax + ay - 20.25 AS af, bx, by_, bx + by_ - 20.25 AS bf, cx, cy, cx + cy - 20.25 AS cf FROM s),
  h AS (SELECT cell, ax - af/(bf-af)*(bx-ax) AS x, ay - af/(bf-af)*(by_-ay) AS y FROM g WHERE (af >= 0) <> (bf >= 0)
  UNION ALL SELECT cell, bx - bf/(cf-bf)*(cx-bx), by_ - bf/(cf-bf)*(cy-by_) FROM g WHERE (bf >= 0) <> (cf >= 0)
  UNION ALL SELECT cell, cx - cf/(af-cf)*(ax-cx), cy - cf/(af-cf)*(ay-cy) FROM g WHERE (cf >= 0) <> (af >= 0))
  SELECT cell, round(sum(x), 5) AS sx, round(sum(y), 5) AS sy FROM h GROUP BY 1""")
def slice_plane(spark, d):
    points = sheet_points(spark).withColumn("f", F.col("x") + F.col("y") - 20.25)
    lines = mesh.contour_lines(triangles(spark), points, "f", 0.0)
    return rounded(lines.select("cell", (F.col("x0") + F.col("x1")).alias("sx"), (F.col("y0") + F.col("y1")).alias("sy")), 5)


@R.add("extrude_linear", SHEET + f" SELECT id + range * {NX * NY} AS id, round(x + range * 0.5, 6) AS x, y, round(z + range * 2.0, 6) AS z FROM v, range(3)")
def extrude_linear(spark, d):
    out = mesh.extrude(sheet_points(spark).select("id", "x", "y", "z"), 3, NX * NY, (0.5, 0.0, 2.0))
    return out.select("id", F.round("x", 6).alias("x"), "y", F.round("z", 6).alias("z"))


BX = 5  # points to a side of the block


def brick_points(spark):
    i = F.col("id")
    x, y, z = (i % BX).cast("double"), (F.floor(i / BX) % BX).cast("double"), F.floor(i / BX**2).cast("double")
    return spark.range(BX**3).select("id", (x + 0.1 * y).alias("x"), (y + 0.05 * z).alias("y"), (z + 0.02 * x * y).alias("z"))


def bricks(spark):
    n, i = BX - 1, F.col("id")
    a = i % n + F.floor(i / n) % n * BX + F.floor(i / n**2) * BX**2
    conn = [a, a + 1, a + 1 + BX, a + BX]
    return spark.range(n**3).select(i.alias("cell"), F.lit("hexahedron").alias("shape"), F.array(*conn, *(c + BX**2 for c in conn)).alias("conn"))


BRICK = f"""WITH k AS (SELECT range AS cell, range % {BX - 1} + range // {BX - 1} % {BX - 1} * {BX} + range // {(BX - 1) ** 2} * {BX**2} AS a FROM range({(BX - 1) ** 3})),
  o AS (SELECT * FROM (VALUES ([0,{BX},{BX**2 + BX},{BX**2}]), ([1,{BX + 1},{BX**2 + BX + 1},{BX**2 + 1}]), ([0,1,{BX**2 + 1},{BX**2}]), ([{BX},{BX + 1},{BX**2 + BX + 1},{BX**2 + BX}]), ([0,1,{BX + 1},{BX}]), ([{BX**2},{BX**2 + 1},{BX**2 + BX + 1},{BX**2 + BX}])) t(f)),
  w AS (SELECT cell, list_sort(list_transform(f, lambda x: x + a)) AS face FROM k, o)"""


@R.add("external_faces", BRICK + " SELECT any_value(cell) AS cell, face FROM w GROUP BY face HAVING count(*) = 1")
def external_faces(spark, d):
    return mesh.external_faces(bricks(spark)).select("cell", F.array_sort("face").alias("face"))


@R.add("tetrahedralize_count", f"SELECT range AS cell, 5::BIGINT AS tetras FROM range({(BX - 1) ** 3})")
def tetrahedralize_count(spark, d):
    return mesh.tetrahedralize(bricks(spark)).groupBy("cell").agg(F.count("*").alias("tetras"))


def sub(a: str, b: str) -> str:
    return f"array_value({a}[1]-{b}[1], {a}[2]-{b}[2], {a}[3]-{b}[3])"


def add(*v: str) -> str:
    return "array_value(" + ", ".join("+".join(f"{x}[{k}]" for x in v) for k in (1, 2, 3)) + ")"


def inner(a: str, b: str) -> str:
    return f"array_inner_product({a}, {b})"


def size(a: str) -> str:
    return f"sqrt(array_inner_product({a}, {a}))"


def over(a: str, b: str) -> str:
    return f"array_cross_product({a}, {b})"


def at(ids: list[str]) -> str:
    """Joins the points under ids as p0, p1 and so on."""
    return ", ".join(f"array_value(v{k}.x, v{k}.y, v{k}.z) AS p{k}" for k in range(len(ids))) + " FROM k " + " ".join(f"JOIN v v{k} ON v{k}.id = {x}" for k, x in enumerate(ids))


def folded_quads(spark):
    """quads(), but each seventh is an arrowhead."""
    i, j, a = F.col("cell") % (NX - 1), F.floor(F.col("cell") / (NX - 1)), F.get("conn", F.lit(0))
    head = F.array(a, a + NX + 2, a + NX + 1, a + 2 * NX + 1)
    return quads(spark).withColumn("conn", F.when((F.col("cell") % 7 == 3) & (i < NX - 2) & (j < NY - 2), head).otherwise(F.col("conn")))


_HEAD = f"q % 7 = 3 AND q % {NX - 1} < {NX - 2} AND q // {NX - 1} < {NY - 2}"
QUAD = (
    SHEET
    + f", c AS (SELECT q AS cell, {at(['k.a', f'k.a + CASE WHEN {_HEAD} THEN {NX + 2} ELSE 1 END', f'k.a + {NX + 1}', f'k.a + CASE WHEN {_HEAD} THEN {2 * NX + 1} ELSE {NX} END'])}),"
    + f" g AS (SELECT *, [{sub('p0', 'p3')}, {sub('p1', 'p0')}, {sub('p2', 'p1')}, {sub('p3', 'p2')}] AS e, {add(sub('p1', 'p0'), sub('p2', 'p3'))} AS x1, {add(sub('p2', 'p1'), sub('p3', 'p0'))} AS x2 FROM c),"
    + f" h AS (SELECT *, unnest([1, 2, 3, 4]) AS n, {over('x1', 'x2')} AS m FROM g),"
    + f" f AS (SELECT *, e[n] AS u, e[n % 4 + 1] AS w, {inner(over('e[n]', 'e[n % 4 + 1]'), 'm')} / {size('m')} AS alpha FROM h)"
)
_SQUARES = f"({inner('u', 'u')} + {inner('w', 'w')})"
_NORMAL = f"({over('u', 'w')})"
_WARP = [f"{inner(over(a, b), over(c, d))} / ({size(over(a, b))} * {size(over(c, d))})" for a, b, c, d in (("e[1]", "e[2]", "e[3]", "e[4]"), ("e[2]", "e[3]", "e[4]", "e[1]"))]
_DIAGONALS = [size(sub("p2", "p0")), size(sub("p3", "p1"))]
QUAD_SQL = {
    "area": "sum(alpha) / 4", "jacobian": "min(alpha)", "scaled_jacobian": f"min(alpha / ({size('u')} * {size('w')}))", "shear": f"min(alpha / ({size('u')} * {size('w')}))",
    "condition": f"max({_SQUARES} / alpha) / 2", "shape": f"2 * min(alpha / {_SQUARES})", "aspect_ratio": f"max(greatest({size('x1')} / {size('x2')}, {size('x2')} / {size('x1')}))",
    "skew": f"max(abs({inner('x1', 'x2')}) / ({size('x1')} * {size('x2')}))", "taper": f"max({size(add(sub('p0', 'p1'), sub('p2', 'p3')))} / least({size('x1')}, {size('x2')}))",
    "stretch": f"sqrt(2) * min({size('u')}) / max(greatest({', '.join(_DIAGONALS)}))", "diagonal_ratio": f"max(least({', '.join(_DIAGONALS)}) / greatest({', '.join(_DIAGONALS)}))",
    "warpage": f"min(pow(least({', '.join(_WARP)}), 3))", "oddy": f"max((pow({inner('u', 'u')} - {inner('w', 'w')}, 2) + 4 * pow({inner('u', 'w')}, 2)) / (2 * {inner(_NORMAL, _NORMAL)}))",
    "max_angle": f"max(degrees(acos(-{inner('u', 'w')} / ({size('u')} * {size('w')}))))", "min_angle": f"min(degrees(acos(-{inner('u', 'w')} / ({size('u')} * {size('w')}))))",
}


def turned_bricks(spark):
    """bricks(), but each seventh is inside out."""
    return bricks(spark).withColumn("conn", F.when(F.col("cell") % 7 == 3, F.concat(F.slice("conn", 5, 4), F.slice("conn", 1, 4))).otherwise(F.col("conn")))


def turned_tetras(spark):
    """The first corner of each brick; each seventh is inside out."""
    p = lambda k: F.get("conn", F.lit(k))
    turned = F.col("cell") % 7 == 3
    return bricks(spark).select("cell", F.lit("tetra").alias("shape"), F.array(F.when(turned, p(1)).otherwise(p(0)), F.when(turned, p(0)).otherwise(p(1)), p(3), p(4)).alias("conn"))


_STEPS = [0, 1, BX + 1, BX, BX**2, BX**2 + 1, BX**2 + BX + 1, BX**2 + BX]
_BLOCK = (
    BRICK.split(",\n  o AS")[0]
    + f", b AS (SELECT range AS id, CAST(range % {BX} AS DOUBLE) AS x, CAST(range // {BX} % {BX} AS DOUBLE) AS y, CAST(range // {BX**2} AS DOUBLE) AS z FROM range({BX**3})), v AS (SELECT id, x + 0.1 * y AS x, y + 0.05 * z AS y, z + 0.02 * x * y AS z FROM b)"
)
_TURNED = [f"k.a + CASE WHEN cell % 7 = 3 THEN {_STEPS[(k + 4) % 8]} ELSE {_STEPS[k]} END" for k in range(8)]
_HEX_AXES = [add(*(sub(f"p{a}", f"p{b}") for a, b in pairs)) for pairs in (((1, 0), (2, 3), (5, 4), (6, 7)), ((3, 0), (2, 1), (7, 4), (6, 5)), ((4, 0), (5, 1), (6, 2), (7, 3)))]
_ENDS = "(0, 1, 3, 4), (1, 2, 0, 5), (2, 3, 1, 6), (3, 0, 2, 7), (4, 7, 5, 0), (5, 4, 6, 1), (6, 5, 7, 2), (7, 6, 4, 3)"
HEX = (
    _BLOCK
    + f", c AS (SELECT cell, {at(_TURNED)}), g AS (SELECT *, [p0, p1, p2, p3, p4, p5, p6, p7] AS p, {_HEX_AXES[0]} AS x1, {_HEX_AXES[1]} AS x2, {_HEX_AXES[2]} AS x3 FROM c), n AS (SELECT * FROM (VALUES {_ENDS}) t(o, i, j, l)),"
    + f" fr AS (SELECT g.*, o, {sub('p[i+1]', 'p[o+1]')} AS r, {sub('p[j+1]', 'p[o+1]')} AS s, {sub('p[l+1]', 'p[o+1]')} AS t FROM g, n UNION ALL SELECT g.*, 8, array_value(x1[1]/4, x1[2]/4, x1[3]/4), array_value(x2[1]/4, x2[2]/4, x2[3]/4), array_value(x3[1]/4, x3[2]/4, x3[3]/4) FROM g),"
    + f" f AS (SELECT *, {inner(over('r', 's'), 't')} AS det, {inner('r', 'r')} + {inner('s', 's')} + {inner('t', 't')} AS sq, {' + '.join(inner(over(a, b), over(a, b)) for a, b in ('rs', 'st', 'tr'))} AS ms FROM fr)"
)
_LONG = [size(f"x{k}") for k in (1, 2, 3)]
_BODY = [size(sub(f"p{b}", f"p{a}")) for a, b in ((0, 6), (1, 7), (2, 4), (3, 5))]
_UNLIKE = f"(pow({inner('r', 'r')}, 2) + pow({inner('s', 's')}, 2) + pow({inner('t', 't')}, 2) + 2 * (pow({inner('r', 's')}, 2) + pow({inner('s', 't')}, 2) + pow({inner('r', 't')}, 2)) - sq * sq / 3)"
_OTHER = [add(*(sub(f"p{a}", f"p{b}") for a, b in pairs)) for pairs in (((0, 1), (2, 3), (4, 5), (6, 7)), ((0, 1), (3, 2), (5, 4), (6, 7)), ((0, 3), (1, 2), (6, 5), (7, 4)))]
HEX_SQL = {
    "jacobian": "min(det)", "scaled_jacobian": f"min(det / ({size('r')} * {size('s')} * {size('t')}))", "shear": f"min(det / ({size('r')} * {size('s')} * {size('t')})) FILTER (o < 8)",
    "shape": "CASE WHEN min(det) <= 0 THEN 0 ELSE min(3 * pow(greatest(det, 0), 2.0 / 3) / sq) END",
    "condition": "CASE WHEN min(det) FILTER (o < 8) <= 0 THEN CAST('inf' AS DOUBLE) ELSE max(sqrt(sq * ms) / (3 * det)) FILTER (o < 8) END",
    "oddy": f"CASE WHEN min(det) <= 0 THEN CAST('inf' AS DOUBLE) ELSE max({_UNLIKE} / pow(abs(det), 4.0 / 3)) END",
    "aspect_ratio": f"max(greatest({', '.join(_LONG)}) / least({', '.join(_LONG)}))",
    "taper": f"max(greatest({', '.join(f'{size(x)} / least({_LONG[a]}, {_LONG[b]})' for x, (a, b) in zip(_OTHER, ((0, 1), (0, 2), (1, 2))))}))",
    "skew": f"max(greatest({', '.join(f'abs({inner(f"x{a}", f"x{b}")}) / ({size(f"x{a}")} * {size(f"x{b}")})' for a, b in ((1, 2), (2, 3), (3, 1)))}))",
    "stretch": f"sqrt(3) * min(least({size('r')}, {size('s')}, {size('t')})) FILTER (o < 8) / max(greatest({', '.join(_BODY)}))",
    "diagonal_ratio": f"max(least({', '.join(_BODY)}) / greatest({', '.join(_BODY)}))", "max_diagonal": f"max(greatest({', '.join(_BODY)}))", "min_diagonal": f"max(least({', '.join(_BODY)}))",
}
TETRA = (
    _BLOCK
    + f", c AS (SELECT cell, {at(['k.a + CASE WHEN cell % 7 = 3 THEN 1 ELSE 0 END', 'k.a + CASE WHEN cell % 7 = 3 THEN 0 ELSE 1 END', f'k.a + {BX}', f'k.a + {BX**2}'])}),"
    + f" g AS (SELECT *, {sub('p1', 'p0')} AS u, {sub('p2', 'p0')} AS w, {sub('p3', 'p0')} AS z, {sub('p2', 'p1')} AS d, {sub('p3', 'p1')} AS e, {sub('p3', 'p2')} AS q FROM c),"
    + f" h AS (SELECT *, {inner(over('u', 'w'), 'z')} AS det, {size('u')} AS lu, {size('w')} AS lw, {size('z')} AS lz, {size('d')} AS ld, {size('e')} AS le, {size('q')} AS lq,"
    + " array_value((2*w[1]-u[1])/sqrt(3), (2*w[2]-u[2])/sqrt(3), (2*w[3]-u[3])/sqrt(3)) AS s, array_value((3*z[1]-w[1]-u[1])/sqrt(6), (3*z[2]-w[2]-u[2])/sqrt(6), (3*z[3]-w[3]-u[3])/sqrt(6)) AS t FROM g),"
    + f" f AS (SELECT *, {inner(over('u', 's'), 't')} AS own, {inner('u', 'u')} + {inner('s', 's')} + {inner('t', 't')} AS sq, {' + '.join(inner(over(a, b), over(a, b)) for a, b in ('us', 'st', 'tu'))} AS ms FROM h)"
)
_LENGTHS = "lu, lw, lz, ld, le, lq"
TETRA_SQL = {
    "volume": "det / 6", "jacobian": "det", "aspect_gamma": "pow((lu*lu + lw*lw + lz*lz + ld*ld + le*le + lq*lq) / 6, 1.5) * sqrt(2) / (12 * abs(det / 6))",
    "aspect_ratio": f"greatest({_LENGTHS}) * ({size(over('u', 'w'))} + {size(over('u', 'z'))} + {size(over('w', 'z'))} + {size(over('d', 'e'))}) / 2 / (sqrt(6) * abs(det))",
    "scaled_jacobian": "sqrt(2) * det / greatest(lu * lw * lz, lu * ld * le, lw * ld * lq, lz * le * lq, det)",
    "condition": "CASE WHEN own <= 0 THEN CAST('inf' AS DOUBLE) ELSE sqrt(sq * ms) / (3 * own) END", "shape": "CASE WHEN own <= 0 THEN 0 ELSE 3 * pow(greatest(own, 0), 2.0 / 3) / sq END",
}


def _quality_of(shape: str, metric: str, sql: str, cells, points) -> None:
    @R.add(f"quality_{shape}_{metric}", sql)
    def run(spark, d):
        return rounded(quality.quality(cells(spark), points(spark), metric), 5)


for _metric, _sql in QUAD_SQL.items():
    _quality_of("quad", _metric, f"{QUAD} SELECT cell, round({_sql}, 5) AS quality FROM f GROUP BY cell", folded_quads, sheet_points)
for _metric, _sql in HEX_SQL.items():
    _quality_of("hexahedron", _metric, f"{HEX} SELECT cell, round({_sql}, 5) AS quality FROM f GROUP BY cell", turned_bricks, brick_points)
for _metric, _sql in TETRA_SQL.items():
    _quality_of("tetra", _metric, f"{TETRA} SELECT cell, round({_sql}, 5) AS quality FROM f", turned_tetras, brick_points)
#: The volume of a trilinear brick from three-point Gauss rules, and its gradient by the corners likewise.
_SHAPE = [f"({'x' if c[0] else '(1-x)'})*({'y' if c[1] else '(1-y)'})*({'w' if c[2] else '(1-w)'})" for c in mesh.CUBE]
_SLOPES = [[("" if c[k] else "-") + "*".join([("1" if m == k else (n if c[m] else f"(1-{n})")) for m, n in enumerate("xyw")]) for c in mesh.CUBE] for k in range(3)]
_JAC = ["array_value(" + ", ".join("+".join(f"({sl})*p{k}[{m}]" for k, sl in enumerate(_SLOPES[axis])) for m in (1, 2, 3)) + ")" for axis in range(3)]
_DIM = (
    HEX.split(", g AS")[0]
    + ", ga AS (SELECT * FROM (VALUES (0.5 - sqrt(0.15), 5.0/18), (0.5, 8.0/18), (0.5 + sqrt(0.15), 5.0/18)) t(x, wt)),"
    + f" pt AS (SELECT c.*, a.x AS x, b.x AS y, d.x AS w, a.wt * b.wt * d.wt AS wt FROM c, ga a, ga b, ga d), jj AS (SELECT *, {_JAC[0]} AS j1, {_JAC[1]} AS j2, {_JAC[2]} AS j3 FROM pt),"
    + f" vol AS (SELECT cell, sum(wt * {inner(over('j1', 'j2'), 'j3')}) AS volume FROM jj GROUP BY 1),"
    + " slopes AS (" + " UNION ALL ".join(f"SELECT cell, {k} AS corner, unnest([1, 2, 3]) AS m, wt, j1, j2, j3, {_SLOPES[0][k]} AS d1, {_SLOPES[1][k]} AS d2, {_SLOPES[2][k]} AS d3 FROM jj" for k in range(8)) + "),"
    + f" gr AS (SELECT cell, corner, m, sum(wt * (d1 * {over('j2', 'j3')}[m] + d2 * {over('j3', 'j1')}[m] + d3 * {over('j1', 'j2')}[m])) AS b FROM slopes GROUP BY 1, 2, 3)"
)
_quality_of("hexahedron", "dimension", f"{_DIM} SELECT cell, round(any_value(sqrt(0.5 * volume * volume)) / sqrt(sum(b * b)), 5) AS quality FROM gr JOIN vol USING (cell) GROUP BY cell", turned_bricks, brick_points)


@R.add("quality_hexahedron_volume", f"{_BLOCK}, c AS (SELECT cell, {at(_TURNED)}), t AS (SELECT cell, unnest([" + ", ".join(f"{inner(over(sub(f'p{b}', f'p{a}'), sub(f'p{c}', f'p{a}')), sub(f'p{d}', f'p{a}'))}" for a, b, c, d in mesh.five_tetras(0)) + "]) / 6 AS v FROM c) SELECT cell, round(sum(v), 5) AS quality FROM t GROUP BY cell")
def quality_hexahedron_volume(spark, d):
    return rounded(quality.quality(turned_bricks(spark), brick_points(spark), "volume"), 5)


@R.add("total_measure", f"{SHEET} SELECT round(sum(area), 5) AS total, round(avg(area), 5) AS average FROM m")
def total_measure(spark, d):
    return rounded(quality.total_measure(triangles(spark), sheet_points(spark)), 5)


@R.add("surface_normals")
def surface_normals(spark, d):
    return rounded(mesh.surface_normals(triangles(spark), sheet_points(spark)), 5)


@R.add("dual_graph", SHEET + f""", g AS (SELECT q AS cell, unnest([[a, a+1], [a+1, a+{NX + 1}], [a+{NX}, a+{NX + 1}], [a, a+{NX}]]) AS edge FROM k) SELECT x.cell AS a, y.cell AS b FROM g x JOIN g y ON x.edge = y.edge AND x.cell < y.cell""")
def dual_graph(spark, d):
    edges = mesh.dual_edges(quads(spark))
    return edges.alias("x").join(edges.alias("y"), "edge").where("x.cell < y.cell").select(F.col("x.cell").alias("a"), F.col("y.cell").alias("b"))


@R.add("vertex_clustering")
def vertex_clustering(spark, d):
    cells = triangles(spark).select("cell", *(F.col("conn")[k].alias(c) for k, c in enumerate("abc")))
    return spatial.vertex_clusters(sheet_points(spark), cells, (0.0, 0.0), (24.0, 18.0), 6)[1]


@R.add("remove_unused_points", f"SELECT range AS id FROM range({NX * (NY - 1)})")
def remove_unused_points(spark, d):
    return mesh.used_points(quads(spark).where(f"cell < {(NX - 1) * (NY - 2)}"), sheet_points(spark)).select("id")
