"""Queries of surfaces and pieces of a block of hexahedra whose size follows the number of orders, so that they grow with the tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.operators import mesh, volumes
from tesserae.plans.field_queries import rounded
from tesserae.plans.registry import Registry, table

R = Registry()


def side(spark, d) -> int:
    """Points to a side: 6 at a thousandth of the scale, 24 at a tenth."""
    return max(4, round(table(spark, d, "orders").count() ** (1 / 3) / 2))


def block_points(spark, d):
    n, i = side(spark, d), F.col("id")
    x, y, z = (i % n).cast("double"), (F.floor(i / n) % n).cast("double"), F.floor(i / (n * n)).cast("double")
    x, y, z = x + 0.125 * (y % 2), y + 0.0625 * (z % 3), z
    f = (x - n / 2) * (x - n / 2) + (y - n / 2) * (y - n / 2) + (z - n / 2) * (z - n / 2) + 0.3
    return spark.range(n**3).select("id", x.alias("x"), y.alias("y"), z.alias("z"), f.alias("f"))


def blocks(spark, d):
    n = side(spark, d)
    m, i = n - 1, F.col("id")
    cx, cy, cz = i % m, F.floor(i / m) % m, F.floor(i / m**2)
    a = cx + cy * n + cz * n * n
    conn = [a, a + 1, a + 1 + n, a + n]
    return spark.range(m**3).select(i.alias("cell"), F.lit("hexahedron").alias("shape"), F.array(*conn, *(c + n * n for c in conn)).alias("conn"), ((cx + cy + cz) % 2).alias("parity"))


def _tables() -> str:
    rows = [f"({p}, {k}, {c}, {o[0]}, {o[1]}, {o[2]})" for p in (0, 1) for k, t in enumerate(mesh.five_tetras(p)) for c, o in enumerate(mesh.CUBE[x] for x in t)]
    return ", ".join(rows)


BLOCK = f"""WITH n AS (SELECT greatest(4, CAST(round(pow(count(*), 1.0 / 3) / 2) AS BIGINT)) AS n FROM orders), g AS (SELECT n.n, unnest(range(n.n * n.n * n.n)) AS id FROM n),
  c0 AS (SELECT n, id, id % n AS i, id // n % n AS j, id // (n * n) AS k FROM g),
  v AS (SELECT *, i + 0.125 * (j % 2) AS x, j + 0.0625 * (k % 3) AS y, CAST(k AS DOUBLE) AS z FROM c0),
  p AS (SELECT *, (x - n / 2) * (x - n / 2) + (y - n / 2) * (y - n / 2) + (z - n / 2) * (z - n / 2) + 0.3 AS f FROM v),
  q AS (SELECT n, i, j, k, i + j * (n - 1) + k * (n - 1) * (n - 1) AS cell FROM p WHERE i < n - 1 AND j < n - 1 AND k < n - 1),
  o AS (SELECT * FROM (VALUES {_tables()}) t(parity, part, corner, di, dj, dk)),
  t AS (SELECT q.cell, o.part, o.corner, p.* FROM q JOIN o ON o.parity = (q.i + q.j + q.k) % 2 JOIN p ON p.i = q.i + o.di AND p.j = q.j + o.dj AND p.k = q.k + o.dk),
  """
LEVEL = 2.753141592653


def cut_sql(f: str, level: str) -> str:
    """Sums over the points where edges of tetrahedra cross a level."""
    return f"""e AS (SELECT a.cell, a.part, a.x AS ax, a.y AS ay, a.z AS az, {f.format('a')} AS af, b.x AS bx, b.y AS by_, b.z AS bz, {f.format('b')} AS bf FROM t a JOIN t b ON a.cell = b.cell AND a.part = b.part AND a.corner < b.corner),
  h AS (SELECT *, ({level} - af) / (bf - af) AS s FROM e WHERE (af >= {level}) <> (bf >= {level}))
  SELECT cell, count(*) AS n, round(sum(ax + s * (bx - ax)), 5) AS x, round(sum(ay + s * (by_ - ay)), 5) AS y, round(sum(az + s * (bz - az)), 5) AS z FROM h GROUP BY 1"""


def corner_sums(surface):
    each = surface.select("cell", F.explode("polygon").alias("p"))
    return rounded(each.groupBy("cell").agg(F.count("*").alias("n"), *(F.sum(f"p.{c}").alias(c) for c in "xyz")), 5)


@R.add("contour_surface", BLOCK + cut_sql("{}.f", str(LEVEL)))
def contour_surface(spark, d):
    return corner_sums(volumes.contour_surface(blocks(spark, d), block_points(spark, d), F.col("f"), [LEVEL]))


@R.add("contour_levels", BLOCK + """l AS (SELECT unnest([1.5, 2.75, 4.1]) AS level), e AS (SELECT level, a.cell, a.part, a.f AS af, b.f AS bf FROM l, t a JOIN t b ON a.cell = b.cell AND a.part = b.part AND a.corner < b.corner)
  SELECT level, count(DISTINCT cell * 5 + part) AS polygons, count(*) AS points FROM e WHERE (af >= level) <> (bf >= level) GROUP BY 1""")
def contour_levels(spark, d):
    found = volumes.contour_surface(blocks(spark, d), block_points(spark, d), F.col("f"), [1.5, 2.75, 4.1])
    return found.groupBy("level").agg(F.count("*").alias("polygons"), F.sum(F.size("polygon")).cast("long").alias("points"))


@R.add("contour_points", BLOCK + f"""e AS (SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM t a JOIN t b ON a.cell = b.cell AND a.part = b.part AND a.corner < b.corner WHERE (a.f >= {LEVEL}) <> (b.f >= {LEVEL}))
  SELECT e.a, e.b, round(x.x + ({LEVEL} - x.f) / (y.f - x.f) * (y.x - x.x), 5) AS x, round(x.y + ({LEVEL} - x.f) / (y.f - x.f) * (y.y - x.y), 5) AS y, round(x.z + ({LEVEL} - x.f) / (y.f - x.f) * (y.z - x.z), 5) AS z FROM e JOIN p x ON x.id = e.a JOIN p y ON y.id = e.b""")
def contour_points(spark, d):
    """The surface's points, one for each mesh edge, which contouring names by the edge's ends."""
    surface = volumes.contour_surface(blocks(spark, d), block_points(spark, d), F.col("f"), [LEVEL])
    return rounded(volumes.merged_points(volumes.surface_triangles(surface)).select("a", "b", "x", "y", "z"), 5)


@R.add("slice_surface", BLOCK + cut_sql("({0}.x + 0.5 * {0}.y + 0.25 * {0}.z - n / 1.5)".replace("n / 1.5", "{0}.n / 1.5"), "0"))
def slice_surface(spark, d):
    n = side(spark, d)
    return corner_sums(volumes.slice_surface(blocks(spark, d), block_points(spark, d), [lambda x, y, z: x + 0.5 * y + 0.25 * z - n / 1.5]))


# The share of a tetrahedron below a level, by divided differences of its four values.
SHARE = """w AS (SELECT cell, part, list_sort(list(f)) AS f, any_value(v) AS volume FROM u GROUP BY 1, 2),
  b AS (SELECT cell, volume, CASE WHEN f[1] >= {c} THEN 0 WHEN f[4] < {c} THEN 1
    WHEN f[2] >= {c} THEN pow({c} - f[1], 3) / ((f[2] - f[1]) * (f[3] - f[1]) * (f[4] - f[1]))
    WHEN f[3] >= {c} THEN CASE WHEN f[2] - f[1] > 1e-9 THEN pow({c} - f[1], 3) / ((f[2] - f[1]) * (f[3] - f[1]) * (f[4] - f[1])) - pow({c} - f[2], 3) / ((f[2] - f[1]) * (f[3] - f[2]) * (f[4] - f[2]))
      ELSE pow({c} - f[1], 2) * (3 * (f[3] - f[1]) * (f[4] - f[1]) - ({c} - f[1]) * (f[3] + f[4] - 2 * f[1])) / pow((f[3] - f[1]) * (f[4] - f[1]), 2) END
    ELSE 1 - pow(f[4] - {c}, 3) / ((f[4] - f[1]) * (f[4] - f[2]) * (f[4] - f[3])) END AS below FROM w)"""
VOLUMES = """s AS (SELECT cell, part, list(x ORDER BY corner) AS x, list(y ORDER BY corner) AS y, list(z ORDER BY corner) AS z FROM t GROUP BY 1, 2),
  d AS (SELECT cell, part, x[2]-x[1] AS a1, y[2]-y[1] AS a2, z[2]-z[1] AS a3, x[3]-x[1] AS b1, y[3]-y[1] AS b2, z[3]-z[1] AS b3, x[4]-x[1] AS c1, y[4]-y[1] AS c2, z[4]-z[1] AS c3 FROM s),
  vol AS (SELECT cell, part, abs(a1*(b2*c3-b3*c2) - a2*(b1*c3-b3*c1) + a3*(b1*c2-b2*c1)) / 6 AS v FROM d), u AS (SELECT t.cell, t.part, {f} AS f, v FROM t JOIN vol USING (cell, part)),
  """


@R.add("clip_volume", BLOCK + VOLUMES.format(f="t.f") + SHARE.format(c=LEVEL) + " SELECT cell, round(sum(volume * (1 - below)), 6) AS volume FROM b GROUP BY 1 HAVING sum(volume * (1 - below)) > 1e-9")
def clip_volume(spark, d):
    pieces = volumes.clip(blocks(spark, d), block_points(spark, d), F.col("f"), LEVEL)
    return rounded(pieces.groupBy("cell").agg(F.sum("volume").alias("volume")).where("volume > 1e-9"), 6)


@R.add("clip_by_sphere", BLOCK + VOLUMES.format(f="(t.x-2)*(t.x-2) + (t.y-1.5)*(t.y-1.5) + (t.z-2)*(t.z-2) - 1.7") + SHARE.format(c=0) + " SELECT cell, round(sum(volume * below), 6) AS volume FROM b GROUP BY 1 HAVING sum(volume * below) > 1e-9")
def clip_by_sphere(spark, d):
    ball = lambda x, y, z: V.sphere(x, y, z, (2.0, 1.5, 2.0), math.sqrt(1.7))
    pieces = volumes.clip_by_function(blocks(spark, d), block_points(spark, d), ball, invert=True)
    return rounded(pieces.groupBy("cell").agg(F.sum("volume").alias("volume")).where("volume > 1e-9"), 6)


_GRADIENT = BLOCK + """s AS (SELECT cell, part, list(x ORDER BY corner) AS x, list(y ORDER BY corner) AS y, list(z ORDER BY corner) AS z, list(f ORDER BY corner) AS f FROM t GROUP BY 1, 2),
  d AS (SELECT cell, x[2]-x[1] AS a1, y[2]-y[1] AS a2, z[2]-z[1] AS a3, f[2]-f[1] AS fa, x[3]-x[1] AS b1, y[3]-y[1] AS b2, z[3]-z[1] AS b3, f[3]-f[1] AS fb, x[4]-x[1] AS c1, y[4]-y[1] AS c2, z[4]-z[1] AS c3, f[4]-f[1] AS fc FROM s),
  m AS (SELECT cell, a1*(b2*c3-b3*c2) - a2*(b1*c3-b3*c1) + a3*(b1*c2-b2*c1) AS det, fa*(b2*c3-b3*c2) - a2*(fb*c3-b3*fc) + a3*(fb*c2-b2*fc) AS gx, a1*(fb*c3-b3*fc) - fa*(b1*c3-b3*c1) + a3*(b1*fc-fb*c1) AS gy,
    a1*(b2*fc-fb*c2) - a2*(b1*fc-fb*c1) + fa*(b1*c2-b2*c1) AS gz FROM d), cg AS (SELECT cell, sum(gx) / sum(det) AS gx, sum(gy) / sum(det) AS gy, sum(gz) / sum(det) AS gz FROM m GROUP BY 1)"""


@R.add("cell_gradient", _GRADIENT + " SELECT cell, round(gx, 5) AS gx, round(gy, 5) AS gy, round(gz, 5) AS gz FROM cg")
def cell_gradient(spark, d):
    """By Cramer's rule in SQL."""
    return rounded(volumes.cell_gradient(blocks(spark, d), block_points(spark, d), "f"), 5)


@R.add("point_gradient", _GRADIENT + ", r AS (SELECT DISTINCT t.cell, q2.id FROM t JOIN q USING (cell) JOIN p q2 ON q2.i - q.i BETWEEN 0 AND 1 AND q2.j - q.j BETWEEN 0 AND 1 AND q2.k - q.k BETWEEN 0 AND 1) SELECT r.id, round(avg(gx), 5) AS gx, round(avg(gy), 5) AS gy, round(avg(gz), 5) AS gz FROM r JOIN cg USING (cell) GROUP BY 1")
def point_gradient(spark, d):
    return rounded(volumes.point_gradient(blocks(spark, d), block_points(spark, d), "f"), 5)


@R.add("interpolate_in_cells", "SELECT s_suppkey AS id, round(2.0 * (s_suppkey * 37 % 100 / 100.0 * 2.5 + 0.2) - (s_suppkey * 71 % 100 / 100.0 * 2.5 + 0.2) + 3 * (s_suppkey * 13 % 100 / 100.0 * 2.5 + 0.2), 6) AS g FROM supplier")
def interpolate_in_cells(spark, d):
    """A linear field comes back exactly at points inside cells."""
    at = lambda m: (F.col("s_suppkey") * m % 100 / 100.0 * 2.5 + 0.2)
    where = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), at(37).alias("x"), at(71).alias("y"), at(13).alias("z"))
    points = block_points(spark, d).withColumn("g", 2 * F.col("x") - F.col("y") + 3 * F.col("z"))
    return rounded(volumes.interpolate(blocks(spark, d), points, ["g"], where).select("id", "g"), 6)


@R.add("tetrahedralize_block", BLOCK + "s AS (SELECT cell, part, list(id ORDER BY id) AS ids FROM t GROUP BY 1, 2), w AS (SELECT unnest([[ids[1], ids[2], ids[3]], [ids[1], ids[2], ids[4]], [ids[1], ids[3], ids[4]], [ids[2], ids[3], ids[4]]]) AS face FROM s) SELECT face, count(*) AS n FROM w GROUP BY 1")
def tetrahedralize_block(spark, d):
    """Each triangle of the tetrahedra and how many share it: two inside the block, one on its surface."""
    tetras = mesh.tetrahedralize(blocks(spark, d)).select(F.monotonically_increasing_id().alias("cell"), F.lit("tetra").alias("shape"), F.array("a", "b", "c", "d").alias("conn"))
    return mesh.faces(tetras).groupBy(F.array_sort("face").alias("face")).agg(F.count("*").alias("n"))
