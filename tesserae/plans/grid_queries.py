"""Queries of three-dimensional structured grids whose size follows the number of orders; probes and densities in space."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import spatial, statistics, stencil
from tesserae.plans.field_queries import rounded
from tesserae.plans.registry import Registry, table
from tesserae.plans.volume_queries import side

R = Registry()


def voxels(spark, d):
    n, x = side(spark, d), F.col("id")
    i, j, k = x % n, F.floor(x / n) % n, F.floor(x / (n * n))
    f = ((i * 37 + j * 91 + k * 53 + i * j * 5 + j * k * 3) % 101).cast("double")
    return spark.range(n**3).select("id", i.alias("i"), j.alias("j"), k.alias("k"), f.alias("f"), (f + F.when(x % 11 == 0, 7.0).otherwise(0.5)).alias("g"), (f * 0.5 + k).alias("h"))


def dims(spark, d):
    return (side(spark, d),) * 3


VOXELS = """WITH n AS (SELECT greatest(4, CAST(round(pow(count(*), 1.0 / 3) / 2) AS BIGINT)) AS n FROM orders), r AS (SELECT n, unnest(range(n * n * n)) AS id FROM n),
  a AS (SELECT n, id, id % n AS i, id // n % n AS j, id // (n * n) AS k FROM r), b AS (SELECT *, CAST((i * 37 + j * 91 + k * 53 + i * j * 5 + j * k * 3) % 101 AS DOUBLE) AS f FROM a),
  l AS (SELECT *, f + CASE WHEN id % 11 = 0 THEN 7.0 ELSE 0.5 END AS g, f * 0.5 + k AS h FROM b)"""
NEAR = "FROM l c JOIN l n ON abs(n.i - c.i) <= {r} AND abs(n.j - c.j) <= {r} AND abs(n.k - c.k) <= {r}"
BALL = "(n.i - c.i)*(n.i - c.i) + (n.j - c.j)*(n.j - c.j) + (n.k - c.k)*(n.k - c.k)"


@R.add("image_median_3d", VOXELS + """, o AS (SELECT a.range - 1 AS di, b.range - 1 AS dj, e.range - 1 AS dk FROM range(3) a, range(3) b, range(3) e)
  SELECT c.i, c.j, c.k, quantile_disc(n.f, 0.5) AS median FROM l c, o JOIN l n ON n.i = least(greatest(c.i + di, 0), c.n - 1) AND n.j = least(greatest(c.j + dj, 0), c.n - 1) AND n.k = least(greatest(c.k + dk, 0), c.n - 1) GROUP BY 1, 2, 3""")
def image_median_3d(spark, d):
    return stencil.image_median(voxels(spark, d), "f", 1, dims(spark, d))


@R.add("box_average_3d", VOXELS + f" SELECT c.i, c.j, c.k, round(avg(n.f), 6) AS average {NEAR.format(r=1)} GROUP BY 1, 2, 3")
def box_average_3d(spark, d):
    return rounded(stencil.box_average(voxels(spark, d), "f", 1), 6)


def _slopes(f: str, name: str) -> str:
    half = lambda up, down: f"coalesce(({up}.{f} - {down}.{f}) * 0.5, {up}.{f} - c.{f}, c.{f} - {down}.{f})"
    return f"{half('e', 'w')} AS {name}x, {half('n', 's')} AS {name}y, {half('u', 'b')} AS {name}z"


_AROUND = " FROM l c " + " ".join(f"LEFT JOIN l {a} ON {a}.i = c.i + {i} AND {a}.j = c.j + {j} AND {a}.k = c.k + {k}" for a, i, j, k in (("e", 1, 0, 0), ("w", -1, 0, 0), ("n", 0, 1, 0), ("s", 0, -1, 0), ("u", 0, 0, 1), ("b", 0, 0, -1)))


@R.add("gradient_3d", f"{VOXELS}, d AS (SELECT c.i, c.j, c.k, {_slopes('f', 'g')}{_AROUND}) SELECT i, j, k, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz FROM d")
def gradient_3d(spark, d):
    return rounded(stencil.gradient(voxels(spark, d), "f", dims(spark, d)), 6)


@R.add("flow_derivatives_3d", f"""{VOXELS}, d AS (SELECT c.i, c.j, c.k, {_slopes('f', 'u')}, {_slopes('g', 'v')}, {_slopes('h', 'w')}{_AROUND}) SELECT i, j, k, round(ux + vy + wz, 6) AS divergence, round(wy - vz, 6) AS vorticity_x, round(uz - wx, 6) AS vorticity_y, round(vx - uy, 6) AS vorticity_z,
  round(-(ux*ux + vy*vy + wz*wz) / 2 - (uy*vx + uz*wx + vz*wy), 5) AS q_criterion FROM d""")
def flow_derivatives_3d(spark, d):
    out = stencil.flow_derivatives(voxels(spark, d), "f", "g", dims(spark, d), "h")
    return out.select("i", "j", "k", *(F.round(c, 6).alias(c) for c in ("divergence", "vorticity_x", "vorticity_y", "vorticity_z")), F.round("q_criterion", 5).alias("q_criterion"))


@R.add("moments_3d", VOXELS + f" SELECT c.i, c.j, c.k, sum(n.f) AS m_000, sum((n.i - c.i) * n.f) AS m_100, sum((n.j - c.j) * n.f) AS m_010, sum((n.k - c.k) * n.f) AS m_001, sum((n.i-c.i)*(n.i-c.i)*n.f) AS m_200, sum((n.i-c.i)*(n.j-c.j)*n.f) AS m_110, sum((n.i-c.i)*(n.k-c.k)*n.f) AS m_101, sum((n.j-c.j)*(n.j-c.j)*n.f) AS m_020, sum((n.j-c.j)*(n.k-c.k)*n.f) AS m_011, sum((n.k-c.k)*(n.k-c.k)*n.f) AS m_002 {NEAR.format(r=2)} AND {BALL} <= 4 GROUP BY 1, 2, 3")
def moments_3d(spark, d):
    return stencil.moments(voxels(spark, d), "f", 2, 2)


@R.add("ssim_3d", VOXELS + f""", w AS (SELECT c.i, c.j, c.k, n.f / 101 AS x, n.g / 101 AS y, exp(-({BALL}) / (2 * (2.0 / 3) * (2.0 / 3))) AS w {NEAR.format(r=2)} AND {BALL} <= 4),
  s AS (SELECT i, j, k, sum(w*x)/sum(w) AS x, sum(w*y)/sum(w) AS y, sum(w*x*x)/sum(w) AS xx, sum(w*y*y)/sum(w) AS yy, sum(w*x*y)/sum(w) AS xy FROM w GROUP BY 1, 2, 3)
  SELECT i, j, k, round((2*x*y + 0.0001) * (2*(xy - x*y) + 0.0009) / ((x*x + y*y + 0.0001) * (greatest(xx - x*x, 0) + greatest(yy - y*y, 0) + 0.0009)), 5) AS ssim FROM s""")
def ssim_3d(spark, d):
    p = voxels(spark, d)
    a, b = p.select("i", "j", "k", (F.col("f") / 101).alias("f")), p.select("i", "j", "k", (F.col("g") / 101).alias("f"))
    return rounded(stencil.ssim(a, b, "f", radius=2), 5)


STARS = "SELECT s_suppkey AS id, s_suppkey * 37 % 1000 / 100.0 AS x, s_suppkey * 91 % 1000 / 100.0 AS y, s_suppkey * 53 % 1000 / 100.0 AS z, s_acctbal AS m FROM supplier"


def stars(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), *((k * m % 1000 / 100.0).alias(c) for c, m in zip("xyz", (37, 91, 53))), F.col("s_acctbal").alias("m"))


@R.add("cubic_spline_splat", f"""WITH s AS ({STARS}), g AS (SELECT a.range AS i, b.range AS j, e.range AS k FROM range(11) a, range(11) b, range(11) e), q AS (SELECT i, j, k, m, sqrt((i-x)*(i-x) + (j-y)*(j-y) + (k-z)*(k-z)) AS r FROM g, s WHERE (i-x)*(i-x) + (j-y)*(j-y) + (k-z)*(k-z) <= 4)
  SELECT i, j, k, round(sum(m / pi() * CASE WHEN r < 1 THEN 1 - 1.5*r*r + 0.75*r*r*r ELSE 0.25 * pow(2 - r, 3) END), 3) AS splat FROM q GROUP BY 1, 2, 3""")
def cubic_spline_splat(spark, d):
    return rounded(stencil.splat(stars(spark, d), "xyz", "m", (11, 11, 11), 2.0, "spline"), 3)


@R.add("particle_density_ngp_3d", f"WITH s AS ({STARS}), w AS (SELECT CAST(floor(x / 2.5) + 4 * floor(y / 2.5) + 16 * floor(z / 2.5) AS BIGINT) AS cell, sum(m) AS w FROM s GROUP BY 1) SELECT range AS cell, round(coalesce(w, 0) / 15.625, 5) AS density FROM range(64) LEFT JOIN w ON cell = range")
def particle_density_ngp_3d(spark, d):
    return rounded(statistics.density_of_cells(stars(spark, d), "xyz", "m", (4, 4, 4), (0.0,) * 3, (2.5,) * 3), 5)


@R.add("particle_density_cic_3d", f"""WITH s AS ({STARS}), u AS (SELECT m, x / 2.5 AS u, y / 2.5 AS v, z / 2.5 AS w, floor(x / 2.5) AS i, floor(y / 2.5) AS j, floor(z / 2.5) AS k FROM s), o AS (SELECT a.range AS a, b.range AS b, c.range AS c FROM range(2) a, range(2) b, range(2) c),
  p AS (SELECT CAST(i + a + 5 * (j + b) + 25 * (k + c) AS BIGINT) AS point, sum(m * CASE WHEN a = 0 THEN u - i ELSE 1 - u + i END * CASE WHEN b = 0 THEN v - j ELSE 1 - v + j END * CASE WHEN c = 0 THEN w - k ELSE 1 - w + k END) AS d FROM u, o GROUP BY 1)
  SELECT range AS point, round(coalesce(d, 0) / 15.625, 4) AS density FROM range(125) LEFT JOIN p ON point = range""")
def particle_density_cic_3d(spark, d):
    return rounded(statistics.density_of_points(stars(spark, d), "xyz", "m", (4, 4, 4), (0.0,) * 3, (2.5,) * 3), 4)


@R.add("probe_3d", VOXELS + f""", s AS ({STARS}), u AS (SELECT s.id, x / 4 AS u, y / 4 AS v, z / 4 AS w, x / 4 <= n.n - 1 AND y / 4 <= n.n - 1 AND z / 4 <= n.n - 1 AS inside, least(floor(x / 4), n.n - 2) AS ci, least(floor(y / 4), n.n - 2) AS cj, least(floor(z / 4), n.n - 2) AS ck FROM s, n),
  o AS (SELECT a.range AS a, b.range AS b, c.range AS c FROM range(2) a, range(2) b, range(2) c)
  SELECT u.id, round(sum(CASE WHEN inside THEN f * CASE WHEN a = 1 THEN u - ci ELSE 1 - u + ci END * CASE WHEN b = 1 THEN v - cj ELSE 1 - v + cj END * CASE WHEN c = 1 THEN w - ck ELSE 1 - w + ck END END) + 7.8e-9, 5) AS f, any_value(CASE WHEN inside THEN 0 ELSE 2 END) AS hidden
  FROM u, o LEFT JOIN l ON l.i = ci + a AND l.j = cj + b AND l.k = ck + c GROUP BY 1""")
def probe_3d(spark, d):
    out = spatial.probe(stars(spark, d), voxels(spark, d).select("i", "j", "k", "f"), "f", dims(spark, d), (0.0,) * 3, (4.0,) * 3)
    return rounded(out.withColumn("f", F.when(~F.isnan("f"), F.col("f") + 7.8e-9)), 5)  # half of what samples differ by at least, so that none ties
