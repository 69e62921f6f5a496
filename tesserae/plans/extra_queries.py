"""Queries of kernels, scatters and masks, views, stream surfaces, Monte Carlo crossings, scatter densities and sharp edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import flow, kernels, mesh, stencil, uncertainty
from tesserae.plans.field_queries import rounded
from tesserae.plans.grid_queries import NEAR, VOXELS, voxels
from tesserae.plans.mesh_queries import NX, NY, SHEET, bricks, quads, sheet_points, triangles
from tesserae.plans.other_queries import _uncertain, _vortex
from tesserae.plans.registry import Registry, table

R = Registry()


@R.add("kernel_map_field", "SELECT o_orderkey, round(o_totalprice * 0.5 + o_custkey, 4) AS v FROM orders")
def kernel_map_field(spark, d):
    out = kernels.map_field(table(spark, d, "orders"), "v", lambda price, who: price * 0.5 + who, "o_totalprice", "o_custkey")
    return rounded(out.select("o_orderkey", "v"), 4)


@R.add("kernel_visit_cells", SHEET + f" SELECT q AS cell, round(max(v.f) - min(v.f), 5) AS spread FROM k JOIN v ON v.id IN (k.a, k.a + 1, k.a + {NX}, k.a + {NX + 1}) GROUP BY 1")
def kernel_visit_cells(spark, d):
    out = kernels.visit_cells(quads(spark), sheet_points(spark), "spread", lambda p: F.array_max(F.transform(p, lambda x: x["f"])) - F.array_min(F.transform(p, lambda x: x["f"])), "f")
    return rounded(out, 5)


@R.add("kernel_visit_points", SHEET + f" SELECT v.id, max(k.q) AS last FROM v JOIN k ON v.id IN (k.a, k.a + 1, k.a + {NX}, k.a + {NX + 1}) GROUP BY 1")
def kernel_visit_points(spark, d):
    return kernels.visit_points(quads(spark), ["cell"], "last", F.max)


@R.add("kernel_reduce_by_key", "SELECT l_suppkey, round(sum(l_quantity * l_discount), 4) AS w FROM lineitem GROUP BY 1")
def kernel_reduce_by_key(spark, d):
    return rounded(kernels.reduce_by_key(table(spark, d, "lineitem"), "l_suppkey", "w", lambda q, c: F.sum(q * c), "l_quantity", "l_discount"), 4)


@R.add("kernel_neighbourhood", VOXELS + f" SELECT c.i, c.j, c.k, max(n.f * (2 + n.i - c.i)) AS m {NEAR.format(r=1)} GROUP BY 1, 2, 3")
def kernel_neighbourhood(spark, d):
    return kernels.visit_neighbourhood(voxels(spark, d), "f", stencil.offsets(1, 3), "m", lambda f, di, dj, dk: F.max(f * (2 + di)))


@R.add("scatter_uniform", "SELECT c_custkey, range AS visit FROM customer, range(3)")
def scatter_uniform(spark, d):
    return kernels.scatter_uniform(table(spark, d, "customer").select("c_custkey"), 3).withColumn("visit", F.col("visit").cast("long"))


@R.add("scatter_counting", "SELECT o_orderkey, unnest(range(o_orderkey % 4)) AS visit FROM orders")
def scatter_counting(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("n"))
    return kernels.scatter_counting(rows, "n").select("o_orderkey", F.col("visit").cast("long").alias("visit"))


@R.add("scatter_permutation", "SELECT l_orderkey * 8 + l_linenumber AS visit_at, p_partkey, p_retailprice FROM lineitem JOIN part ON l_partkey = p_partkey")
def scatter_permutation(spark, d):
    order = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), "l_partkey")
    return kernels.scatter_permutation(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_partkey", order, "at", "l_partkey").select("visit_at", "p_partkey", "p_retailprice")


@R.add("mask_select", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def mask_select(spark, d):
    return kernels.mask_select(table(spark, d, "orders").withColumn("keep", F.col("o_orderstatus") == "F"), "keep").select("o_orderkey")


@R.add("mask_indices", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def mask_indices(spark, d):
    return kernels.mask_indices(table(spark, d, "part").select("p_partkey"), "p_partkey", table(spark, d, "lineitem").where("l_quantity > 49"), "l_partkey")


@R.add("view_runtime_vec", "SELECT event_id // 5 AS event_id, list(round(value, 4) ORDER BY event_id) AS v FROM events GROUP BY 1")
def view_runtime_vec(spark, d):
    rows = table(spark, d, "events").select("event_id", F.round("value", 4).alias("value"))
    return kernels.runtime_vectors(rows, "event_id", "value", 5)


@R.add("view_stride_modulo", "WITH e AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS n, s_suppkey FROM supplier) SELECT range AS i, s_suppkey FROM range(200) JOIN e ON n = ((range // 3) % 4) * 2 + 1")
def view_stride_modulo(spark, d):
    from tesserae.operators.primitives import scan

    placed = scan(table(spark, d, "supplier").select("s_suppkey"), F.lit(1), "s_suppkey", out="n").select("s_suppkey", (F.col("n") - 1).cast("long").alias("n"))
    return kernels.strided(placed, "n", 200, stride=2, offset=1, modulo=4, divisor=3).select("i", "s_suppkey")


@R.add("view_multiplexer", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN l_discount ELSE l_tax END AS v FROM lineitem")
def view_multiplexer(spark, d):
    v = kernels.multiplexed(F.col("l_linenumber") % 3, F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("v"))


@R.add("contour_dimension", "SELECT shape, count(*) AS n FROM (SELECT unnest(['quad', 'triangle', 'triangle']) AS shape, range AS q FROM range(" + str((NX - 1) * (NY - 1)) + ")) GROUP BY 1")
def contour_dimension(spark, d):
    """Of cells of all dimensions, those that a contour of polygons takes."""
    every = bricks(spark).select("shape").unionByName(quads(spark).select("shape")).unionByName(triangles(spark).select("shape"))
    return mesh.of_dimension(every, 2).groupBy("shape").agg(F.count("*").alias("n"))


# A rigid rotation about (10, 10): a Runge-Kutta step of it is one linear map.
_STEP = ("1 - {h}*{h}/2 + {h}*{h}*{h}*{h}/24", "{h} - {h}*{h}*{h}/6")
_SEEDS = "SELECT range AS id, 0 AS step, CAST(range % 9 AS DOUBLE) AS x, 0.0::DOUBLE AS y FROM range(40)"


def _rotation(n: int, h: str) -> str:
    c, s = (x.format(h=h) for x in _STEP)
    return f"WITH RECURSIVE w AS ({_SEEDS} UNION ALL SELECT id, step + 1, ({c}) * x - ({s}) * y, ({s}) * x + ({c}) * y FROM w WHERE step < {n})"


@R.add("stream_surface", _rotation(10, "0.05") + """, r AS (SELECT a.id AS strip, a.step, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, e.x AS ex, e.y AS ey FROM w a JOIN w b ON b.id = a.id + 1 AND b.step = a.step JOIN w c ON c.id = a.id AND c.step = a.step + 1 JOIN w e ON e.id = a.id + 1 AND e.step = a.step + 1 WHERE a.id < 8)
  SELECT strip, CAST(step AS INTEGER) AS step, round(abs((bx-ax)*(ey-ay) - (by_-ay)*(ex-ax)) / 2 + abs((ex-ax)*(cy-ay) - (ey-ay)*(cx-ax)) / 2, 5) AS area FROM r""")
def stream_surface(spark, d):
    field, seeds = _vortex(spark)
    strips = flow.stream_surface(seeds.where("id < 9"), field, 0.05, 10)
    return rounded(strips.groupBy("strip", "step").agg(F.sum("area").alias("area")), 5)


R.sql["particle_advection"] = _rotation(40, "0.05") + " SELECT id, round(10 + x, 4) AS x, round(10 + y, 4) AS y, 0.0 AS z, CAST(40 AS BIGINT) AS steps FROM w WHERE step = 40"
R.sql["streamline"] = _rotation(20, "0.05") + " SELECT id, step, round(10 + x, 4) AS x, round(10 + y, 4) AS y, 0.0 AS z FROM w"


@R.add("uncertain_uniform_monte_carlo", f"""{SHEET}, u AS (SELECT id, f - 5 AS lo, f + 5 + i AS hi FROM v JOIN p USING (id)), c AS (SELECT q AS cell, unnest([a, a + 1, a + {NX + 1}, a + {NX}]) AS id FROM k),
  r AS (SELECT cell, range AS draw, lo + (hi - lo) * (CAST('0x' || substring(md5('7|' || id || '|' || range), 1, 12) AS BIGINT) / 281474976710656.0) >= 60 AS up FROM c JOIN u USING (id), range(50))
  SELECT cell, round(avg(CASE WHEN n BETWEEN 1 AND 3 THEN 1.0 ELSE 0.0 END), 6) AS crossing FROM (SELECT cell, draw, count(*) FILTER (WHERE up) AS n FROM r GROUP BY 1, 2) GROUP BY 1""")
def uncertain_uniform_monte_carlo(spark, d):
    return rounded(uncertainty.uniform_monte_carlo(quads(spark), _uncertain(spark), "lo", "hi", 60.0, 50, seed=7), 6)


@R.add("split_sharp_edges", f"""{SHEET}, n AS (SELECT cell, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS nz FROM s),
  um AS (SELECT cell, nx / sqrt(nx*nx+ny*ny+nz*nz) AS nx, ny / sqrt(nx*nx+ny*ny+nz*nz) AS ny, nz / sqrt(nx*nx+ny*ny+nz*nz) AS nz FROM n), ue AS (SELECT cell, unnest([[least(a,b), greatest(a,b)], [least(b,c), greatest(b,c)], [least(a,c), greatest(a,c)]]) AS edge FROM t)
  SELECT x.edge AS edge FROM ue x JOIN ue y ON x.edge = y.edge AND x.cell < y.cell JOIN um a ON a.cell = x.cell JOIN um b ON b.cell = y.cell WHERE a.nx*b.nx + a.ny*b.ny + a.nz*b.nz < cos(radians(2.0))""")
def split_sharp_edges(spark, d):
    """The edges along which points are doubled."""
    return mesh.sharp_edges(triangles(spark), sheet_points(spark), 2.0).select("edge")


# SQL for queries that are registered elsewhere.

R.sql["hist_sampling"] = """WITH RECURSIVE l AS (SELECT min(value) AS lo, max(value) AS hi FROM events), b AS (SELECT event_id, value, least(9, CAST(floor((value - lo) / ((hi - lo) / 10)) AS BIGINT)) AS bin FROM events, l),
  n AS (SELECT range AS bin, count(b.bin) AS freq FROM range(10) LEFT JOIN b ON b.bin = range GROUP BY 1), o AS (SELECT bin, freq, row_number() OVER (ORDER BY freq, bin) AS r FROM n),
  f AS (SELECT 0::BIGINT AS r, 0.1 * (SELECT sum(freq) FROM n)::DOUBLE AS rest, 0::BIGINT AS bin, 0.0::DOUBLE AS share UNION ALL
    SELECT o.r, f.rest - least(o.freq, f.rest / (11 - o.r)), o.bin, CASE WHEN o.freq > 0 THEN least(o.freq, f.rest / (11 - o.r)) / o.freq ELSE 0 END FROM f JOIN o ON o.r = f.r + 1)
  SELECT event_id, value FROM b JOIN f ON f.bin = b.bin AND f.r > 0 WHERE CAST('0x' || substring(md5('0|' || event_id), 1, 12) AS BIGINT) / 281474976710656.0 < share"""

_SHARE = "CASE WHEN af >= 60 AND bf >= 60 AND cf >= 60 THEN 1 WHEN af < 60 AND bf < 60 AND cf < 60 THEN 0"
for _one, _two, _three in (("a", "b", "c"), ("b", "c", "a"), ("c", "a", "b")):
    _tip = f"({_one}f - 60) * ({_one}f - 60) / (({_one}f - {_two}f) * ({_one}f - {_three}f))"
    _SHARE += f" WHEN {_one}f >= 60 AND {_two}f < 60 AND {_three}f < 60 THEN {_tip} WHEN {_one}f < 60 AND {_two}f >= 60 AND {_three}f >= 60 THEN 1 - {_tip}"
R.sql["clip_with_field"] = f"{SHEET} SELECT cell, round(abs((bx-ax)*(cy-ay) - (by_-ay)*(cx-ax)) / 2 * ({_SHARE} END), 5) AS kept FROM s WHERE {_SHARE} END > 0"

R.sql["surface_normals"] = f"""{SHEET}, n AS (SELECT cell, (by_-ay)*(cz-az)-(bz-az)*(cy-ay) AS x, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) AS y, (bx-ax)*(cy-ay)-(by_-ay)*(cx-ax) AS z FROM s),
  w AS (SELECT unnest([a, b, c]) AS id, x / sqrt(x*x+y*y+z*z) AS x, y / sqrt(x*x+y*y+z*z) AS y, z / sqrt(x*x+y*y+z*z) AS z FROM n JOIN t USING (cell)), g AS (SELECT id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM w GROUP BY 1)
  SELECT id, round(x / sqrt(x*x+y*y+z*z), 5) AS nx, round(y / sqrt(x*x+y*y+z*z), 5) AS ny, round(z / sqrt(x*x+y*y+z*z), 5) AS nz FROM g"""

R.sql["random_normal"] = """WITH u AS (SELECT range AS id, (CAST('0x' || substring(md5('1|' || range), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS a, (CAST('0x' || substring(md5('2|' || range), 1, 12) AS BIGINT) + 0.5) / 281474976710656.0 AS b FROM range(1000))
  SELECT id, round(sqrt(-2 * ln(a)) * cos(2 * pi() * b), 6) AS normal FROM u"""

_Z = "(60 - f) / sqrt(2 * (1 + x))"
_T = f"(1 / (1 + 0.5 * abs({_Z})))"
_POLY = "0.17087277"
for _k in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
    _POLY = f"(({_POLY}) * {_T} + ({_k}))"
R.sql["contour_uncertain_gaussian"] = f"""{SHEET}, g AS (SELECT id, {_Z} AS z, {_T} * exp(-{_Z} * {_Z} + {_POLY}) AS e FROM v), r AS (SELECT q AS cell, unnest([a, a + 1, a + {NX + 1}, a + {NX}]) AS id FROM k), w AS (SELECT cell, CASE WHEN z >= 0 THEN 1 - e / 2 ELSE e / 2 END AS p FROM r JOIN g USING (id))
  SELECT cell, round(1 - product(p) - product(1 - p), 5) AS crossing FROM w GROUP BY 1"""

_NEAR = "exp(-((x-{0})*(x-{0}) + (y-{1})*(y-{1}) + (z-{2})*(z-{2})) / (2*{3}*{3}))"
R.sql["source_oscillator"] = f"""WITH g AS (SELECT range AS id, range % 8 / 7.0 AS x, range // 8 % 8 / 7.0 AS y, range // 64 / 7.0 AS z FROM range(512)) SELECT id, round(sin(3.0 * 0.7) * {_NEAR.format(0.5, 0.5, 0.5, 0.2)}
  + (1 - exp(-0.3 * 2.0 * 0.7) * sin(sqrt(1 - 0.3 * 0.3) * 2.0 * 0.7 + acos(0.3)) / sin(acos(0.3))) * {_NEAR.format(0.2, 0.3, 0.4, 0.1)} + exp(-0.7 / 1.5) * {_NEAR.format(0.8, 0.8, 0.1, 0.3)}, 6) AS oscillation FROM g"""

R.sql["vertex_clustering"] = SHEET + """, g AS (SELECT id, CAST(least(floor(x / 24.0 * 6), 5) + 6 * least(floor(y / 18.0 * 6), 5) AS BIGINT) AS cluster FROM v), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) - 1 AS r, count(*) OVER (PARTITION BY cluster) AS n FROM g),
  h AS (SELECT cluster, id AS point FROM r WHERE r = n // 2), c AS (SELECT cell, list_sort(list_distinct([x.point, y.point, z.point])) AS p FROM t JOIN g a ON a.id = t.a JOIN g b ON b.id = t.b JOIN g e ON e.id = t.c JOIN h x ON x.cluster = a.cluster JOIN h y ON y.cluster = b.cluster JOIN h z ON z.cluster = e.cluster)
  SELECT min(cell) AS cell, p[1] AS a, p[2] AS b, p[3] AS c FROM c WHERE len(p) = 3 GROUP BY p"""

R.sql["tube"] = """WITH l AS (SELECT range % 3 AS line, range // 3 AS k, cos(range / 5.0) AS x, sin(range / 5.0) AS y, range / 5.0 / 2 AS z FROM range(60)),
  d AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy, coalesce(lead(z) OVER w, z) - coalesce(lag(z) OVER w, z) AS dz FROM l WINDOW w AS (PARTITION BY line ORDER BY k)),
  t AS (SELECT *, dx / n AS tx, dy / n AS ty, dz / n AS tz, CASE WHEN abs(dz) > 0.9 * n THEN 1.0 ELSE 0.0 END AS hx, CASE WHEN abs(dz) > 0.9 * n THEN 0.0 ELSE 1.0 END AS hz FROM (SELECT *, sqrt(dx*dx + dy*dy + dz*dz) AS n FROM d)),
  u AS (SELECT *, ty*hz AS a, tz*hx - tx*hz AS b, -ty*hx AS c FROM t), v AS (SELECT *, a / sqrt(a*a+b*b+c*c) AS ux, b / sqrt(a*a+b*b+c*c) AS uy, c / sqrt(a*a+b*b+c*c) AS uz FROM u)
  SELECT line, k, CAST(range AS INTEGER) AS side, round(x + 0.1 * (cos(range * pi() / 3) * ux + sin(range * pi() / 3) * (ty*uz - tz*uy)), 5) AS x, round(y + 0.1 * (cos(range * pi() / 3) * uy + sin(range * pi() / 3) * (tz*ux - tx*uz)), 5) AS y,
  round(z + 0.1 * (cos(range * pi() / 3) * uz + sin(range * pi() / 3) * (tx*uy - ty*ux)), 5) AS z FROM v, range(6)"""
