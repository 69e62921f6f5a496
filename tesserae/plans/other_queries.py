"""Queries of scalar functions, sources, flow, uncertainty and keyed streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.operators import flow, uncertainty
from tesserae.plans.field_queries import rounded
from tesserae.plans.mesh_queries import NX, NY, SHEET, quads, sheet_points
from tesserae.plans.registry import Registry, table
from tesserae.sources import fields
from tesserae.streaming import lagrangian

R = Registry()

#: name: Spark SQL, DuckDB SQL, over x in [-1, 1) and y in (0, 50].
SCALARS = {
    "trig": {"a": "sin(y)", "b": "cos(y)", "c": "tan(x)", "d": "asin(x)", "e": "acos(x)", "f": "atan(y)", "g": "atan2(x, y)"},
    "hyperbolic": {"a": "sinh(x)", "b": "cosh(x)", "c": "tanh(x)", "d": "asinh(y)", "e": "acosh(1 + y)", "f": "atanh(x / 2)"},
    "power": {"a": "pow(y, x)", "b": "sqrt(y)", "c": "1 / sqrt(y)", "d": "cbrt(y)", "e": "1 / cbrt(y)"},
    "exponential": {"a": "exp(x)", "b": "pow(2, x)", "c": "exp(x) - 1", "d": "pow(10, x)", "e": "ln(y)", "f": "log2(y)", "g": "log10(y)", "h": "ln(1 + y)"},
    "rounding": {"a": "ceil(y * x)", "b": "floor(y * x)", "c": "round(y * x)", "d": "abs(x)", "e": "sign(x)"},
    "clamp": {"a": "greatest(-0.5, least(0.5, x))", "b": "greatest(x, y)", "c": "least(x, y)", "d": "x + (y - x) * 0.25"},
}

#: How Spark states those that fail or are null in it at the edge of their domain, where SQL has the infinities and NaN of IEEE numbers.
_inverse = lambda x: f"CASE WHEN {x} = 0 THEN pow({x}, -1) ELSE 1 / {x} END"
_log = lambda f, x: f"CASE WHEN {x} > 0 THEN {f}({x}) WHEN {x} = 0 THEN double('-Infinity') WHEN {x} < 0 THEN double('NaN') END"
IEEE = {"1 / sqrt(y)": _inverse("sqrt(y)"), "1 / cbrt(y)": _inverse("cbrt(y)"), "ln(y)": _log("ln", "y"), "log2(y)": _log("log2", "y"), "log10(y)": _log("log10", "y"), "ln(1 + y)": _log("ln", "(1 + y)")}


def _scalar(name: str, columns: dict[str, str]) -> None:
    sql = ", ".join(f"round(CAST({e} AS DOUBLE), 6) + 0.0 AS {c}" for c, e in columns.items())

    @R.add(f"scalar_{name}", f"SELECT event_id, {sql} FROM (SELECT event_id, (event_id % 200 - 100) / 100.125 AS x, value / 10.0 AS y FROM events)")
    def run(spark, d):
        rows = table(spark, d, "events").select("event_id", ((F.col("event_id") % 200 - 100) / 100.125).alias("x"), (F.col("value") / 10.0).alias("y"))
        return rows.select("event_id", *(F.expr(f"round(CAST({IEEE.get(e, e)} AS DOUBLE), 6) + 0.0D").alias(c) for c, e in columns.items()))


for _name, _columns in SCALARS.items():
    _scalar(_name, _columns)


@R.add("scalar_modulo", "SELECT event_id, round(value - 7.25 * trunc(value / 7.25), 6) AS fmod, round(value - 7.25 * round_even(value / 7.25, 0), 6) AS remainder, round(value - trunc(value), 6) AS frac FROM events")
def scalar_modulo(spark, d):
    v = F.col("value")
    return rounded(table(spark, d, "events").select("event_id", (v % 7.25).alias("fmod"), (v - 7.25 * F.rint(v / 7.25)).alias("remainder"), (v % 1).alias("frac")), 6)


@R.add("scalar_bits", "SELECT event_id, bit_count(event_id) AS bits, CASE WHEN event_id = 0 THEN 0 ELSE CAST(log2(event_id & -event_id) AS BIGINT) + 1 END AS first FROM events")
def scalar_bits(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.bit_count(i).cast("long").alias("bits"), F.when(i == 0, 0).otherwise(F.log2(i.bitwiseAND(-i)).cast("long") + 1).alias("first"))


TANGLE = "SELECT range AS id, (range % 12) / 11.0 AS x, (range // 12 % 10) / 9.0 AS y, (range // 120) / 7.0 AS z FROM range(960)"


@R.add("source_tangle", f"SELECT id, round((pow(3*(2*x-1),4) - 5*pow(3*(2*x-1),2) + pow(3*(2*y-1),4) - 5*pow(3*(2*y-1),2) + pow(3*(2*z-1),4) - 5*pow(3*(2*z-1),2) + 11.8) * 0.2 + 0.5, 5) AS tangle FROM ({TANGLE})")
def source_tangle(spark, d):
    return rounded(fields.tangle(spark, (12, 10, 8)).select("id", "tangle"), 5)


@R.add("source_wavelet", """SELECT id, round(255 * exp(-(x*x + y*y + z*z) / 0.5) + 10 * sin(60*x) + 18 * sin(30*y) + 5 * cos(40*z), 5) AS wavelet
  FROM (SELECT range AS id, -(range % 9 - 4) / 8.0 AS x, -(range // 9 % 9 - 4) / 8.0 AS y, -(range // 81 - 4) / 8.0 AS z FROM range(729))""")
def source_wavelet(spark, d):
    return rounded(fields.wavelet(spark, (-4, -4, -4), (4, 4, 4)).select("id", "wavelet"), 5)


@R.add("source_rectilinear", "SELECT range AS id, list_value(0.0, 1.5, 4.0)[range % 3 + 1]::DOUBLE AS x, list_value(2.0, 2.5)[range // 3 + 1]::DOUBLE AS y FROM range(6)")
def source_rectilinear(spark, d):
    return fields.rectilinear_grid(spark, (0.0, 1.5, 4.0), (2.0, 2.5)).select("id", "x", "y")


@R.add("source_oscillator")
def source_oscillator(spark, d):
    return rounded(fields.oscillator(spark, (8, 8, 8), 0.7, [(0.5, 0.5, 0.5, 0.2, 3.0, 0.0)], [(0.2, 0.3, 0.4, 0.1, 2.0, 0.3)], [(0.8, 0.8, 0.1, 0.3, 1.5, 0.0)]).select("id", "oscillation"), 6)


def _noise_sql() -> str:
    """The eight corners as rows, rather than nested blends."""
    directions = "[" + ", ".join(f"[{x}, {y}, {z}]" for x, y, z in fields.DIRECTIONS) + "]"
    fade = lambda t: f"({t}*{t}*{t}*({t}*({t}*6 - 15) + 10))"
    weight = " * ".join(f"CASE WHEN c{a} = 1 THEN {fade(f't{a}')} ELSE 1 - {fade(f't{a}')} END" for a in "xyz")
    return f"""WITH g AS (SELECT range AS id, range % 20 AS i, range // 20 % 20 AS j, range // 400 AS k FROM range(1600)), t AS (SELECT *, i // 8 AS bx, j // 8 AS by_, k // 8 AS bz, i % 8 / 8.0 AS tx, j % 8 / 8.0 AS ty, k % 8 / 8.0 AS tz FROM g),
  c AS (SELECT t.*, a.range AS cx, b.range AS cy, e.range AS cz FROM t, range(2) a, range(2) b, range(2) e),
  d AS (SELECT *, {directions}[((xor(xor((bx + cx) * 73856093, (by_ + cy) * 19349663), (bz + cz) * 83492791) & 2147483647) // 16) % 12 + 1] AS v FROM c)
  SELECT id, round(sum({weight} * (v[1] * (tx - cx) + v[2] * (ty - cy) + v[3] * (tz - cz))), 6) + 0.0 AS noise FROM d GROUP BY 1"""


@R.add("source_noise", _noise_sql())
def source_noise(spark, d):
    return fields.gradient_noise(spark, (20, 20, 4)).select("id", (F.round("noise", 6) + 0.0).alias("noise"))


@R.add("source_curvilinear", "SELECT range AS id, round((1 + range % 6) * cos(range // 6 % 5 * 0.3), 6) AS x, round((1 + range % 6) * sin(range // 6 % 5 * 0.3), 6) AS y, (range // 30) * 0.5 AS z FROM range(90)")
def source_curvilinear(spark, d):
    a = F.col("j") * 0.3
    return rounded(fields.curvilinear_grid(spark, (6, 5, 3), (1 + F.col("i")) * F.cos(a), (1 + F.col("i")) * F.sin(a), F.col("k") * 0.5).select("id", "x", "y", "z"), 6)


@R.add("source_explicit", "SELECT o_orderkey AS cell, list(l_partkey ORDER BY n) AS conn FROM orders JOIN (SELECT l_orderkey, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1")
def source_explicit(spark, d):
    """Orders as cells over a flat list of parts."""
    from pyspark.sql import Window

    items = table(spark, d, "lineitem").join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    flat = items.select((F.col("l_orderkey") * 1000 + F.row_number().over(place)).alias("pos"), F.col("l_partkey").alias("id"))
    counts = items.groupBy("l_orderkey").agg(F.count("*").alias("n")).select(F.col("l_orderkey").alias("cell"), F.lit("polyline").alias("shape"), (F.col("l_orderkey") * 1000 + 1).alias("start"), "n")
    return fields.explicit_cells(flat, counts).select("cell", "conn")


@R.add("source_amr", """WITH l AS (SELECT unnest([0, 1, 2]) AS level), c AS (SELECT level, unnest(range(CASE WHEN level = 0 THEN 1 ELSE 8 END)) AS number FROM l)
  SELECT CAST(level AS INTEGER) AS level, CAST(number AS INTEGER) AS number, round(0.5 - pow(0.5, level + 1) + CASE WHEN level = 0 THEN 0 ELSE number // 4 * pow(0.5, level) / 2 END, 6) AS lo_x, round(0.5 - pow(0.5, level + 1) + CASE WHEN level = 0 THEN pow(0.5, level) ELSE (number % 2 + 1) * pow(0.5, level) / 2 END, 6) AS hi_z FROM c""")
def source_amr(spark, d):
    return rounded(fields.amr_blocks(spark, 3, 8).select("level", "number", "lo_x", "hi_z"), 6)


UNCERTAIN = f"""{SHEET}, u AS (SELECT id, f - 5 AS lo, f + 5 + i AS hi FROM v JOIN p USING (id)), w AS (SELECT q AS cell, unnest([a, a + 1, a + {NX + 1}, a + {NX}]) AS id FROM k),
  r AS (SELECT cell, CASE WHEN hi <= 60 THEN 1.0 WHEN lo >= 60 THEN 0.0 ELSE (60 - lo) / (hi - lo) END AS p FROM w JOIN u USING (id))"""


def _uncertain(spark):
    points = sheet_points(spark)
    i = (F.col("id") % NX).cast("double")
    return points.select("id", (F.col("f") - 5).alias("lo"), (F.col("f") + 5 + i).alias("hi"))


@R.add("contour_uncertain_uniform", UNCERTAIN + """ SELECT cell, round(1 - product(p) - product(1 - p), 6) AS crossing, CAST(pow(2, count(*) FILTER (WHERE p > 0 AND p < 1)) AS BIGINT) AS nonzero,
  round(sum(CASE WHEN p > 0 AND p < 1 THEN -p * log2(p) - (1 - p) * log2(1 - p) ELSE 0 END), 6) AS entropy FROM r GROUP BY 1""")
def contour_uncertain_uniform(spark, d):
    return rounded(uncertainty.uniform_crossing(quads(spark), _uncertain(spark), "lo", "hi", 60.0), 6)


@R.add("contour_uncertain_gaussian")
def contour_uncertain_gaussian(spark, d):
    points = sheet_points(spark).select("id", F.col("f").alias("mean"), (1 + F.col("x")).alias("variance"))
    return rounded(uncertainty.gaussian_crossing(quads(spark), points, "mean", "variance", 60.0), 5)


@R.add("fiber_uncertain_uniform", f"""{SHEET}, r AS (SELECT id, f - 5 AS a, f + 5 AS b, x - 1 AS c, x + 2 AS d FROM v)
  SELECT id, round(greatest(0, least(b, 60) - greatest(a, 20)) / (b - a) * greatest(0, least(d, 9) - greatest(c, 3)) / (d - c), 6) AS probability FROM r""")
def fiber_uncertain_uniform(spark, d):
    rows = sheet_points(spark).select("id", (F.col("f") - 5).alias("a"), (F.col("f") + 5).alias("b"), (F.col("x") - 1).alias("c"), (F.col("x") + 2).alias("d"))
    return rounded(uncertainty.in_rectangle(rows, (20.0, 60.0, 3.0, 9.0), "a", "b", "c", "d").select("id", "probability"), 6)


def _vortex(spark):
    """Rigid rotation around the middle of a plane grid, and seeds in it."""
    grid = fields.uniform_grid(spark, (21, 21)).select("id", (-(F.col("y") - 10)).alias("u"), (F.col("x") - 10).alias("v"), F.lit(0.0).alias("w"))
    seeds = spark.range(40).select("id", (10 + F.col("id") % 9).cast("double").alias("x"), F.lit(10.0).alias("y"), F.lit(0.0).alias("z"))
    return [flow.field_array(grid, ["u", "v", "w"], (21, 21, 1))], seeds


@R.add("particle_advection")
def particle_advection(spark, d):
    field, seeds = _vortex(spark)
    return rounded(flow.particles(seeds, field, 0.05, 40), 4)


@R.add("streamline")
def streamline(spark, d):
    field, seeds = _vortex(spark)
    return rounded(flow.streamlines(seeds, field, 0.05, 20), 4)


@R.add("pathline_unsteady")
def pathline_unsteady(spark, d):
    field, seeds = _vortex(spark)
    return rounded(flow.streamlines(seeds, [field[0], 2 * field[0]], 0.05, 20, times=(0.0, 1.0)), 4)


@R.add("lagrangian_flow_map", """WITH s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS steps, sum(value) OVER (PARTITION BY user_id ORDER BY event_id) AS position FROM events)
  SELECT key, steps, round(coalesce(lag(position) OVER (PARTITION BY key ORDER BY steps), 0), 4) AS start, round(position, 4) AS position FROM s WHERE steps % 10 = 0""")
def lagrangian_flow_map(spark, d):
    """The stream is run to its end into memory; a lasting sink would take its place."""
    import uuid

    path = f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet").parquet(d)
    name = f"flow_{uuid.uuid4().hex}"
    run = lagrangian.flow_map(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.table(name))
