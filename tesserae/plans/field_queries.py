"""Queries of statistics, extraction and field transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.operators import density, extraction
from tesserae.operators import statistics as S
from tesserae.plans.registry import Registry, table

R = Registry()
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINES = ", ".join(LINE)


def xyz():
    return [F.col(c) for c in ("l_quantity", "l_discount", "l_tax")]


def rounded(df, digits=4):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


MOMENTS = """count(x) AS n, min(x) AS minimum, max(x) AS maximum, round(sum(x), 2) AS total, round(avg(x), 4) AS mean, round(coalesce(var_samp(x), 0), {d}) AS sample_variance,
  round(coalesce(stddev_samp(x), 0), 4) AS sample_stddev, round(var_pop(x), {d}) AS population_variance, round(stddev_pop(x), 4) AS population_stddev,
  round(CASE WHEN var_pop(x) > 0 THEN (avg(x*x*x) - 3*avg(x)*avg(x*x) + 2*avg(x)*avg(x)*avg(x)) / pow(var_pop(x), 1.5) ELSE 0 END, 4) AS skewness,
  round(CASE WHEN var_pop(x) > 0 THEN (avg(x*x*x*x) - 4*avg(x)*avg(x*x*x) + 6*avg(x)*avg(x)*avg(x*x) - 3*pow(avg(x), 4)) / pow(var_pop(x), 2) ELSE 0 END, 4) AS kurtosis"""


def moments_rounded(df, d):
    digits = {"total": 2, "sample_variance": d, "population_variance": d}
    return df.select(*(F.round(c, digits.get(c, 4)).alias(c) if t == "double" and c not in ("minimum", "maximum") else F.col(c) for c, t in df.dtypes))


@R.add("histogram_price", """WITH b AS (SELECT min(l_extendedprice) lo, (max(l_extendedprice) - min(l_extendedprice)) / 10 d FROM lineitem),
    c AS (SELECT CAST(least(greatest(trunc((l_extendedprice - lo) / d), 0), 9) AS BIGINT) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1)
    SELECT r.range AS bin, coalesce(n, 0) AS freq FROM range(10) r LEFT JOIN c ON c.bin = r.range""")
def histogram_price(spark, d):
    return density.histogram(table(spark, d, "lineitem"), "l_extendedprice", 10)


@R.add("histogram_range", """WITH c AS (SELECT CAST(least(greatest(trunc((value - 100) / 20.0), 0), 4) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1)
    SELECT r.range AS bin, coalesce(n, 0) AS freq FROM range(5) r LEFT JOIN c ON c.bin = r.range""")
def histogram_range(spark, d):
    return density.histogram(table(spark, d, "events"), "value", 5, (100.0, 200.0))


ND = """WITH b AS (SELECT min(l_quantity) a0, (max(l_quantity) - min(l_quantity)) / 5 a1, min(l_extendedprice) b0, (max(l_extendedprice) - min(l_extendedprice)) / 4 b1 FROM lineitem),
  h AS (SELECT CAST(least(greatest(trunc((l_quantity - a0) / a1), 0), 4) AS BIGINT) AS l_quantity_bin, CAST(least(greatest(trunc((l_extendedprice - b0) / b1), 0), 3) AS BIGINT) AS l_extendedprice_bin, count(*) AS frequency FROM lineitem, b GROUP BY 1, 2)"""
FIELDS = {"l_quantity": 5, "l_extendedprice": 4}


@R.add("nd_histogram", ND + " SELECT * FROM h")
def nd_histogram(spark, d):
    return S.nd_histogram(table(spark, d, "lineitem"), FIELDS)


@R.add("nd_entropy", ND + ", p AS (SELECT frequency / sum(frequency) OVER () AS p FROM h) SELECT round(-sum(p * log2(p)), 6) AS entropy FROM p")
def nd_entropy(spark, d):
    return rounded(S.nd_entropy(table(spark, d, "lineitem"), FIELDS), 6)


@R.add("nd_marginal", ND + " SELECT l_quantity_bin, CAST(sum(frequency) AS BIGINT) AS frequency FROM h GROUP BY 1")
def nd_marginal(spark, d):
    return S.marginal(S.nd_histogram(table(spark, d, "lineitem"), FIELDS), ["l_quantity_bin"])


@R.add("nd_conditional_marginal", ND + " SELECT l_quantity_bin, CAST(sum(frequency) AS BIGINT) AS frequency FROM h WHERE l_extendedprice_bin BETWEEN 1 AND 2 GROUP BY 1")
def nd_conditional_marginal(spark, d):
    return S.marginal(S.nd_histogram(table(spark, d, "lineitem"), FIELDS), ["l_quantity_bin"], F.col("l_extendedprice_bin").between(1, 2))


@R.add("entropy", """WITH b AS (SELECT min(value) lo, (max(value) - min(value)) / 10 d FROM events),
  c AS (SELECT least(greatest(trunc((value - lo) / d), 0), 9) AS bin, count(*) AS n FROM events, b GROUP BY 1), p AS (SELECT n / sum(n) OVER () AS p FROM c) SELECT round(-sum(p * log2(p)), 6) AS entropy FROM p""")
def entropy(spark, d):
    return rounded(S.entropy(table(spark, d, "events"), "value"), 6)


@R.add("statistics", f"SELECT {MOMENTS.format(d=4)} FROM (SELECT l_quantity AS x FROM lineitem)")
def statistics(spark, d):
    return moments_rounded(S.statistics(table(spark, d, "lineitem"), "l_quantity"), 4)


@R.add("statistics_by_key", f"SELECT l_suppkey, {MOMENTS.format(d=4)} FROM (SELECT l_suppkey, l_quantity AS x FROM lineitem) GROUP BY 1")
def statistics_by_key(spark, d):
    return moments_rounded(S.statistics(table(spark, d, "lineitem"), "l_quantity", "l_suppkey"), 4)


@R.add("statistics_partitioned", f"SELECT l_returnflag, {MOMENTS.format(d=4)} FROM (SELECT l_returnflag, l_quantity AS x FROM lineitem) GROUP BY ROLLUP (l_returnflag)")
def statistics_partitioned(spark, d):
    return moments_rounded(S.statistics_partitioned(table(spark, d, "lineitem"), "l_quantity", "l_returnflag"), 4)


@R.add("average_by_key", "SELECT user_id, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def average_by_key(spark, d):
    return rounded(S.average_by_key(table(spark, d, "events"), "user_id", "value"), 6)


@R.add("average_by_key_integers", "SELECT event_type, CAST(sum(user_id) // count(*) AS BIGINT) AS mean FROM events GROUP BY 1")
def average_by_key_integers(spark, d):
    return S.average_by_key(table(spark, d, "events"), "event_type", "user_id")


@R.add("field_range", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def field_range(spark, d):
    return S.field_range(table(spark, d, "orders"), "o_totalprice", finite_only=True)


@R.add("field_range_masked", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders WHERE o_orderstatus = 'O'")
def field_range_masked(spark, d):
    return S.field_range(table(spark, d, "orders"), "o_totalprice", mask=F.col("o_orderstatus") == "O")


@R.add("bounds", "SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1, min(l_tax) AS z0, max(l_tax) AS z1 FROM lineitem")
def bounds(spark, d):
    return table(spark, d, "lineitem").agg(*(f(c).alias(f"{n}{k}") for n, c in zip("xyz", xyz()) for k, f in enumerate((F.min, F.max))))


@R.add("particle_density_ngp", """WITH c AS (SELECT CAST(floor(l_quantity / 7.0) + floor(l_extendedprice / 9000.0) * 6 AS BIGINT) AS cell, sum(l_tax) AS w FROM lineitem
  WHERE floor(l_quantity / 7.0) BETWEEN 0 AND 5 AND floor(l_extendedprice / 9000.0) BETWEEN 0 AND 7 GROUP BY 1) SELECT r.range AS cell, round(coalesce(w, 0) / 63000.0, 8) AS density FROM range(48) r LEFT JOIN c ON c.cell = r.range""")
def particle_density_ngp(spark, d):
    return rounded(S.particle_density(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_tax", (6, 8), (0.0, 0.0), (7.0, 9000.0)), 8)


@R.add("particle_number_density", """WITH c AS (SELECT CAST(floor(l_quantity / 7.0) + floor(l_extendedprice / 9000.0) * 6 AS BIGINT) AS cell, count(*) AS w FROM lineitem
  WHERE floor(l_quantity / 7.0) BETWEEN 0 AND 5 AND floor(l_extendedprice / 9000.0) BETWEEN 0 AND 7 GROUP BY 1) SELECT r.range AS cell, CAST(coalesce(w, 0) AS DOUBLE) AS density FROM range(48) r LEFT JOIN c ON c.cell = r.range""")
def particle_number_density(spark, d):
    return S.particle_density(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", None, (6, 8), (0.0, 0.0), (7.0, 9000.0), divide=False)


@R.add("particle_density_cic", """WITH r AS (SELECT l_tax AS m, l_quantity / 10.0 AS u, l_extendedprice / 20000.0 AS v FROM lineitem WHERE l_quantity / 10.0 BETWEEN 0 AND 5 AND l_extendedprice / 20000.0 BETWEEN 0 AND 6),
  f AS (SELECT m, u, v, least(floor(u), 4) AS i, least(floor(v), 5) AS j FROM r), g AS (SELECT *, u - i AS p, v - j AS q FROM f),
  k AS (SELECT i + j * 6 AS point, p * q * m AS w FROM g UNION ALL SELECT i + 1 + j * 6, (1 - p) * q * m FROM g UNION ALL SELECT i + (j + 1) * 6, p * (1 - q) * m FROM g UNION ALL SELECT i + 1 + (j + 1) * 6, (1 - p) * (1 - q) * m FROM g),
  s AS (SELECT CAST(point AS BIGINT) AS point, sum(w) AS w FROM k GROUP BY 1) SELECT r.range AS point, round(coalesce(w, 0) / 200000.0, 8) AS density FROM range(42) r LEFT JOIN s ON s.point = r.range""")
def particle_density_cic(spark, d):
    return rounded(S.particle_density_cic(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_tax", (5, 6), (0.0, 0.0), (10.0, 20000.0)), 8)


@R.add("hist_sampling")
def hist_sampling(spark, d):
    return S.hist_sampling(table(spark, d, "events").select("event_id", "value"), "value", "event_id", 0.1)


# Extraction.


@R.add("threshold", f"SELECT {LINES}, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
def threshold(spark, d):
    return extraction.threshold(table(spark, d, "lineitem"), "l_quantity", 10, 20).select(*LINE, "l_quantity")


@R.add("threshold_inverted", f"SELECT {LINES}, l_quantity FROM lineitem WHERE NOT l_quantity BETWEEN 5 AND 45")
def threshold_inverted(spark, d):
    return extraction.threshold(table(spark, d, "lineitem"), "l_quantity", 5, 45, invert=True).select(*LINE, "l_quantity")


def _orders_by_lines(spark, d, **options):
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return extraction.threshold_by_points(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), points, "o_orderkey", "l_quantity", 5, 30, **options)


@R.add("threshold_any_point", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity BETWEEN 5 AND 30)")
def threshold_any_point(spark, d):
    return _orders_by_lines(spark, d)


@R.add("threshold_all_points", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_quantity BETWEEN 5 AND 30))")
def threshold_all_points(spark, d):
    return _orders_by_lines(spark, d, all_in_range=True)


@R.add("threshold_vector_any", "SELECT vec_id FROM embeddings WHERE list_max(embedding) >= 0.35 AND len(list_filter(embedding, lambda x: x::DOUBLE BETWEEN 0.35 AND 0.5)) > 0")
def threshold_vector_any(spark, d):
    return extraction.threshold_vector(table(spark, d, "embeddings"), "embedding", 0.35, 0.5).select("vec_id")


@R.add("threshold_vector_component", "SELECT vec_id FROM embeddings WHERE embedding[2]::DOUBLE BETWEEN -0.1 AND 0.1")
def threshold_vector_component(spark, d):
    return extraction.threshold_vector(table(spark, d, "embeddings"), "embedding", -0.1, 0.1, "component", 1).select("vec_id")


@R.add("threshold_points_below", "SELECT p_partkey, p_size FROM part WHERE p_size <= 12")
def threshold_points_below(spark, d):
    return extraction.threshold_points(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", below=12.9)


@R.add("threshold_points_between", "SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice BETWEEN 905.5 AND 1200.25")
def threshold_points_between(spark, d):
    return extraction.threshold_points(table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 1200.25, 905.5)


@R.add("mask_cells", "SELECT event_id FROM events WHERE event_id % 7 = 0 AND event_id < (SELECT count(*) // 7 * 7 FROM events)")
def mask_cells(spark, d):
    events = table(spark, d, "events").select("event_id")
    return extraction.mask(events, "event_id", 7, events.count())


@R.add("extract_structured", """WITH p AS (SELECT range AS id, range % 20 AS i, range // 20 % 15 AS j, range // 300 AS k FROM range(3000))
  SELECT id, CAST(ceil((i - 2) / 3.0) AS BIGINT) AS i, CAST(ceil((j - 1) / 2.0) AS BIGINT) AS j, k FROM p WHERE i BETWEEN 2 AND 16 AND ((i - 2) % 3 = 0 OR i = 16) AND j BETWEEN 1 AND 11 AND ((j - 1) % 2 = 0 OR j = 11) AND k BETWEEN 0 AND 4""")
def extract_structured(spark, d):
    i = F.col("id")
    points = spark.range(3000).select("id", (i % 20).alias("i"), (F.floor(i / 20) % 15).alias("j"), F.floor(i / 300).alias("k"))
    return extraction.extract_structured(points, ["i", "j", "k"], [2, 1, 0], [17, 12, 5], [3, 2, 1], include_boundary=True)


def _implicit(name, value, sql):
    @R.add(f"extract_points_{name}", f"SELECT {LINES} FROM lineitem WHERE {sql} <= 0")
    def run(spark, d):
        x, y, z = xyz()
        return extraction.extract_points(table(spark, d, "lineitem"), value(x, y * 100, z * 100)).select(*LINE)


_implicit("sphere", lambda *p: V.sphere(*p, (25.0, 5.0, 4.0), 6.5), "((l_quantity - 25)*(l_quantity - 25) + (l_discount*100 - 5)*(l_discount*100 - 5) + (l_tax*100 - 4)*(l_tax*100 - 4) - 42.25)")
_implicit("plane", lambda *p: V.plane(*p, (25.5, 5.25, 4.25), (1.0, -2.0, 0.5)), "((l_quantity - 25.5) * 1.0 + (l_discount*100 - 5.25) * -2.0 + (l_tax*100 - 4.25) * 0.5)")
_implicit("box", lambda *p: V.box(*p, (10.5, 1.5, 1.5), (30.5, 6.5, 5.5)), "greatest(10.5 - l_quantity, l_quantity - 30.5, 1.5 - l_discount*100, l_discount*100 - 6.5, 1.5 - l_tax*100, l_tax*100 - 5.5)")
_implicit("cylinder", lambda *p: V.cylinder(*p, (25.0, 5.0, 4.0), (1.0, 0.0, 0.0), 2.5), "((l_discount*100 - 5)*(l_discount*100 - 5) + (l_tax*100 - 4)*(l_tax*100 - 4) - 6.25)")
_implicit("frustum", lambda *p: V.frustum(*p, [((20.25, 0.0, 0.0), (1.0, 0.0, 0.0)), ((0.0, 4.5, 0.0), (0.0, 1.0, 0.0))]), "greatest(l_quantity - 20.25, l_discount*100 - 4.5)")


@R.add("extract_geometry", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING max(l_quantity - 25.5) <= 0")
def extract_geometry(spark, d):
    return extraction.extract_geometry(table(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") - 25.5)


@R.add("extract_geometry_boundary", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_quantity - 25.5) <= 0 AND max(l_quantity - 25.5) >= 0")
def extract_geometry_boundary(spark, d):
    return extraction.extract_geometry(table(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity") - 25.5, only_boundary=True)


@R.add("ghost_cell_remove", "SELECT event_id FROM events WHERE (user_id % 16) & 5 = 0")
def ghost_cell_remove(spark, d):
    return extraction.remove_ghosts(table(spark, d, "events").withColumn("ghost", (F.col("user_id") % 16).cast("int")), "ghost", 5).select("event_id")


@R.add("ghost_cell_classify", "SELECT range AS cell, CASE WHEN range % 9 IN (0, 8) OR range // 9 IN (0, 6) THEN 1 ELSE 0 END AS ghost FROM range(63)")
def ghost_cell_classify(spark, d):
    i, j = F.col("id") % 9, F.floor(F.col("id") / 9)
    return spark.range(63).select(F.col("id").alias("cell"), F.when(i.isin(0, 8) | j.isin(0, 6), 1).otherwise(0).alias("ghost"))


@R.add("cell_average", "SELECT l_orderkey, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM lineitem GROUP BY 1")
def cell_average(spark, d):
    return rounded(extraction.cell_average(table(spark, d, "lineitem"), "l_orderkey", "l_quantity", "l_tax"), 6)


@R.add("point_average", "SELECT p_partkey, round(avg(o_totalprice) + 3e-7, 4) AS o_totalprice FROM part LEFT JOIN (SELECT l_partkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey) ON l_partkey = p_partkey GROUP BY 1")
def point_average(spark, d):
    incidence = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("p_partkey"), "o_totalprice")
    out = extraction.point_average(incidence, table(spark, d, "part").select("p_partkey"), "p_partkey", "o_totalprice")
    return rounded(out.withColumn("o_totalprice", F.col("o_totalprice") + 3e-7))  # sums of doubles come in any order: ties go up


# Field transforms.


def _row_field(name, columns, sql):
    @R.add(name, f"SELECT {LINES}, {sql} FROM lineitem")
    def run(spark, d):
        return table(spark, d, "lineitem").select(*LINE, *(F.round(c, 6).alias(k) for k, c in columns(*xyz()).items()))


for base, fn in (("e", "ln"), ("2", "log2"), ("10", "log10")):
    _row_field(f"log_values_{base}", lambda x, y, z, base=base: {"v": V.log_value(y, base)}, f"round({fn}(greatest(l_discount, 1.1754943508222875e-38)), 6) AS v")
_row_field("point_elevation", lambda *p: {"elevation": V.elevation(*p, (5.0, 0.0, 0.0), (45.0, 0.1, 0.0), (0.0, 10.0))},
           "round(10 * greatest(0, least(1, ((l_quantity - 5) * 40.0 + l_discount * 0.1) / 1600.01)), 6) AS elevation")
_row_field("point_transform", lambda *p: dict(zip("xyz", V.affine(*p, [[2, 0, 1, 5], [0, 3, 0, -1], [0.5, 0, 1, 0], [0, 0, 0, 1]]))),
           "round(2*l_quantity + l_tax + 5, 6) AS x, round(3*l_discount - 1, 6) AS y, round(0.5*l_quantity + l_tax, 6) AS z")
_row_field("point_rotation", lambda *p: dict(zip("xyz", V.affine(*p, V.rotation(90, (0, 0, 1))))), "round(-l_discount, 6) + 0.0 AS x, round(l_quantity, 6) AS y, round(l_tax, 6) AS z")
_row_field("warp", lambda x, y, z: {"x": x + 0.25 * y, "y": y + 0.25 * x, "z": z + 0.25}, "round(l_quantity + 0.25*l_discount, 6) AS x, round(l_discount + 0.25*l_quantity, 6) AS y, round(l_tax + 0.25, 6) AS z")
_row_field("cylindrical_transform", lambda x, y, z: {c: V.to_cylindrical(x - 25, y * 100 - 5, z)[c] for c in ("r", "theta", "z")},
           """round(sqrt((l_quantity-25)*(l_quantity-25) + (l_discount*100-5)*(l_discount*100-5)), 6) AS r,
  round(CASE WHEN l_quantity = 25 AND l_discount*100-5 = 0 THEN 0 WHEN l_quantity < 25 THEN pi() - asin((l_discount*100-5) / sqrt((l_quantity-25)*(l_quantity-25) + (l_discount*100-5)*(l_discount*100-5)))
  ELSE asin((l_discount*100-5) / sqrt((l_quantity-25)*(l_quantity-25) + (l_discount*100-5)*(l_discount*100-5))) END, 6) AS theta, round(l_tax, 6) AS z""")  # fmt: skip
_row_field("spherical_transform", lambda x, y, z: {c: V.to_spherical(x - 25, y * 100 - 5, z * 100 + 1)[c] for c in ("r", "theta", "phi")},
           """round(sqrt((l_quantity-25)*(l_quantity-25) + (l_discount*100-5)*(l_discount*100-5) + (l_tax*100+1)*(l_tax*100+1)), 6) AS r,
  round(acos((l_tax*100+1) / sqrt((l_quantity-25)*(l_quantity-25) + (l_discount*100-5)*(l_discount*100-5) + (l_tax*100+1)*(l_tax*100+1))), 6) AS theta,
  round(CASE WHEN atan2(l_discount*100-5, l_quantity-25) < 0 THEN atan2(l_discount*100-5, l_quantity-25) + 2*pi() ELSE atan2(l_discount*100-5, l_quantity-25) END, 6) AS phi""")  # fmt: skip
_row_field("rgb_to_lab", lambda x, y, z: {c: V.rgb_to_lab(x / 64, y * 8, z * 10)[c] for c in "lab"}, """round(116*fy - 16, 6) AS l, round(500*(fx - fy), 6) AS a, round(200*(fy - fz), 6) AS b FROM (SELECT *,
  CASE WHEN tx > 216/24389.0 THEN cbrt(tx) ELSE (24389/27.0*tx + 16)/116 END AS fx, CASE WHEN ty > 216/24389.0 THEN cbrt(ty) ELSE (24389/27.0*ty + 16)/116 END AS fy, CASE WHEN tz > 216/24389.0 THEN cbrt(tz) ELSE (24389/27.0*tz + 16)/116 END AS fz
  FROM (SELECT *, (0.4124564*r + 0.3575761*g + 0.1804375*b)/0.95047 AS tx, 0.2126729*r + 0.7151522*g + 0.0721750*b AS ty, (0.0193339*r + 0.1191920*g + 0.9503041*b)/1.08883 AS tz
  FROM (SELECT *, CASE WHEN l_quantity/64 <= 0.04045 THEN l_quantity/64/12.92 ELSE pow((l_quantity/64 + 0.055)/1.055, 2.4) END AS r, CASE WHEN l_discount*8 <= 0.04045 THEN l_discount*8/12.92 ELSE pow((l_discount*8 + 0.055)/1.055, 2.4) END AS g,
  CASE WHEN l_tax*10 <= 0.04045 THEN l_tax*10/12.92 ELSE pow((l_tax*10 + 0.055)/1.055, 2.4) END AS b FROM lineitem))) lineitem --""".replace(" --", ""))  # fmt: skip
R.sql["rgb_to_lab"] = R.sql["rgb_to_lab"].removesuffix(" FROM lineitem")
RAMP = [(0, 0, 1), (0, 1, 0), (1, 0, 0)]
_row_field("field_to_colors", lambda x, y, z: {c: F.get(V.colour(x, 0.0, 50.0, RAMP), F.lit(k)) for k, c in enumerate("rgb")},
           "round(greatest(0, least(1, l_quantity/25 - 1)), 6) AS r, round(1 - abs(l_quantity/25 - 1), 6) AS g, round(greatest(0, 1 - l_quantity/25), 6) AS b")
_row_field("cross_product", lambda x, y, z: {f"c{k}": F.get(V.cross(F.array(x, y, z), F.array(z, x, y)), F.lit(k)) for k in range(3)}, "round(l_discount*l_discount - l_tax*l_quantity, 6) AS c0, round(l_tax*l_tax - l_quantity*l_discount, 6) AS c1, round(l_quantity*l_quantity - l_discount*l_tax, 6) AS c2")
_row_field("quadratic_roots", lambda x, y, z: {k: V.quadratic_roots(y + 0.5, -x, z)[k] for k in ("r1", "r2")},
           "round((l_quantity - sqrt(l_quantity*l_quantity - 4*(l_discount+0.5)*l_tax)) / (2*(l_discount+0.5)), 6) AS r1, round((l_quantity + sqrt(l_quantity*l_quantity - 4*(l_discount+0.5)*l_tax)) / (2*(l_discount+0.5)), 6) AS r2")


@R.add("dot_product", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS d FROM embeddings")
def dot_product(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.dot(F.col("embedding").cast("array<double>"), F.col("embedding").cast("array<double>")), 5).alias("d"))


@R.add("vector_magnitude", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS magnitude FROM embeddings")
def vector_magnitude(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(V.magnitude(F.col("embedding").cast("array<double>")), 5).alias("magnitude"))


@R.add("normalize", "SELECT vec_id, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS first FROM embeddings")
def normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(V.normalize(F.col("embedding").cast("array<double>")), F.lit(0)), 5).alias("first"))


@R.add("generate_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pointid FROM orders")
def generate_ids(spark, d):
    from tesserae.operators.primitives import scan

    return scan(table(spark, d, "orders").select("o_orderkey"), F.lit(1), "o_orderkey", out="pointid").select("o_orderkey", (F.col("pointid") - 1).cast("long").alias("pointid"))
