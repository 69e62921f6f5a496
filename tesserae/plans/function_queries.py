"""Queries of matrices, transforms, geometry, ranges, floating point, hashes, splines, warps and masks over line items and suppliers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tesserae.functions import algebra as A
from tesserae.functions import vectors as V
from tesserae.operators import extraction, spatial
from tesserae.plans.field_queries import LINE, LINES, rounded
from tesserae.plans.grid_queries import VOXELS, dims, stars, voxels
from tesserae.plans.registry import Registry, table

R = Registry()


def _lines(name, columns, sql):
    @R.add(name, f"SELECT {LINES}, {sql} FROM lineitem")
    def run(spark, d):
        return table(spark, d, "lineitem").select(*LINE, *((F.round(c, 6) + F.lit(0.0)).alias(k) if number else c.alias(k) for k, (c, number) in columns(*map(F.col, ("l_quantity", "l_discount", "l_tax"))).items()))


def _numbers(**columns):
    return {k: (c, True) for k, c in columns.items()}


def rows3(q, d, t):
    return [[q, 1.0, d], [2.0, t + 3, 1.0], [d, 0.5, q + 7]]


# Its determinant, written out.
_DET = "(q*((t+3)*(q+7) - 0.5) - (2*(q+7) - d) + d*(1 - d*(t+3)))"


def _sub(sql: str) -> str:
    for a, b in (("q", "l_quantity"), ("d", "l_discount"), ("t", "l_tax")):
        sql = re.sub(rf"\b{a}\b", b, sql)
    return sql


_lines("matrix_inverse", lambda Q, D, T: _numbers(a=A.inverse(rows3(Q, D, T))[0][0], b=A.inverse(rows3(Q, D, T))[1][2], c=A.inverse(rows3(Q, D, T))[2][1], det=A.determinant(rows3(Q, D, T))),
       _sub(f"round(((t+3)*(q+7) - 0.5) / {_DET}, 6) AS a, round(-(q*1 - 2*d) / {_DET}, 6) AS b, round(-(q*0.5 - d) / {_DET}, 6) AS c, round({_DET}, 6) AS det"))
_lines("matrix_multiply", lambda Q, D, T: _numbers(a=A.multiply(rows3(Q, D, T), A.transpose(rows3(Q, D, T)))[0][1], b=A.apply(rows3(Q, D, T), [1.0, Q, T])[2]), _sub("round(q*2 + t + 3 + d, 6) AS a, round(d + 0.5*q + (q+7)*t, 6) AS b"))
_lines("matrix_solve_3", lambda Q, D, T: _numbers(x=A.solve(rows3(Q, D, T), [A.total([Q * 1.0, F.lit(2.0), D * 3]), A.total([F.lit(2.0), 2 * (T + 3), F.lit(3.0)]), A.total([D, F.lit(1.0), 3 * (Q + 7)])])[1]), "2.0 AS x")
_lines("transform_perspective", lambda Q, D, T: _numbers(**dict(zip("xyz", A.transform_point([[1.0, 0.0, 0.0, 2.0], [0.0, 2.0, 0.0, 0.0], [0.0, 0.0, 1.0, -1.0], [0.0, 0.0, 0.5, 3.0]], [Q, D, T])))),
       _sub("round((q + 2) / (0.5*t + 3), 6) AS x, round(2*d / (0.5*t + 3), 6) AS y, round((t - 1) / (0.5*t + 3), 6) + 0.0 AS z"))
_lines("transform_composed", lambda Q, D, T: _numbers(**dict(zip("xyz", A.transform_point(A.multiply(A.translation(1.0, -2.0, 0.5), A.scaling(2.0, 3.0, 4.0)), [Q, D, T]))), u=A.transform_vector(A.translation(1.0, -2.0, 0.5), [Q, D, T])[0]),
       _sub("round(2*q + 1, 6) AS x, round(3*d - 2, 6) AS y, round(4*t + 0.5, 6) AS z, round(q, 6) AS u"))
_lines("orthonormalize", lambda Q, D, T: _numbers(a=A.orthonormal([[Q, D, 1.0], [0.0, Q, T]])[1][0], b=A.orthonormal([[Q, D, 1.0], [0.0, Q, T]])[1][1], r=A.reciprocal_magnitude([Q, D, T])),
       _sub("round(-(d*q + t)/(q*q + d*d + 1)*q / sqrt(q*q + t*t - (d*q + t)*(d*q + t)/(q*q + d*d + 1)), 6) + 0.0 AS a, round((q - (d*q + t)/(q*q + d*d + 1)*d) / sqrt(q*q + t*t - (d*q + t)*(d*q + t)/(q*q + d*d + 1)), 6) AS b, round(1 / sqrt(q*q + d*d + t*t), 6) AS r"))
_lines("geometry_distances", lambda Q, D, T: _numbers(plane=A.plane_distance([Q, D, T], [1.0, 0.0, 0.0], [2.0, 1.0, 2.0]), line=A.line_distance([Q, D, T], [0.0, 0.0, 0.0], [0.0, 3.0, 4.0]), ray=A.ray_plane([0.0, 0.0, 0.0], [Q, 1.0, T], [30.0, 0.0, 0.0], [1.0, 0.0, 0.0])[0]),
       _sub("round((2*(q - 1) + d + 2*t) / 3, 6) AS plane, round(sqrt((d*4 - t*3)*(d*4 - t*3) + q*q*25) / 5, 6) AS line, round(30 / q, 6) AS ray"))
_lines("geometry_circumcentre", lambda Q, D, T: _numbers(x=A.circumcentre([[0.0, 0.0], [Q, 0.0], [D, T + 1]])[0], y=A.circumcentre([[0.0, 0.0], [Q, 0.0], [D, T + 1]])[1], s=A.circumcentre([[1.0, 1.0, 1.0], [Q + 2, 1.0, 1.0], [1.0, T + 2, 1.0], [1.0, 1.0, D + 3]])[2]),
       _sub("round(q / 2, 6) AS x, round((d*d + (t+1)*(t+1) - d*q) / (2*(t+1)), 6) AS y, round(1 + (d + 2) / 2, 6) AS s"))
_lines("range_functions", lambda Q, D, T: _numbers(length=A.length(A.span(D * 100, Q)), both=A.length(A.intersection(A.span(D * 100, Q), A.span(5.0, 20.0))), all=A.length(A.union(A.span(D * 100, Q), A.span(5.0, 20.0))), volume=A.volume([A.span(0.0, Q), A.span(T, 1.0), A.span(3.0, 2.0)])) | {"inside": (A.contains(A.span(D * 100, Q), 7.0), False)},
       _sub("round(greatest(q - d*100, 0), 6) AS length, round(greatest(least(q, 20) - greatest(d*100, 5), 0), 6) AS both, round(CASE WHEN d*100 > q THEN 15 ELSE greatest(q, 20) - least(d*100, 5) END, 6) AS \"all\", 0.0 AS volume, 7 BETWEEN d*100 AND q AS inside"))
_lines("float_parts", lambda Q, D, T: {"sign": (A.sign_bit(Q - 25), False), "exponent": (A.frexp(Q)["exponent"].cast("long"), False), "whole": (A.ldexp(A.frexp(Q)["mantissa"], A.frexp(Q)["exponent"]) == Q, False), "copied": (A.copy_sign(Q, D - 0.055), False), "finite": (A.is_finite(Q), False), "apart": (A.float_distance(Q, Q + F.pow(F.lit(2.0), F.floor(F.log2(Q + 1e-9)) - 51)), False), "quotient": (A.quotient(Q, F.lit(4.0)), False)},
       _sub("q < 25 AS sign, CAST(floor(log2(q + 1e-9)) + 1 AS BIGINT) AS exponent, true AS whole, CASE WHEN d < 0.055 THEN -q ELSE q END AS copied, true AS finite, CAST(2 AS BIGINT) AS apart, CAST(round_even(q / 4, 0) AS BIGINT) AS quotient"))
_lines("difference_of_products", lambda Q, D, T: {"ab": (A.difference_of_products(Q * 100000001.0, Q * 100000001.0, Q * 100000000.0, Q * 100000002.0), False)}, _sub("q * q AS ab"))
_lines("hash_fnv1a", lambda Q, D, T: {"h": (A.fnv1a(F.col("l_orderkey"), F.col("l_linenumber")), False)}, "((xor(((xor(2166136261::BIGINT, l_orderkey::BIGINT) * 16777619) & 4294967295), l_linenumber::BIGINT) * 16777619) & 4294967295) AS h")
_lines("newton_root", lambda Q, D, T: _numbers(x=A.newton(lambda x: x * x * x - Q, lambda x: 3 * x * x, Q, 30)), _sub("round(cbrt(q), 6) AS x"))
_lines("coordinates_back", lambda Q, D, T: _numbers(**dict(zip("xyz", A.from_cylindrical(*(V.to_cylindrical(Q - 25, D, T)[c] for c in ("r", "theta", "z"))))), w=A.from_spherical(*(V.to_spherical(Q, D, T)[c] for c in ("r", "theta", "phi")))[1]),
       _sub("round(q - 25, 6) AS x, round(d, 6) AS y, round(t, 6) AS z, round(d, 6) AS w"))
_lines("warp_scalar", lambda Q, D, T: _numbers(**dict(zip("xyz", A.warp([Q, D, T], [0.0, 0.0, 1.0], 2 * Q)))), _sub("round(q, 6) AS x, round(d, 6) AS y, round(t + 2*q, 6) AS z"))
_lines("warp_vector", lambda Q, D, T: _numbers(**dict(zip("xyz", A.warp([Q, D, T], [T, Q, D], 0.5)))), _sub("round(q + 0.5*t, 6) AS x, round(d + 0.5*q, 6) AS y, round(t + 0.5*d, 6) AS z"))
_lines("colours_rgba", lambda Q, D, T: {"rgba": (A.colour_bytes([Q / 50, D * 10, T * 12], 1.0), False), "magnitude": (A.colour_bytes([F.get(V.colour(F.sqrt(A.inner([Q, D], [Q, D])), 0.0, 60.0, [(0, 0, 0), (1, 1, 1)]), F.lit(k)) for k in range(3)]), False)},
       _sub("[CAST(least(255, floor(q/50*255 + 0.5)) AS INTEGER), CAST(least(255, floor(d*10*255 + 0.5)) AS INTEGER), CAST(least(255, floor(t*12*255 + 0.5)) AS INTEGER), 255] AS rgba, [CAST(floor(sqrt(q*q + d*d)/60*255 + 0.5) AS INTEGER), CAST(floor(sqrt(q*q + d*d)/60*255 + 0.5) AS INTEGER), CAST(floor(sqrt(q*q + d*d)/60*255 + 0.5) AS INTEGER)] AS magnitude"))
_lines("implicit_gradients", lambda Q, D, T: _numbers(planes=A.multi_plane([Q, D, T], [([25.0, 0.0, 0.0], [1.0, 0.0, 0.0]), ([0.0, 0.0, 0.0], [-1.0, 2.0, 0.0])]), sphere=A.sphere_gradient([Q, D, T], [25.0, 0.0, 0.0])[0], cylinder=A.cylinder_gradient([Q, D, T], [0.0, 0.0, 0.0], [0.0, 1.0, 1.0])[1]),
       _sub("round(greatest(q - 25, 2*d - q), 6) AS planes, round(2*(q - 25), 6) AS sphere, round(2*(d - (d + t)/2), 6) + 0.0 AS cylinder"))


@R.add("mask_points", "SELECT o_orderkey, n FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n FROM orders) WHERE n % 7 = 0 AND n < 7 * ((SELECT count(*) FROM orders) // 7)")
def mask_points(spark, d):
    return extraction.mask_points(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7).select("o_orderkey", "n")


_CATMULL = "(b + t*((c-a)/2 + t*(3*(c-b) - (c-a) - (d-b)/2 + t*(2*(b-c) + (c-a)/2 + (d-b)/2))))"


@R.add("spline_evaluate", VOXELS + f""", s AS (SELECT s_suppkey AS id, s_suppkey * 37 % 1000 / 100.0 / 4 AS u, s_suppkey * 91 % 1000 / 100.0 / 4 AS v, s_suppkey * 53 % 1000 / 100.0 / 4 AS w FROM supplier),
  o AS (SELECT a.range AS o FROM range(4) a), p AS (SELECT s.id, oy.o AS oy, oz.o AS oz, ox.o AS ox, u - floor(u) AS tu, v - floor(v) AS tv, w - floor(w) AS tw, l.f FROM s, o ox, o oy, o oz, n JOIN l ON l.i = least(greatest(floor(u) - 1 + ox.o, 0), n.n - 1) AND l.j = least(greatest(floor(v) - 1 + oy.o, 0), n.n - 1) AND l.k = least(greatest(floor(w) - 1 + oz.o, 0), n.n - 1)),
  x AS (SELECT id, oy, oz, tv, tw, {_CATMULL} AS f FROM (SELECT id, oy, oz, tv, tw, tu AS t, max(f) FILTER (ox = 0) AS a, max(f) FILTER (ox = 1) AS b, max(f) FILTER (ox = 2) AS c, max(f) FILTER (ox = 3) AS d FROM p GROUP BY ALL)),
  y AS (SELECT id, oz, tw, {_CATMULL} AS f FROM (SELECT id, oz, tw, tv AS t, max(f) FILTER (oy = 0) AS a, max(f) FILTER (oy = 1) AS b, max(f) FILTER (oy = 2) AS c, max(f) FILTER (oy = 3) AS d FROM x GROUP BY ALL))
  SELECT id, round({_CATMULL}, 5) AS f FROM (SELECT id, tw AS t, max(f) FILTER (oz = 0) AS a, max(f) FILTER (oz = 1) AS b, max(f) FILTER (oz = 2) AS c, max(f) FILTER (oz = 3) AS d FROM y GROUP BY ALL)""")
def spline_evaluate(spark, d):
    at = stars(spark, d).select("id", *((F.col(c) / 4).alias(c) for c in "xyz"))
    return rounded(spatial.spline(at, voxels(spark, d).select("i", "j", "k", "f"), "f", dims(spark, d)), 5)


