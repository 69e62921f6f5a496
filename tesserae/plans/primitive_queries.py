"""Queries of data-parallel primitives and array views, over orders, events, part and supplier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import vectors as V
from tesserae.operators import graph
from tesserae.operators import primitives as P
from tesserae.plans.registry import Registry, table

R = Registry()


def cents():
    return F.round(F.col("value") * 100).cast("long")


@R.add("bitfield_to_set", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def bitfield_to_set(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey")


@R.add("copy_cast", "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS price FROM orders")
def copy_cast(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("bigint").alias("price"))


@R.add("copy_if", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000")
def copy_if(spark, d):
    return table(spark, d, "orders").where("o_totalprice > 200000").select("o_orderkey", "o_totalprice")


@R.add("copy_subrange", "SELECT event_id - 100 + 7 AS event_id, user_id FROM events WHERE event_id BETWEEN 100 AND 599")
def copy_subrange(spark, d):
    return P.copy_subrange(table(spark, d, "events").select("event_id", "user_id"), "event_id", 100, 500, 7)


@R.add("count_set_bits", "SELECT CAST(sum(bit_count(event_id)) AS BIGINT) AS bits, count(*) FILTER (WHERE event_type = 'click') AS flags FROM events")
def count_set_bits(spark, d):
    return table(spark, d, "events").agg(F.sum(F.bit_count("event_id")).cast("long").alias("bits"), F.count_if(F.col("event_type") == "click").alias("flags"))


@R.add("fill", "SELECT event_id, 7 AS filled FROM events")
def fill(spark, d):
    return table(spark, d, "events").select("event_id", F.lit(7).alias("filled"))


@R.add("lower_bounds", "SELECT p_partkey, (SELECT count(*) FROM orders WHERE o_totalprice / 150 < p_retailprice) AS position FROM part")
def lower_bounds(spark, d):
    data = table(spark, d, "orders").select((F.col("o_totalprice") / 150).alias("v"))
    return P.bounds_search(data, "v", table(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice").select("p_partkey", "position")


@R.add("upper_bounds", "SELECT p_partkey, (SELECT count(*) FROM part q WHERE q.p_size <= p.p_size) AS position FROM part p")
def upper_bounds(spark, d):
    part = table(spark, d, "part")
    return P.bounds_search(part, "p_size", part.select("p_partkey", "p_size"), "p_size", upper=True).select("p_partkey", "position")


@R.add("reduce_sum", "SELECT CAST(1000 + sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events")
def reduce_sum(spark, d):
    return table(spark, d, "events").agg((F.lit(1000) + F.sum(cents())).cast("long").alias("total"))


@R.add("reduce_product", "SELECT round(product(1 + s_suppkey / 100000.0), 6) AS product FROM supplier")
def reduce_product(spark, d):
    return table(spark, d, "supplier").agg(F.round(F.product(1 + F.col("s_suppkey") / F.lit(100000.0)), 6).alias("product"))


@R.add("reduce_min_max", "SELECT min(value) AS low, max(value) AS high FROM events")
def reduce_min_max(spark, d):
    return table(spark, d, "events").agg(F.min("value").alias("low"), F.max("value").alias("high"))


@R.add("reduce_bits", "SELECT bit_and(event_id | 4096) AS b_and, bit_or(event_id) AS b_or, bit_xor(event_id) AS b_xor FROM events")
def reduce_bits(spark, d):
    return table(spark, d, "events").agg(F.bit_and(F.col("event_id").bitwiseOR(4096)).alias("b_and"), F.bit_or("event_id").alias("b_or"), F.bit_xor("event_id").alias("b_xor"))


@R.add("reduce_by_key", "SELECT user_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def reduce_by_key(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.sum(cents()).alias("total"), F.count("*").alias("n"))


ISLANDS = """WITH m AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS c,
  CAST(round(value * 100) AS BIGINT) AS cents FROM events),
  r AS (SELECT *, CAST(sum(c) OVER (ORDER BY event_id) - 1 AS BIGINT) AS run FROM m)"""


@R.add("reduce_by_key_runs", ISLANDS + " SELECT run, event_type, CAST(sum(cents) AS BIGINT) AS total, min(event_id) AS first FROM r GROUP BY 1, 2")
def reduce_by_key_runs(spark, d):
    return P.reduce_by_run(table(spark, d, "events").withColumn("cents", cents()), "event_type", "cents", "event_id").withColumn("run", F.col("run").cast("long"))


def _scan_sql(frame: str) -> str:
    return f"SELECT event_id, CAST(coalesce(sum(CAST(round(value * 100) AS BIGINT)) OVER ({frame}), 0) AS BIGINT) AS scan FROM events"


@R.add("scan_inclusive", _scan_sql("ORDER BY event_id"))
def scan_inclusive(spark, d):
    return P.scan(table(spark, d, "events"), cents(), "event_id").select("event_id", "scan")


@R.add("scan_exclusive", _scan_sql("ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))
def scan_exclusive(spark, d):
    return P.scan(table(spark, d, "events"), cents(), "event_id", exclusive=True).select("event_id", "scan")


@R.add(
    "scan_extended",
    """WITH s AS (SELECT row_number() OVER (ORDER BY event_id) AS index, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER (ORDER BY event_id) AS BIGINT) AS scan FROM events)
    SELECT * FROM s UNION ALL SELECT 0, 0""",
)
def scan_extended(spark, d):
    return P.scan_extended(table(spark, d, "events"), cents(), "event_id")


@R.add("scan_inclusive_by_key", _scan_sql("PARTITION BY user_id ORDER BY event_id"))
def scan_inclusive_by_key(spark, d):
    return P.scan_by_key(table(spark, d, "events"), cents(), "user_id", "event_id").select("event_id", "scan")


@R.add("scan_exclusive_by_key", _scan_sql("PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"))
def scan_exclusive_by_key(spark, d):
    return P.scan_by_key(table(spark, d, "events"), cents(), "user_id", "event_id", exclusive=True).select("event_id", "scan")


@R.add("schedule_index", "SELECT range AS id, range * range % 97 AS value FROM range(1000)")
def schedule_index(spark, d):
    return spark.range(1000).select("id", (F.col("id") * F.col("id") % 97).alias("value"))


@R.add("sort_values", "SELECT o_totalprice, o_orderkey FROM orders ORDER BY 1, 2")
def sort_values(spark, d):
    return table(spark, d, "orders").select("o_totalprice", "o_orderkey").orderBy("o_totalprice", "o_orderkey")


@R.add("sort_by_key", "SELECT o_orderpriority, o_orderkey, o_totalprice FROM orders ORDER BY 1, 2")
def sort_by_key(spark, d):
    return table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice").orderBy("o_orderpriority", "o_orderkey")


@R.add("stable_sort_indices", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey) AS rank FROM part")
def stable_sort_indices(spark, d):
    return P.scan(table(spark, d, "part"), F.lit(1), "p_size", "p_partkey", out="rank").select("p_partkey", F.col("rank").cast("long").alias("rank"))


@R.add("unique_sorted", "SELECT DISTINCT p_brand FROM part")
def unique_sorted(spark, d):
    return table(spark, d, "part").select("p_brand").distinct()


@R.add("unique_adjacent", "SELECT event_id, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type")
def unique_adjacent(spark, d):
    return P.unique_adjacent(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id")


@R.add("transform_binary", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def transform_binary(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"))


@R.add("adjacent_difference", "SELECT event_id, user_id - lag(user_id) OVER (ORDER BY event_id) AS difference FROM events")
def adjacent_difference(spark, d):
    return P.neighbours(table(spark, d, "events").select("event_id", "user_id"), "event_id", {"b": "user_id"}).select("event_id", (F.col("user_id") - F.col("b")).alias("difference"))


@R.add("is_monotonic", "SELECT bool_and(b IS NULL OR ts >= b) AS increasing, bool_and(b IS NULL OR ts <= b) AS decreasing FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS b FROM events)")
def is_monotonic(spark, d):
    return P.is_monotonic(table(spark, d, "events").select("event_id", "ts"), "ts", "event_id")


@R.add("offsets_from_counts", "SELECT user_id, n, CAST(coalesce(sum(n) OVER (ORDER BY user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def offsets_from_counts(spark, d):
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return P.scan(counts, F.col("n"), "user_id", out="start", exclusive=True).select("user_id", "n", "start")


@R.add("counts_from_offsets", "WITH o AS (SELECT event_id AS pos, event_type FROM (SELECT *, lag(event_type) OVER (ORDER BY event_id) AS b FROM events) WHERE b IS DISTINCT FROM event_type) SELECT pos, pos - lag(pos) OVER (ORDER BY pos) AS n FROM o")
def counts_from_offsets(spark, d):
    starts = P.unique_adjacent(table(spark, d, "events").select("event_id", "event_type"), "event_type", "event_id").select(F.col("event_id").alias("pos"))
    return P.neighbours(starts, "pos", {"b": "pos"}).select("pos", (F.col("pos") - F.col("b")).alias("n"))


# Array views.


@R.add("view_group_vec", "SELECT event_id // 4 AS g, list(user_id ORDER BY event_id) AS v FROM events GROUP BY 1")
def view_group_vec(spark, d):
    pairs = F.sort_array(F.collect_list(F.struct("event_id", "user_id")))  # four values
    return table(spark, d, "events").groupBy(F.expr("event_id div 4").alias("g")).agg(pairs["user_id"].alias("v"))


@R.add("view_group_vec_variable", "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY 1")
def view_group_vec_variable(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("v"))


@R.add("view_permutation", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def view_permutation(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@R.add("view_reverse", "SELECT row_number() OVER (ORDER BY event_id DESC) - 1 AS i, event_id FROM events")
def view_reverse(spark, d):
    rows = table(spark, d, "events").select("event_id", (-F.col("event_id")).alias("k"))
    return P.scan(rows, F.lit(1), "k", out="i").select((F.col("i") - 1).cast("long").alias("i"), "event_id")


@R.add("view_zip", """SELECT a.i AS index, s_suppkey, p_partkey FROM (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, s_suppkey FROM supplier) a
    JOIN (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS i, p_partkey FROM part) b USING (i)""")
def view_zip(spark, d):
    return P.zip_rows(table(spark, d, "supplier").select("s_suppkey"), table(spark, d, "part").select("p_partkey"), "s_suppkey", "p_partkey").select("index", "s_suppkey", "p_partkey")


@R.add("view_concatenate", "SELECT c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def view_concatenate(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")).unionAll(table(spark, d, "supplier").select("s_suppkey", "s_acctbal"))


@R.add("view_counting", "SELECT range AS i, 5 + 3 * range AS v FROM range(500)")
def view_counting(spark, d):
    return spark.range(500).select(F.col("id").alias("i"), (5 + 3 * F.col("id")).alias("v"))


@R.add("view_constant", "SELECT range AS i, 2.5::DOUBLE AS v FROM range(100)")
def view_constant(spark, d):
    return spark.range(100).select(F.col("id").alias("i"), F.lit(2.5).alias("v"))


@R.add("view_cartesian_product", "SELECT r_regionkey, n_nationkey, range AS k FROM region, nation, range(3)")
def view_cartesian_product(spark, d):
    return table(spark, d, "region").select("r_regionkey").crossJoin(table(spark, d, "nation").select("n_nationkey")).crossJoin(spark.range(3).select(F.col("id").alias("k")))


@R.add("view_uniform_coordinates", "SELECT range AS id, 1.0 + 0.5 * (range % 8) AS x, 2.0 * ((range // 8) % 6) AS y, -1.0 + (range // 48) AS z FROM range(192)")
def view_uniform_coordinates(spark, d):
    i = F.col("id")
    return spark.range(192).select("id", (1.0 + 0.5 * (i % 8)).alias("x"), (2.0 * (F.floor(i / 8) % 6)).alias("y"), (-1.0 + F.floor(i / 48)).alias("z"))


@R.add("view_stride", "SELECT event_id, user_id FROM events WHERE event_id >= 3 AND (event_id - 3) % 5 = 0")
def view_stride(spark, d):
    return table(spark, d, "events").where("event_id >= 3 AND (event_id - 3) % 5 = 0").select("event_id", "user_id")


@R.add("view_swizzle", "SELECT vec_id, [embedding[3], embedding[1], embedding[2]] AS v FROM embeddings")
def view_swizzle(spark, d):
    return table(spark, d, "embeddings").select("vec_id", V.swizzle(F.col("embedding"), (2, 0, 1)).alias("v"))


@R.add("view_extract_component", "SELECT vec_id, embedding[6] AS c FROM embeddings")
def view_extract_component(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(5)).alias("c"))


@R.add("view_composite", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, [l_quantity, l_discount, l_tax] AS v FROM lineitem")
def view_composite(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", V.composite(*map(F.col, ("l_quantity", "l_discount", "l_tax"))).alias("v"))


@R.add("view_slice", "SELECT event_id, value FROM events WHERE event_id BETWEEN 50 AND 149")
def view_slice(spark, d):
    return table(spark, d, "events").where(F.col("event_id").between(50, 149)).select("event_id", "value")


@R.add("random_uniform", "SELECT range AS id, (('0x' || substr(md5('7|' || range), 1, 12))::BIGINT)::DOUBLE / 281474976710656 AS u FROM range(1000)")
def random_uniform(spark, d):
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("7"), F.col("id").cast("string")).cast("binary")), 1, 12), 16, 10).cast("double")
    return spark.range(1000).select("id", (bits / float(1 << 48)).alias("u"))


# Joins, relabelling, graphs.


@R.add("inner_join", "SELECT l_orderkey, l_partkey, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3")
def inner_join(spark, d):
    items, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    items, orders = P.by_rows(items.count() + orders.count(), (items.select("l_orderkey", "l_partkey"), ["l_orderkey"]), (orders.select("o_orderkey", "o_custkey"), ["o_orderkey"]))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("l_orderkey", "l_partkey", "o_custkey").agg(F.count("*").alias("n"))


@R.add("renumber", "SELECT event_id, dense_rank() OVER (ORDER BY user_id) - 1 AS label FROM events")
def renumber(spark, d):
    return graph.renumber(table(spark, d, "events").select("event_id", "user_id"), "user_id", "label").select("event_id", "label")


@R.add(
    "graph_connectivity",
    """WITH RECURSIVE e AS (SELECT c_custkey AS a, -CAST(c_nationkey AS BIGINT) - 1 AS b FROM customer), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), n AS (SELECT DISTINCT a AS node FROM s),
  w AS (SELECT node, node AS r FROM n UNION SELECT w.node, s.b FROM w JOIN s ON w.r = s.a), l AS (SELECT node, min(r) AS label FROM w GROUP BY 1)
  SELECT node, dense_rank() OVER (ORDER BY label) - 1 AS component FROM l""",
)
def graph_connectivity(spark, d):
    """All customers and their nations (below 0) as nodes."""
    edges = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("a"), (-F.col("c_nationkey").cast("long") - 1).alias("b"))
    return graph.graph_connectivity(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct(), edges)


@R.add(
    "image_connectivity",
    """WITH RECURSIVE p AS (SELECT range AS id, range % 14 AS i, range // 14 AS j, (range * 7 + range // 3) % 3 AS v FROM range(140)),
  s AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.v = b.v AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1),
  w AS (SELECT id, id AS r FROM p UNION SELECT w.id, s.b FROM w JOIN s ON w.r = s.a), l AS (SELECT id, min(r) AS label FROM w GROUP BY 1)
  SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS component FROM l""",
)
def image_connectivity(spark, d):
    i = F.col("id")
    pixels = spark.range(140).select("id", (i % 14).alias("i"), F.floor(i / 14).alias("j"), ((i * 7 + F.floor(i / 3)) % 3).alias("v"))
    return graph.image_connectivity(pixels, "v")


@R.add(
    "image_connectivity_3d",
    """WITH RECURSIVE p AS (SELECT range AS id, range % 7 AS i, range // 7 % 6 AS j, range // 42 AS k, (range * 5 + range // 4) % 4 AS v FROM range(210)),
  s AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.v = b.v AND abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND abs(a.k - b.k) <= 1),
  w AS (SELECT id, id AS r FROM p UNION SELECT w.id, s.b FROM w JOIN s ON w.r = s.a), l AS (SELECT id, min(r) AS label FROM w GROUP BY 1)
  SELECT id, dense_rank() OVER (ORDER BY label) - 1 AS component FROM l""",
)
def image_connectivity_3d(spark, d):
    i = F.col("id")
    voxels = spark.range(210).select("id", (i % 7).alias("i"), (F.floor(i / 7) % 6).alias("j"), F.floor(i / 42).alias("k"), ((i * 5 + F.floor(i / 4)) % 4).alias("v"))
    return graph.image_connectivity(voxels, "v")


@R.add("cell_connectivity")
def cell_connectivity(spark, d):
    """All orders as cells, parts of a supplier as edges. Without SQL, as recursion over whole tables is too slow; a test holds it against brute force."""
    rows = table(spark, d, "lineitem")
    return graph.cell_connectivity(rows.select(F.col("l_orderkey").alias("cell"), F.struct("l_partkey", "l_suppkey").alias("edge")))


@R.add("pointer_jumping", "WITH RECURSIVE f AS (SELECT range AS node, CASE WHEN range % 10 = 0 THEN range ELSE range - 1 END AS parent FROM range(200)), w AS (SELECT node, parent FROM f UNION ALL SELECT w.node, f.parent FROM w JOIN f ON w.parent = f.node WHERE f.parent <> f.node) SELECT node, min(parent) AS root FROM w GROUP BY 1")
def pointer_jumping(spark, d):
    forest = spark.range(200).select(F.col("id").alias("node"), F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(F.col("id") - 1).alias("parent"))
    return graph.pointer_jump(forest)


@R.add("ranked_window", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders")
def ranked_window(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).cast("long").alias("rank"))
