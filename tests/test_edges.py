"""Catalogued queries against their SQL over tables made to be odd, crowded or large."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tesserae.plans import catalog


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else repr(float(x) + 0.0) if isinstance(x, (int, float)) else x


def compare(spark, folder, name, **tables):
    """Rows of the query, which must be those of its SQL, infinities and NaN included."""
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = Counter(map(plain, found.fetchall()))
    df = catalog.queries()[name](spark, str(folder)).select(*columns)
    got = Counter(plain(tuple(r)) for r in df.collect())
    assert got == want and want
    return got


def events(spark, values):
    return spark.createDataFrame([(i * 37, v) for i, v in enumerate(values)], "event_id long, value double")


def test_powers_at_the_edge_of_their_domain(spark, tmp_path):
    compare(spark, tmp_path, "scalar_power", events=events(spark, [0.0, -0.0, 10.0, 0.0, -5.0, None, 560.0]))


def test_logarithms_at_the_edge_of_their_domain(spark, tmp_path):
    compare(spark, tmp_path, "scalar_exponential", events=events(spark, [0.0, -0.0, 10.0, -10.0, -50.0, None, float("nan")]))


def joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_corners_of_meshes_are_not_broadcast(spark, sf_dir):
    """But for the points that are asked for; a join is planned twice, for the widest cell and for the corners."""
    assert joins(catalog.queries()["interpolate_in_cells"](spark, sf_dir)) <= 1
    assert not any(joins(catalog.queries()[q](spark, sf_dir)) for q in ("clip_volume", "cell_gradient", "point_gradient"))


def test_shared_places_are_compared_once(spark, tmp_path, monkeypatch):
    """Suppliers and parts that crowd five places each: rows compared don't grow with the crowd, and tasks do with the pairs."""
    from tesserae.operators import spatial

    compared, near = [], spatial._near

    def counted(*args):
        out = near(*args)
        compared.append(out.count())
        return out

    monkeypatch.setattr(spatial, "_near", counted)
    monkeypatch.setattr(spatial, "TASK_ROWS", 500)
    supplier = spark.range(100).select((F.col("id") % 5 + F.floor(F.col("id") / 5) * 1000).alias("s_suppkey"), F.lit(0.0).alias("s_acctbal"))
    part = spark.range(150).select((F.col("id") % 5 + F.floor(F.col("id") / 5) * 1000).alias("p_partkey"))
    for name in ("within_distance", "nearest_point", "friends_of_friends", "locate_in_boxes"):
        compare(spark, tmp_path, name, supplier=supplier, part=part)
    assert max(compared) <= 25
    assert catalog.queries()["within_distance"](spark, str(tmp_path)).rdd.getNumPartitions() > 1
    assert catalog.queries()["locate_in_boxes"](spark, str(tmp_path)).rdd.getNumPartitions() > 1


def test_lists_of_a_hot_place_are_cut(spark, monkeypatch):
    from tesserae.operators import spatial

    monkeypatch.setattr(spatial, "TOGETHER", 8)
    hot = spark.range(100).select("id", F.lit(1.0).alias("x"), F.when(F.col("id") < 98, 2.0).alias("y"))
    lists, shared = spatial.packed(hot, ["x", "y"], "id", "ids")
    assert shared and lists.count() > 8 and lists.agg(F.max(F.size("ids"))).first()[0] < 30
    assert spatial.within_distance(hot, hot, ["x", "y"], 1.0).distinct().count() == 98 * 98
    assert spatial.within_distance(hot.limit(0), hot, ["x", "y"], 1.0).count() == 0 and spatial.nearest(hot, hot.limit(0), ["x", "y"], 1.0).count() == 0
    halos = {r.id: r.halo for r in spatial.friends_of_friends(hot, ["x", "y"], 1.0).collect()}
    assert [halos[i] for i in (0, 97, 98, 99)] == [0, 0, 1, 2] and len(halos) == 100


def test_joins_have_tasks_for_their_rows(spark, sf_dir, monkeypatch):
    """Not as few as bytes ask for."""
    from tesserae.operators import primitives

    monkeypatch.setattr(primitives, "TOGETHER", 500)
    assert catalog.queries()["inner_join"](spark, sf_dir).rdd.getNumPartitions() == 16  # of 6000 + 1500 rows


def test_neighbourhoods_have_tasks_for_their_rows(spark, sf_dir, monkeypatch):
    from tesserae.operators import primitives

    monkeypatch.setattr(primitives, "TOGETHER", 500)
    assert catalog.queries()["moments_3d"](spark, sf_dir).rdd.getNumPartitions() == 34 * 6**3 // 500 + 1


def test_samples_of_a_hot_cell_go_apart(spark, tmp_path, monkeypatch):
    """4000 points in 27 cells."""
    from tesserae.operators import primitives, spatial

    monkeypatch.setattr(primitives, "TOGETHER", 2000)
    monkeypatch.setattr(spatial, "PLACE_ROWS", 50)
    supplier = spark.range(4000).select(F.col("id").alias("s_suppkey"), F.lit(1.0).alias("s_acctbal"))
    orders = spark.range(1500).select(F.col("id").alias("o_orderkey"))
    compare(spark, tmp_path, "spline_evaluate", supplier=supplier, orders=orders)
    sizes = catalog.queries()["spline_evaluate"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 10 and max(r["count"] for r in sizes) < 1500
