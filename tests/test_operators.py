"""Golden values and round trips that the catalogue's tables can't show."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.operators import density, extraction, flow, graph, mesh, primitives, quality, statistics
from tesserae.sources import fields, images, mesh_text


def test_statistics_of_a_range(spark):
    r = statistics.statistics(spark.range(1000), "id").first()
    assert r.n == 1000 and r.minimum == 0 and r.maximum == 999 and r.total == 499500
    assert math.isclose(r.sample_variance, 83416.6667, rel_tol=1e-8) and math.isclose(r.population_variance, 83333.25, rel_tol=1e-9)
    assert abs(r.skewness) < 1e-9 and math.isclose(r.kurtosis, 1.8, rel_tol=1e-4)


def test_degenerate_statistics(spark):
    one = statistics.statistics(spark.createDataFrame([(5.0,)], "v double"), "v").first()
    assert (one.n, one.mean, one.sample_variance, one.skewness, one.kurtosis) == (1, 5.0, 0, 0, 0)
    none = statistics.statistics(spark.createDataFrame([], "v double"), "v").first()
    assert none.n == 0 and none.total == 0 and none.kurtosis == 0


def test_runs_keep_repeated_keys_apart(spark):
    keys, values = [0, 0, 0, 1, 1, 4, 0, 2, 2, 2, 2, -1], [13, -2, -1, 1, 1, 0, 3, 1, 2, 3, 4, -42]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(zip(keys, values))], "i long, k long, v long").repartition(4)
    got = primitives.reduce_by_run(df, "k", "v", "i").orderBy("run").collect()
    assert [(r.k, r.total) for r in got] == [(0, 10), (1, 2), (4, 0), (0, 3), (2, 10), (-1, -42)]


@pytest.mark.parametrize("ranges", [1, 2, 97, 300])
def test_many_ranges(spark, monkeypatch, ranges):
    """Runs, scans and searches don't depend on the number of ranges, nor on ties or null keys at their ends."""
    monkeypatch.setattr(primitives, "n_ranges", lambda df: ranges)
    rng = np.random.default_rng(ranges)
    keys = [None if k == 3 else int(k) for k in rng.integers(0, 4, 500)]
    df = spark.createDataFrame([(i, k, 1) for i, k in enumerate(keys)], "i long, k long, v long").repartition(3)
    got = [r.run for r in primitives.runs(df, "k", "i").orderBy("i").collect()]
    want = np.cumsum([0] + [int(a != b) for a, b in zip(keys, keys[1:])]).tolist()
    assert got == want
    assert [r.scan for r in primitives.scan(df, F.col("v"), "i").orderBy("i").collect()] == list(range(1, 501))
    by_key = {r.i: r.scan for r in primitives.scan_by_key(df, F.col("v"), "k", "i").collect()}
    assert all(by_key[i] == sum(x == keys[i] for x in keys[: i + 1]) for i in range(500))
    big = spark.createDataFrame([(2**53 + k,) for k in range(5)], "x long")
    found = primitives.bounds_search(big, "x", big.withColumnRenamed("x", "q"), "q")
    assert sorted((r.q - 2**53, r.position) for r in found.collect()) == [(k, k) for k in range(5)]


def test_hot_key_is_cut(spark, monkeypatch):
    monkeypatch.setattr(primitives, "n_ranges", lambda df: 8)
    df = spark.range(300_000).select("id", F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("k"))
    out = primitives.scan_by_key(df, F.lit(1), "k", "id", exclusive=True, initial=10)
    assert out.where("k = -1").where("scan != 10 + id - floor((id + 2) / 3)").isEmpty() and out.where("k >= 0 AND scan != 10").isEmpty() and out.count() == 300_000


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_scans(spark, n):
    df = spark.range(n).repartition(5)
    assert [r.scan for r in primitives.scan(df, F.lit(3), "id").orderBy("id").collect()] == [3 * (i + 1) for i in range(n)]
    assert [r.scan for r in primitives.scan(df, F.lit(3), "id", exclusive=True, initial=5).orderBy("id").collect()] == [5 + 3 * i for i in range(n)]
    extended = primitives.scan_extended(df, F.lit(3), "id").orderBy("index").collect()
    assert [(r["index"], r.scan) for r in extended] == [(i, 3 * i) for i in range(n + 1)]


def test_histogram_of_a_constant_and_of_nulls(spark):
    df = spark.createDataFrame([(2.0,), (2.0,), (None,), (float("nan"),)], "v double")
    assert [r.freq for r in density.histogram(df, "v", 3).orderBy("bin").collect()] == [2, 0, 0]


def test_entropy_of_the_tangle(spark):
    assert math.isclose(statistics.entropy(fields.tangle(spark, (16, 16, 16)), "tangle", 50).first().entropy, 4.6, abs_tol=0.25)


def test_cell_average_of_a_grid(spark):
    points = fields.uniform_grid(spark, (3, 2)).withColumn("v", 10.1 + 10 * F.col("id"))
    corners = points.select("v", F.explode(F.array("i", F.col("i") - 1)).alias("cell")).where("cell BETWEEN 0 AND 1")
    assert [round(r.v, 6) for r in extraction.cell_average(corners, "cell", "v").orderBy("cell").collect()] == [30.1, 40.1]


def test_graph_path(spark):
    edges = spark.createDataFrame([(0, 2), (1, 4), (2, 0), (2, 3), (3, 2), (3, 4), (4, 1), (4, 3)], "a long, b long")
    nodes = spark.range(6).select(F.col("id").alias("node"))
    got = {r.node: r.component for r in graph.graph_connectivity(nodes, edges).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_unit_shapes(spark):
    cube = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cube)], "id long, x double, y double, z double")
    cells = spark.createDataFrame([(0, "hexahedron", list(range(8))), (1, "quad", [0, 1, 2, 3]), (2, "triangle", [0, 1, 2]), (3, "tetra", [0, 1, 2, 4]), (4, "line", [0, 6])], "cell long, shape string, conn array<long>")
    rows = mesh.corners(cells, points).select("cell", mesh.measure(F.col("shape"), F.col("p")).alias("m")).collect()
    assert {r.cell: round(r.m, 9) for r in rows} == {0: 1.0, 1: 1.0, 2: 0.5, 3: round(1 / 6, 9), 4: round(math.sqrt(3), 9)}
    ideal = {"area": 1, "aspect_ratio": 1, "condition": 1, "jacobian": 1, "scaled_jacobian": 1, "shape": 1, "shear": 1, "skew": 0, "taper": 0, "stretch": 1, "warpage": 1, "oddy": 0, "max_angle": 90, "min_angle": 90, "diagonal_ratio": 1}
    for metric, want in ideal.items():
        assert math.isclose(quality.quality(cells.where("cell = 1"), points, metric).first().quality, want, abs_tol=1e-9), metric
    assert quality.quality(cells.where("cell = 4"), points, "oddy").first().quality == -1
    for metric, want in {"volume": 1, "diagonal_ratio": 1, "stretch": 1, "skew": 0, "max_diagonal": math.sqrt(3), "jacobian": 1, "scaled_jacobian": 1, "shear": 1, "shape": 1, "condition": 1, "oddy": 0, "taper": 0, "aspect_ratio": 1, "dimension": 1 / math.sqrt(3)}.items():
        assert math.isclose(quality.quality(cells.where("cell = 0"), points, metric).first().quality, want, abs_tol=1e-9), metric
    regular = spark.createDataFrame([(0, 1.0, 1.0, 1.0), (1, 1.0, -1.0, -1.0), (2, -1.0, 1.0, -1.0), (3, -1.0, -1.0, 1.0)], "id long, x double, y double, z double")
    one = spark.createDataFrame([(0, "tetra", [0, 2, 1, 3])], "cell long, shape string, conn array<long>")
    for metric, want in {"scaled_jacobian": 1, "condition": 1, "shape": 1, "aspect_ratio": 1, "aspect_gamma": 1, "volume": 8 / 3, "jacobian": 16}.items():
        assert math.isclose(abs(quality.quality(one, regular, metric).first().quality), want, rel_tol=1e-5), metric
    assert mesh.external_faces(cells.where("cell = 0")).count() == 6 and mesh.tetrahedralize(cells.where("cell = 0")).count() == 5


def test_bad_cells_have_infinite_metrics(spark):
    """Inside-out and flat cells."""
    cube = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(cube)], "id long, x double, y double, z double")
    turned = [4, 5, 6, 7, 0, 1, 2, 3]
    rows = [(0, "hexahedron", turned), (1, "hexahedron", [0, 1, 2, 3, 0, 1, 2, 3]), (2, "tetra", [0, 2, 1, 4]), (3, "quad", [0, 1, 1, 0]), (4, "quad", [0, 0, 0, 0]), (5, "hexahedron", [0] * 8), (6, "triangle", [0, 1, 1])]
    cells = spark.createDataFrame(rows, "cell long, shape string, conn array<long>")
    got = {m: {r.cell: r.quality for r in quality.quality(cells, points, m).collect()} for m in ("condition", "oddy", "taper", "stretch", "shape", "jacobian", "diagonal_ratio", "aspect_ratio", "skew", "max_angle")}
    inf = math.inf
    assert got["condition"][0] == got["condition"][1] == got["condition"][2] == got["condition"][6] == inf
    assert got["oddy"][0] == got["oddy"][1] == got["oddy"][3] == inf and got["taper"][1] == got["taper"][3] == inf
    assert got["stretch"][4] == got["stretch"][5] == inf and got["diagonal_ratio"][4] == got["diagonal_ratio"][5] == inf
    assert got["shape"][0] == got["shape"][1] == got["shape"][2] == 0 and got["jacobian"][0] == -1 and got["jacobian"][2] == -1
    assert got["aspect_ratio"][1] == got["aspect_ratio"][3] == got["skew"][1] == inf and got["skew"][3] == 0 and got["max_angle"][4] == 0


def test_tetrahedra_fill_bricks_and_share_faces(spark):
    from tesserae.plans import mesh_queries

    bricks = mesh_queries.bricks(spark).withColumn("parity", (F.col("cell") % 4 + F.floor(F.col("cell") / 4) % 4 + F.floor(F.col("cell") / 16)) % 2)
    tetras = mesh.tetrahedralize(bricks).select(F.monotonically_increasing_id().alias("cell"), F.lit("tetra").alias("shape"), F.array("a", "b", "c", "d").alias("conn")).cache()
    points = mesh_queries.brick_points(spark)
    volumes = [r.quality for r in quality.quality(tetras, points, "volume").collect()]
    assert len(volumes) == 320 and min(volumes) > 0
    assert mesh.external_faces(tetras).count() == 2 * 6 * 16  # nothing but the outer squares' halves is left open
    for shape, conn, want in (("wedge", [0, 1, 3, 4, 5, 7], 0.5), ("pyramid", [0, 1, 2, 3, 4], 1 / 3)):
        cube = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(mesh.CUBE)], "id long, x double, y double, z double")
        assert math.isclose(quality.quality(spark.createDataFrame([(0, shape, conn)], "cell long, shape string, conn array<long>"), cube, "volume").first().quality, want)


def test_rotation_stays_on_its_circle(spark):
    grid = fields.uniform_grid(spark, (21, 21)).select("id", (10 - F.col("y")).alias("u"), (F.col("x") - 10).alias("v"), F.lit(0.0).alias("w"))
    field = [flow.field_array(grid, ["u", "v", "w"], (21, 21, 1))]
    seeds = spark.createDataFrame([(0, 14.0, 10.0, 0.0), (1, 19.5, 19.5, 0.0)], "id long, x double, y double, z double")
    got = {r.id: r for r in flow.particles(seeds, field, 2 * math.pi / 200, 200).collect()}
    assert got[0].steps == 200 and abs(got[0].x - 14) < 1e-3 and abs(got[0].y - 10) < 1e-3
    assert got[1].steps < 200
    paths = flow.streamlines(seeds.where("id = 0"), field, 2 * math.pi / 200, 50).collect()
    assert len(paths) == 51 and all(abs(math.hypot(r.x - 10, r.y - 10) - 4) < 1e-3 for r in paths)


def test_mesh_file_round_trip(spark, tmp_path):
    points = fields.uniform_grid(spark, (3, 3)).select("id", "x", "y", "z", (F.col("id") * 1.5).alias("f"))
    cells = spark.createDataFrame([(0, 9, [0, 1, 4, 3]), (1, 5, [1, 2, 5])], "cell long, shape int, conn array<long>")
    path = str(tmp_path / "mesh.vtk")
    mesh_text.write_unstructured(points, cells, path, ["f"])
    back = mesh_text.read_points(spark, path)
    assert sorted((r.id, r.x, r.y, r.z, r.field, r.value) for r in back.collect()) == sorted((r.id, r.x, r.y, r.z, "f", r.f) for r in points.collect())
    assert sorted((r.cell, r.shape, r.conn) for r in mesh_text.read_cells(spark, path).collect()) == [(0, 9, [0, 1, 4, 3]), (1, 5, [1, 2, 5])]


def test_structured_points_file(spark, tmp_path):
    (tmp_path / "g.vtk").write_text("# vtk DataFile Version 3.0\nt\nASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS 2 2 1\nORIGIN 1 2 3\nSPACING 0.5 1 1\nPOINT_DATA 4\nSCALARS a float\nLOOKUP_TABLE default\n1 2 3 4\nVECTORS v float\n1 0 0 0 1 0 0 0 1 1 1 1\n")
    rows = mesh_text.read_points(spark, str(tmp_path / "g.vtk")).collect()
    assert {(r.id, r.x, r.value) for r in rows if r.field == "a"} == {(0, 1.0, 1.0), (1, 1.5, 2.0), (2, 1.0, 3.0), (3, 1.5, 4.0)}
    assert {r.field for r in rows} == {"a", "v_x", "v_y", "v_z"}


def test_images_and_bricks(spark, tmp_path):
    pixels = fields.uniform_grid(spark, (4, 3)).select("i", "j", (F.col("i") / 5).alias("r"), (F.col("j") / 5).alias("g"), F.lit(1.0).alias("b"))
    path = str(tmp_path / "p.ppm")
    images.write_pnm(pixels, path)
    back = {(r.i, r.j): (round(r.r, 6), round(r.g, 6), r.b) for r in images.read_pnm(spark, path).collect()}
    assert back == {(r.i, r.j): (round(r.r, 6), round(r.g, 6), r.b) for r in pixels.collect()}
    np.arange(24, dtype=">f4").tofile(tmp_path / "b.raw")
    (tmp_path / "b.bov").write_text("DATA FILE: b.raw\nDATA SIZE: 4 3 2\nDATA FORMAT: FLOAT\nDATA ENDIAN: BIG\n")
    rows = images.read_brick(spark, str(tmp_path / "b.bov")).collect()
    assert sorted((r.id, r.value) for r in rows) == [(i, float(i)) for i in range(24)] and max(r.k for r in rows) == 1


def brute_components(nodes, edges):
    """node: number of its component, in the order of least nodes."""
    near = {n: [] for n in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    found, n = {}, 0
    for node in sorted(nodes):
        if node not in found:
            stack = [node]
            found[node] = n
            while stack:
                for x in near[stack.pop()]:
                    if x not in found:
                        found[x] = n
                        stack.append(x)
            n += 1
    return found


def test_connectivity_over_whole_tables(spark, sf_dir):
    from tesserae.plans import catalog

    items = [tuple(map(int, r)) for r in spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey").collect()]
    edges = [(int(c), -int(n) - 1) for c, n in spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey").collect()]
    got = catalog.queries()["graph_connectivity"](spark, sf_dir).collect()
    assert {int(r.node): r.component for r in got} == brute_components({x for e in edges for x in e}, edges)
    first = {}
    links = [(first.setdefault((p, s), o), o) for o, p, s in items]
    got = catalog.queries()["cell_connectivity"](spark, sf_dir).collect()
    assert len(got) > 400 and {int(r.cell): r.component for r in got} == brute_components({o for o, _, _ in items}, links)
