"""Queries that write small mesh and image files to the shared folder and read them back through the sources."""

from __future__ import annotations

import struct
import uuid

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators.primitives import checkpoint_folder
from tesserae.plans.field_queries import rounded
from tesserae.plans.registry import Registry
from tesserae.sources import images, mesh_text

R = Registry()
HEAD = "# vtk DataFile Version 3.0\nmesh\n"


def _file(spark, name: str, content: bytes | str) -> str:
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    mesh_text.put(spark, path, content.encode() if isinstance(content, str) else content)
    return path


def _cells(spark, path):
    return mesh_text.read_cells(spark, path).select("cell", "shape", "conn")


def _points(spark, path):
    return rounded(mesh_text.read_points(spark, path).select("id", "x", "y", "z", "field", "value"), 6)


GRID_4_3_2 = "SELECT range AS id, range % 4 AS i, range // 4 % 3 AS j, range // 12 AS k FROM range(24)"


@R.add("read_structured_grid", f"SELECT id, i + 0.5 * j AS x, CAST(j AS DOUBLE) AS y, 2.0 * k AS z, 'f' AS field, id * 1.5 AS value FROM ({GRID_4_3_2})")
def read_structured_grid(spark, d):
    at = [(n % 4 + 0.5 * (n // 4 % 3), n // 4 % 3, 2.0 * (n // 12)) for n in range(24)]
    text = HEAD + "ASCII\nDATASET STRUCTURED_GRID\nDIMENSIONS 4 3 2\nPOINTS 24 double\n" + "\n".join(f"{x} {y} {z}" for x, y, z in at) + "\nPOINT_DATA 24\nSCALARS f double 1\nLOOKUP_TABLE default\n" + " ".join(str(n * 1.5) for n in range(24))
    return _points(spark, _file(spark, "structured", text))


@R.add("read_rectilinear_grid", "SELECT range AS cell, CAST(12 AS INTEGER) AS shape, [a, a + 1, a + 5, a + 4, a + 12, a + 13, a + 17, a + 16] AS conn FROM (SELECT range, range % 3 + range // 3 * 4 AS a FROM range(6))")
def read_rectilinear_grid(spark, d):
    """The cells of a binary file."""
    axis = lambda c, values: f"{c}_COORDINATES {len(values)} float\n".encode() + struct.pack(f">{len(values)}f", *values) + b"\n"
    content = (HEAD + "BINARY\nDATASET RECTILINEAR_GRID\nDIMENSIONS 4 3 2\n").encode() + axis("X", [0, 1, 3, 7]) + axis("Y", [0, 2, 5]) + axis("Z", [1, 10])
    return _cells(spark, _file(spark, "rectilinear", content))


@R.add("read_polygons", "SELECT * FROM (VALUES (0::BIGINT, 5::INTEGER, [0, 1, 4]::BIGINT[]), (1, 9, [1, 2, 3, 4]), (2, 7, [0, 1, 2, 3, 4])) t(cell, shape, conn)")
def read_polygons(spark, d):
    content = HEAD.encode() + b"BINARY\nDATASET POLYDATA\nPOINTS 5 float\n" + struct.pack(">15f", *range(15)) + b"\nPOLYGONS 3 15\n" + struct.pack(">15i", 3, 0, 1, 4, 4, 1, 2, 3, 4, 5, 0, 1, 2, 3, 4) + b"\n"
    return _cells(spark, _file(spark, "polygons", content))


@R.add("read_unstructured_binary", "SELECT * FROM (VALUES (0, 0.0, 1.0, 2.0, 'v_x', 1.0), (1, 3.0, 4.0, 5.0, 'v_x', 4.0), (0, 0.0, 1.0, 2.0, 'v_y', 2.0), (1, 3.0, 4.0, 5.0, 'v_y', 5.0), (0, 0.0, 1.0, 2.0, 'v_z', 3.0), (1, 3.0, 4.0, 5.0, 'v_z', 6.0)) t(id, x, y, z, field, value)")
def read_unstructured_binary(spark, d):
    content = HEAD.encode() + b"BINARY\nDATASET UNSTRUCTURED_GRID\nPOINTS 2 double\n" + struct.pack(">6d", *range(6)) + b"\nCELLS 1 3\n" + struct.pack(">3i", 2, 0, 1) + b"\nCELL_TYPES 1\n" + struct.pack(">i", 3) + b"\nPOINT_DATA 2\nVECTORS v float\n" + struct.pack(">6f", 1, 2, 3, 4, 5, 6) + b"\n"
    return _points(spark, _file(spark, "unstructured", content))


@R.add("read_blocks", "SELECT 'a' AS field, CAST(4 AS BIGINT) AS n, 10.0 AS total UNION ALL SELECT 'b', 8, 36.0")
def read_blocks(spark, d):
    """A list of two blocks of structured points."""
    block = lambda name, nz: _file(spark, "block", HEAD + f"ASCII\nDATASET STRUCTURED_POINTS\nDIMENSIONS 2 2 {nz}\nORIGIN 0 0 0\nSPACING 1 1 1\nPOINT_DATA {4 * nz}\nSCALARS {name} float\nLOOKUP_TABLE default\n" + " ".join(str(k + 1) for k in range(4 * nz)))
    listed = _file(spark, "blocks", "!NBLOCKS 2\n" + "\n".join(p.rpartition("/")[2] for p in (block("a", 1), block("b", 2))))
    rows = mesh_text.read_points(spark, mesh_text.block_files(spark, listed))
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


_PIXELS = "SELECT range % 5 AS i, range // 5 AS j, round((range % 5 * 60) / 255.0, 6) AS r, round((range // 5 * 80) / 255.0, 6) AS g, round((range * 7 % 256) / 255.0, 6) AS b FROM range(20)"


def _image():
    n = np.arange(20)
    return np.stack([n % 5 * 60, n // 5 * 80, n * 7 % 256], axis=1).astype(np.uint8).reshape(4, 5, 3)[::-1]


def _read_image(spark, name: str, content: bytes):
    out = rounded(images.read_pnm(spark, _file(spark, name, content)).select("i", "j", "r", "g", "b"), 6)
    return out.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "r", "g", "b")


@R.add("read_png", _PIXELS)
def read_png(spark, d):
    return _read_image(spark, "png", images.png_bytes(_image()))


@R.add("read_pnm", _PIXELS)
def read_pnm(spark, d):
    return _read_image(spark, "pnm", b"P6\n5 4\n255\n" + _image().tobytes())


@R.add("numpy_exchange", "SELECT range AS id, range * 0.5 AS a FROM range(50)")
def numpy_exchange(spark, d):
    arrays = images.to_numpy(spark.range(50).select("id", (F.col("id") * 0.5).alias("a")), "id", ["a"])
    return images.from_numpy(spark, arrays)
