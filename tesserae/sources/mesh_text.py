"""Legacy mesh files, ASCII and binary: structured points and grids, rectilinear grids, polygons and unstructured grids; lists of blocks.

Files are read in parallel, a file being the unit of work, and written whole.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS = "file string, id long, x double, y double, z double, field string, value double"
CELLS = "file string, cell long, shape int, conn array<long>"
#: Types of binary values, big-endian.
KINDS = {
    "float": ">f4", "double": ">f8", "int": ">i4", "long": ">i8", "short": ">i2", "char": ">i1", "unsigned_char": ">u1", "unsigned_short": ">u2", "unsigned_int": ">u4", "unsigned_long": ">u8",
    "vtktypeint64": ">i8", "vtkidtype": ">i8",
}


class Cursor:
    """Words and arrays of a file, one after the other."""

    def __init__(self, content: bytes) -> None:
        self.content, self.at = content, content.index(b"\n", content.index(b"\n") + 1) + 1
        self.binary = (self.word() or "").upper() == "BINARY"

    def word(self) -> str | None:
        b, at = self.content, self.at
        while at < len(b) and b[at] <= 32:
            at += 1
        end = at
        while end < len(b) and b[end] > 32:
            end += 1
        self.at = end
        return b[at:end].decode("utf-8", "replace") if end > at else None

    def array(self, count: int, kind: str) -> np.ndarray:
        if not self.binary:
            return np.array([self.word() for _ in range(count)], float)
        at = self.content.index(b"\n", self.at) + 1
        found = np.frombuffer(self.content, KINDS[kind.lower()], count, at)
        self.at = at + found.nbytes
        return found.astype(float)


def structured_cells(dims: Sequence[int]) -> list[tuple[int, list[int]]]:
    """Hexahedra, quadrilaterals or lines of a grid of points."""
    nx, ny, _ = dims
    shape = {1: 3, 2: 9, 3: 12}.get(sum(n > 1 for n in dims), 1)
    steps = [s for s, n in zip((1, nx, nx * ny), dims) if n > 1]
    corners = {0: [0], 1: [0, *steps], 2: [0, steps[0], sum(steps), steps[-1]] if len(steps) == 2 else []}.get(len(steps), [])
    if len(steps) == 3:
        low = [0, steps[0], steps[0] + steps[1], steps[1]]
        corners = [*low, *(c + steps[2] for c in low)]
    k, j, i = np.meshgrid(*(np.arange(max(n - 1, 1)) for n in dims[::-1]), indexing="ij")
    first = (i + j * nx + k * nx * ny).ravel()
    return [(shape, (f + np.array(corners)).tolist()) for f in first.tolist()]


def parse(content: bytes) -> dict:
    """points (list of xyz), cells (shape, conn), point_fields and cell_fields by name."""
    t = Cursor(content)
    out: dict = {"points": [], "cells": [], "point_fields": {}, "cell_fields": {}}
    dims, origin, spacing = (1, 1, 1), (0.0, 0.0, 0.0), (1.0, 1.0, 1.0)
    conns: list[list[int]] = []
    where, n, axes, kind = "point_fields", 0, {}, ""

    def keep(name: str, values: np.ndarray, width: int, parts: str = "") -> None:
        rows = values.reshape(-1, width)
        for k in range(width):
            out[where][name if width == 1 else f"{name}_{parts[k] if parts else k}"] = rows[:, k].tolist()

    while (word := t.word()) is not None:
        w = word.upper()
        if w == "DATASET":
            kind = t.word().upper()
        elif w == "DIMENSIONS":
            dims = tuple(int(t.word()) for _ in range(3))
        elif w == "ORIGIN":
            origin = tuple(float(t.word()) for _ in range(3))
        elif w in ("SPACING", "ASPECT_RATIO"):
            spacing = tuple(float(t.word()) for _ in range(3))
        elif w in ("X_COORDINATES", "Y_COORDINATES", "Z_COORDINATES"):
            count = int(t.word())
            axes[w[0]] = t.array(count, t.word()).tolist()
        elif w == "POINTS":
            count = int(t.word())
            out["points"] = [tuple(p) for p in t.array(3 * count, t.word()).reshape(-1, 3).tolist()]
        elif w in ("CELLS", "POLYGONS", "LINES", "VERTICES", "TRIANGLE_STRIPS"):
            count, size = int(t.word()), int(t.word())
            mark = t.at
            if (t.word() or "").upper() == "OFFSETS":
                ends = t.array(count, t.word()).astype(int)
                t.word()
                flat = t.array(size, t.word()).astype(int)
                conns += [flat[a:b].tolist() for a, b in zip(ends, ends[1:])]
            else:
                t.at = mark
                flat, at = t.array(size, "int").astype(int), 0
                for _ in range(count):
                    conns.append(flat[at + 1 : at + 1 + flat[at]].tolist())
                    at += 1 + flat[at]
        elif w == "CELL_TYPES":
            out["cells"] = list(zip(t.array(int(t.word()), "int").astype(int).tolist(), conns))
        elif w in ("POINT_DATA", "CELL_DATA"):
            where, n = w.lower().replace("data", "fields"), int(t.word())
        elif w == "SCALARS":
            name, of, width = t.word(), t.word(), 1
            if (word := t.word()).upper() != "LOOKUP_TABLE":
                width = int(word)
                t.word()
            t.word()
            keep(name, t.array(n * width, of), width)
        elif w == "FIELD":
            t.word()
            for _ in range(int(t.word())):
                name, width, count, of = t.word(), int(t.word()), int(t.word()), t.word()
                keep(name, t.array(width * count, of), width)
        elif w in ("VECTORS", "NORMALS"):
            keep(t.word(), t.array(3 * n, t.word()), 3, "xyz")
    if kind == "STRUCTURED_POINTS":
        axes = {c: [o + s * k for k in range(m)] for c, o, s, m in zip("XYZ", origin, spacing, dims)}
    if axes:
        out["points"] = [(x, y, z) for z in axes["Z"] for y in axes["Y"] for x in axes["X"]]
    if kind in ("STRUCTURED_POINTS", "STRUCTURED_GRID", "RECTILINEAR_GRID"):
        out["cells"] = structured_cells(dims)
    elif conns and not out["cells"]:
        out["cells"] = [({1: 1, 2: 3, 3: 5, 4: 9}.get(len(c), 7), c) for c in conns]
    return out


def _points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            found = parse(content)
            for name, values in (found["point_fields"] or {None: [None] * len(found["points"])}).items():
                frame = pd.DataFrame(found["points"], columns=["x", "y", "z"])
                yield frame.assign(file=path, id=range(len(frame)), field=name, value=values)[["file", "id", "x", "y", "z", "field", "value"]]


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, content in zip(b["path"], b["content"]):
            cells = parse(content)["cells"]
            yield pd.DataFrame({"file": [path] * len(cells), "cell": range(len(cells)), "shape": [s for s, _ in cells], "conn": [c for _, c in cells]})


def read_points(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A row for each file, point and point field (field null if a file has none). Files are the unit of work."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_points, POINTS)


def read_cells(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_cells, CELLS)


def block_files(spark: SparkSession, path: str) -> list[str]:
    """The files that a list of blocks names, relative to it; lines that begin with ! or # are settings."""
    folder = path.rpartition("/")[0]
    lines = [r.value.strip() for r in spark.read.text(path).collect()]  # a line a block
    return [x if x.startswith("/") or ":" in x else f"{folder}/{x}" for x in lines if x and x[0] not in "!#"]


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a small file to any file system that the session knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    stream.write(bytearray(content))
    stream.close()


def write_unstructured(points: DataFrame, cells: DataFrame, path: str, fields: Sequence[str] = ()) -> None:
    """One legacy file, for meshes that a viewer can open: rows are streamed through the driver, partition by partition."""
    with Path(path).open("w") as out:
        n, m = points.count(), cells.count()
        out.write(f"# vtk DataFile Version 3.0\nmesh\nASCII\nDATASET UNSTRUCTURED_GRID\nPOINTS {n} double\n")
        for r in points.orderBy("id").select("x", "y", "z").toLocalIterator():
            out.write(f"{r.x!r} {r.y!r} {r.z!r}\n")
        size = cells.agg(F.coalesce(F.sum(F.size("conn") + 1), F.lit(0)).alias("s")).first().s
        out.write(f"CELLS {m} {size}\n")
        for r in cells.orderBy("cell").select("conn").toLocalIterator():
            out.write(" ".join(map(str, [len(r.conn), *r.conn])) + "\n")
        out.write(f"CELL_TYPES {m}\n")
        for r in cells.orderBy("cell").select("shape").toLocalIterator():
            out.write(f"{r.shape}\n")
        if fields:
            out.write(f"POINT_DATA {n}\n")
        for f in fields:
            out.write(f"SCALARS {f} double 1\nLOOKUP_TABLE default\n")
            for r in points.orderBy("id").select(f).toLocalIterator():
                out.write(f"{float(r[0])!r}\n")
