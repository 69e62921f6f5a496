"""Portable pixmaps (PGM, PPM) and bricks of values: read in parallel by file, written one file at a time."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "file string, i int, j int, r double, g double, b double"
BRICK = "file string, id long, i int, j int, k int, value double"
KINDS = {"FLOAT": "f4", "DOUBLE": "f8", "INT": "i4", "SHORT": "i2", "BYTE": "u1"}


def parse_pnm(content: bytes) -> np.ndarray:
    """(height, width, 3) values in [0, 1]; the bottom row comes first."""
    words, at = [], 0
    while len(words) < 4:
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while not content[end : end + 1].isspace():
            end += 1
        words.append(content[at:end])
        at = end
    kind, width, height, peak = words[0].decode(), *map(int, words[1:])
    channels = 3 if kind in ("P3", "P6") else 1
    if kind in ("P5", "P6"):
        data = np.frombuffer(content, ">u2" if peak > 255 else "u1", width * height * channels, at + 1)
    elif kind in ("P2", "P3"):
        data = np.array(content[at:].split()[: width * height * channels], float)
    else:
        raise ValueError(f"{kind} is no pixmap read here")
    pixels = data.reshape(height, width, channels)[::-1] / peak
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels


def parse_png(content: bytes) -> np.ndarray:
    """(height, width, 3) values in [0, 1] of an 8 or 16 bit image without interlacing; the bottom row comes first."""
    at, data, head = 8, b"", None
    while at < len(content):
        size, name = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        body = content[at + 8 : at + 8 + size]
        head = body if name == b"IHDR" else head
        data += body if name == b"IDAT" else b""
        at += 12 + size
    width, height, depth, colour = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big"), head[8], head[9]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    step = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + width * step)
    out, above = np.zeros((height, width * step), np.uint8), np.zeros(width * step, np.uint8)
    for y, line in enumerate(lines):
        kind, raw = line[0], line[1:]
        if kind == 0:
            row = raw
        elif kind == 2:
            row = raw + above
        elif kind == 1:
            row = np.cumsum(raw.reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        else:
            row = np.zeros_like(raw)
            for x in range(len(raw)):
                a, b, c = int(row[x - step]) if x >= step else 0, int(above[x]), int(above[x - step]) if x >= step else 0
                guess = (a + b) // 2 if kind == 3 else min((a, b, c), key=lambda v: abs(a + b - c - v))
                row[x] = (int(raw[x]) + guess) % 256
        out[y] = above = row
    pixels = out.reshape(height, width, step).view(">u2" if depth == 16 else np.uint8).reshape(height, width, channels)[::-1] / (65535 if depth == 16 else 255)
    return np.repeat(pixels[:, :, :1], 3, axis=2) if channels < 3 else pixels[:, :, :3]


def png_bytes(pixels: np.ndarray) -> bytes:
    """An 8 bit RGB image from (height, width, 3) bytes, the top row first."""
    height, width, _ = pixels.shape
    chunk = lambda name, body: len(body).to_bytes(4, "big") + name + body + zlib.crc32(name + body).to_bytes(4, "big")
    lines = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, width * 3)], axis=1).tobytes()
    head = width.to_bytes(4, "big") + height.to_bytes(4, "big") + bytes([8, 2, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def parse_image(content: bytes) -> np.ndarray:
    return parse_png(content) if content.startswith(b"\x89PNG") else parse_pnm(content)


def _pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            p = parse_image(content)
            j, i = np.divmod(np.arange(p.shape[0] * p.shape[1]), p.shape[1])
            flat = p.reshape(-1, 3)
            yield pd.DataFrame({"file": path, "i": i, "j": j, "r": flat[:, 0], "g": flat[:, 1], "b": flat[:, 2]})


def read_pnm(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_pixels, PIXELS)


#: Pixels of an image that is written whole.
IMAGE_PIXELS = 1 << 26


def image_array(pixels: DataFrame) -> np.ndarray:
    """(height, width, 3) bytes of one image (i, j, r, g, b in [0, 1]), the top row first; at most IMAGE_PIXELS of them."""
    most = pixels.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    width, height = int(most.i) + 1, int(most.j) + 1
    if width * height > IMAGE_PIXELS:
        raise ValueError(f"an image of {width} x {height} pixels is more than {IMAGE_PIXELS}; write it in tiles")
    p = pixels.select("i", "j", "r", "g", "b").toPandas()
    out = np.zeros((height, width, 3), np.uint8)
    out[height - 1 - p.j.to_numpy(), p.i.to_numpy()] = np.clip(np.rint(p[["r", "g", "b"]].to_numpy() * 255), 0, 255)
    return out


def write_pnm(pixels: DataFrame, path: str) -> None:
    """One image as P6."""
    out = image_array(pixels)
    Path(path).write_bytes(b"P6\n%d %d\n255\n" % (out.shape[1], out.shape[0]) + out.tobytes())


def write_png(pixels: DataFrame, path: str) -> None:
    Path(path).write_bytes(png_bytes(image_array(pixels)))


def to_numpy(df: DataFrame, order: str, columns: list[str], most: int = 1 << 26) -> dict[str, np.ndarray]:
    """Columns as arrays in the order of one; of more than `most` rows, ValueError."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    table = df.select(order, *columns).orderBy(order).toArrow()
    return {c: table.column(c).to_numpy() for c in columns}


def from_numpy(spark: SparkSession, arrays: dict[str, np.ndarray]) -> DataFrame:
    """id and a column for each array, all of one length."""
    return spark.createDataFrame(pd.DataFrame({"id": np.arange(len(next(iter(arrays.values())))), **arrays}))


def read_brick(spark: SparkSession, header: str) -> DataFrame:
    """A brick of values: a text header (`KEY: value` lines) that names a raw file next to it."""
    keys = dict(line.split(":", 1) for line in Path(header).read_text().splitlines() if ":" in line and not line.startswith("#"))
    keys = {k.strip().upper(): v.strip() for k, v in keys.items()}
    nx, ny, nz = map(int, keys["DATA SIZE"].split())
    kind = np.dtype(KINDS[keys["DATA FORMAT"].upper()]).newbyteorder(">" if keys.get("DATA ENDIAN", "LITTLE").upper() == "BIG" else "<")
    skip = int(keys.get("BYTE OFFSET", 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                values = np.frombuffer(content, kind, nx * ny * nz, skip).astype(float)
                n = np.arange(len(values))
                yield pd.DataFrame({"file": path, "id": n, "i": n % nx, "j": n // nx % ny, "k": n // (nx * ny), "value": values})

    return spark.read.format("binaryFile").load(str(Path(header).parent / keys["DATA FILE"])).select("path", "content").mapInPandas(run, BRICK)
