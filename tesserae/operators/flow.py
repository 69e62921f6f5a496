"""Advection of particles through a velocity field on a uniform grid: seeds are distributed, the field is a bounded side input."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.operators.mesh import triangle_area

#: Bytes of a field that may be sent to every executor.
FIELD_BYTES = 256 << 20

Sampler = Callable[[np.ndarray, float], tuple[np.ndarray, np.ndarray]]


def field_array(grid: DataFrame, components: Sequence[str], dims: Sequence[int]) -> np.ndarray:
    """(nz, ny, nx, c) values of a point field; larger fields are cut into blocks by the caller."""
    size = int(np.prod(dims)) * len(components) * 8
    if size > FIELD_BYTES:
        raise ValueError(f"the field has {size} bytes; split it into blocks of {FIELD_BYTES} at most")
    rows = grid.select("id", *(F.col(c).cast("double") for c in components)).toPandas().sort_values("id")
    nx, ny, nz = (*dims, 1)[:3]
    return rows[list(components)].to_numpy().reshape(nz, ny, nx, len(components))


def interpolate(field: np.ndarray, p: np.ndarray, origin: np.ndarray, spacing: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trilinear values at positions, and which positions lie in the grid."""
    n = np.array(field.shape[2::-1])
    u = (p - origin) / spacing
    inside = ((u >= 0) & (u <= n - 1)).all(axis=1)
    base = np.clip(np.floor(u).astype(int), 0, np.maximum(n - 2, 0))
    t = np.where(n > 1, u - base, 0.0)
    out = np.zeros((len(p), field.shape[3]))
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                k = np.minimum(base + (a, b, c), n - 1)
                w = np.prod(np.where((a, b, c), t, 1 - t), axis=1)
                out += w[:, None] * field[k[:, 2], k[:, 1], k[:, 0]]
    return out, inside


def advect(p: np.ndarray, velocity: Sampler, h: float, n: int, method: str = "rk4") -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Final positions, steps taken, and positions after each step. A particle stops where a step would leave the field."""
    p, alive, steps, path = p.copy(), np.ones(len(p), bool), np.zeros(len(p), np.int64), [p.copy()]
    for s in range(n):
        t = s * h
        k1, ok = velocity(p, t)
        if method == "euler":
            new = p + h * k1
        else:
            k2, ok2 = velocity(p + h / 2 * k1, t + h / 2)
            k3, ok3 = velocity(p + h / 2 * k2, t + h / 2)
            k4, ok4 = velocity(p + h * k3, t + h)
            new, ok = p + h / 6 * (k1 + 2 * k2 + 2 * k3 + k4), ok & ok2 & ok3 & ok4
        alive &= ok
        p = np.where(alive[:, None], new, p)
        steps += alive
        path.append(p.copy())
        if not alive.any():
            break
    return p, steps, path


def _sampler(fields: list[np.ndarray], origin: Sequence[float], spacing: Sequence[float], times: tuple[float, float]) -> Sampler:
    o, s = np.array(origin, float), np.array(spacing, float)

    def sample(p: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
        v, ok = interpolate(fields[0], p, o, s)
        if len(fields) > 1:
            w = (t - times[0]) / (times[1] - times[0])
            v = (1 - w) * v + w * interpolate(fields[1], p, o, s)[0]
        return v, ok

    return sample


def particles(seeds: DataFrame, fields: list[np.ndarray], h: float, n: int, origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0), method: str = "rk4", times=(0.0, 1.0)) -> DataFrame:
    """id, x, y, z, steps at the end. One field is steady; two are interpolated between times."""
    shared = seeds.sparkSession.sparkContext.broadcast(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = _sampler(shared.value, origin, spacing, times)
        for b in batches:
            p, steps, _ = advect(b[["x", "y", "z"]].to_numpy(float), sample, h, n, method)
            yield pd.DataFrame({"id": b["id"], "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "steps": steps})

    return seeds.select("id", "x", "y", "z").mapInPandas(run, "id long, x double, y double, z double, steps long")


def streamlines(seeds: DataFrame, fields: list[np.ndarray], h: float, n: int, origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0), method: str = "rk4", times=(0.0, 1.0)) -> DataFrame:
    """id, step, x, y, z: the seed and a row for each step taken."""
    shared = seeds.sparkSession.sparkContext.broadcast(fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = _sampler(shared.value, origin, spacing, times)
        for b in batches:
            _, steps, path = advect(b[["x", "y", "z"]].to_numpy(float), sample, h, n, method)
            for k, p in enumerate(path):
                own = steps >= k
                yield pd.DataFrame({"id": b["id"][own], "step": k, "x": p[own, 0], "y": p[own, 1], "z": p[own, 2]})

    return seeds.select("id", "x", "y", "z").mapInPandas(run, "id long, step int, x double, y double, z double")


def stream_surface(seeds: DataFrame, fields: list[np.ndarray], h: float, n: int, **options) -> DataFrame:
    """strip, step, half, a, b, c, area: triangles between the streamlines of neighbouring seeds (ids one apart)."""
    lines = streamlines(seeds, fields, h, n, **options).select("id", "step", F.struct("x", "y", "z").alias("p"))
    here = lines.select(F.col("id").alias("strip"), "step", F.col("p").alias("p0"))
    ahead = lines.select(F.col("id").alias("strip"), (F.col("step") - 1).alias("step"), F.col("p").alias("p1"))
    rows = here.join(ahead, ["strip", "step"])
    other = rows.select((F.col("strip") - 1).alias("strip"), "step", F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("p0").alias("a"), F.col("q0").alias("b"), F.col("q1").alias("c")), F.struct(F.lit(1).alias("half"), F.col("p0").alias("a"), F.col("q1").alias("b"), F.col("p1").alias("c")))
    out = rows.join(other, ["strip", "step"]).select("strip", "step", F.inline(halves))
    corner = lambda c: tuple(F.col(f"{c}.{x}") for x in "xyz")
    return out.withColumn("area", triangle_area(corner("a"), corner("b"), corner("c")))


def push_charged(p: np.ndarray, momentum: np.ndarray, electric: np.ndarray, magnetic: np.ndarray, charge: float, mass: float, h: float, light: float = 299_792_458.0) -> tuple[np.ndarray, np.ndarray]:
    """New positions and momenta of charged particles after a step in given fields: half an electric kick, a magnetic turn, half a kick (Boris)."""
    kick = charge * h / 2 * electric
    low = momentum + kick
    gamma = np.sqrt(1 + (low * low).sum(axis=1) / (mass * light) ** 2)[:, None]
    t = charge * h / 2 * magnetic / (gamma * mass)
    turned = low + np.cross(low, t)
    low = low + np.cross(turned, 2 * t / (1 + (t * t).sum(axis=1))[:, None])
    new = low + kick
    gamma = np.sqrt(1 + (new * new).sum(axis=1) / (mass * light) ** 2)[:, None]
    return p + h * new / (gamma * mass), new


def charged_particles(seeds: DataFrame, electric: list[np.ndarray], magnetic: list[np.ndarray], charge: float, mass: float, h: float, n: int, origin=(0.0, 0.0, 0.0), spacing=(1.0, 1.0, 1.0)) -> DataFrame:
    """id, step, x, y, z of charged particles (id, x, y, z and momenta px, py, pz) in an electric and a magnetic field on one grid."""
    shared = seeds.sparkSession.sparkContext.broadcast((electric, magnetic))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = _sampler(shared.value[0], origin, spacing, (0.0, 1.0))
        b = _sampler(shared.value[1], origin, spacing, (0.0, 1.0))
        for rows in batches:
            p, m, alive = rows[["x", "y", "z"]].to_numpy(float), rows[["px", "py", "pz"]].to_numpy(float), np.ones(len(rows), bool)
            for k in range(n + 1):
                yield pd.DataFrame({"id": rows["id"][alive], "step": k, "x": p[alive, 0], "y": p[alive, 1], "z": p[alive, 2]})
                (ev, ok), (bv, _) = e(p, k * h), b(p, k * h)
                alive = alive & ok
                moved, pushed = push_charged(p, m, ev, bv, charge, mass, h)
                p, m = np.where(alive[:, None], moved, p), np.where(alive[:, None], pushed, m)

    return seeds.select("id", "x", "y", "z", "px", "py", "pz").mapInPandas(run, "id long, step int, x double, y double, z double")
