"""Near-duplicate embeddings by spherical k-means cells and blocked cosine products.

Equal vectors are collapsed first, with their number. Centres are fitted on a bounded sample
and every vector is put into its nearest cells (more of them with more cells), less those
whose members must all lie beyond the limit or come to it themselves. All that are in a cell
are compared, block by block, in matrix products, so that no cell has to fit one task; a pair
that meets in several cells is counted in the least of them. Blocks emit counts of links and
a spanning forest of them, never all pairs.

Links of a pair that shares no cell are missed: of pairs right at the limit 0.97 or more are
found (see n_probes), of closer ones more. `probes` of all cells (CELLS) is exact. The number of
cells grows with that of vectors up to CELLS, so work is in proportion to the vectors up to
CELLS times MEMBERS of them and grows faster beyond.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing;
vectors of different lengths don't link; any length will do. Rows under one vec_id are counted as
so many vectors, equal rows as copies. A null vec_id keeps a null component_id unless it links with rows that have
ids, and is never kept. Of a component the least vec_id stands for it; ties don't arise. An empty table gives an
empty result. Further columns are left out, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import map_arrow, stored
from tesserae.llm.components import connected_components
from tesserae.llm.gray_index import Forest

#: Vectors that centres are fitted on at most, and bytes of them.
SAMPLE, SAMPLE_BYTES = 65_536, 32 << 20
#: Cells at most, vectors whose nearest cell is one and the same (about), and vectors to a block.
CELLS, MEMBERS, BLOCK = 16_384, 2048, 8192
#: Cells that a vector is put into, with 64 cells or fewer; one more for each fourfold of that.
PROBES = 3
ROUNDS = 8
#: Rows of a matrix product at a time.
PART = 1024


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k unit centres at most, from unit vectors; the first ones are spread over the sample."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        nearest = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        norms = np.linalg.norm(sums, axis=1)
        used = norms > 1e-12
        centres = np.where(used[:, None], sums / np.where(used, norms, 1)[:, None], centres)
    return centres


def n_cells(n: int) -> int:
    """A power of two near n / MEMBERS, 8 at least."""
    return min(CELLS, max(8, 1 << round(math.log2(max(1, n / MEMBERS)))))


def n_probes(cells: int) -> int:
    """Of pairs right at the limit 0.9, found in 64 dimensions: 0.98 of the test tables' vectors, 0.97 of Gaussian ones."""
    return PROBES + max(0, math.ceil(math.log(cells / 64, 4)))


def unit_rows(vectors: pa.Array, width: int) -> np.ndarray:
    x = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _assign(centres: dict[int, np.ndarray], probes: int | None, limit: float):
    reach = math.sqrt(max(0.0, 2 - 2 * limit)) / 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            widths = b.column(2).to_numpy()
            for w in np.unique(widths):
                whole = b.filter(pa.array(widths == w))
                c = centres.get(int(w), np.zeros((1, w)))
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * (c @ c.T)))
                k = min(probes or n_probes(len(c)), len(c))
                for start in range(0, len(whole), PART):
                    own = whole.slice(start, PART)
                    scores = unit_rows(own.column(3), w) @ c.T
                    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(scores, top, 1), axis=1, kind="stable"), 1)
                    # A member of another cell lies beyond the plane between the centres. The distances of both from it are
                    # no more than their own at most, so one of them is within half the reach and comes to the other's cell.
                    gap = np.take_along_axis(scores, top[:, :1], 1) - np.take_along_axis(scores, top, 1)
                    near = gap <= reach * apart[top[:, :1], top] + 1e-9
                    near[:, 0] = True
                    offsets = np.concatenate([[0], np.cumsum(near.sum(axis=1))]).astype(np.int32)
                    cells = pa.ListArray.from_arrays(pa.array(offsets), pa.array(top[near].astype(np.int32)))
                    yield pa.record_batch([*own.columns[:3], cells, *own.columns[3:]], ["rep", "copies", "width", "cells", "vector", "k1", "k2", "first_id"])

    return run


#: b null: copies of linked vectors to add to rep a. Else a link.
COMPARED = "a long, b long, n long"


def _compare(limit: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        width, cell, first, second = (group.column(c)[0].as_py() for c in ("width", "cell", "first", "second"))

        def part(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            lists = t.column("cells").to_pylist()
            longest = max(map(len, lists))
            return t.column("rep").to_numpy(), t.column("copies").to_numpy(), unit_rows(t.column("vector").combine_chunks(), width), np.array([x + [-1] * (longest - len(x)) for x in lists])

        x = part(group.filter(pc.equal(group.column("block"), first)))
        if first == second:
            y, shift = x, 0
        else:
            other = group.filter(pc.equal(group.column("block"), second))
            if len(other) == len(group) or not len(other):
                return pa.table({c: pa.array([], pa.int64()) for c in "abn"})
            y, shift = part(other), len(x[0])
        reps = x[0] if first == second else np.concatenate([x[0], y[0]])
        links, forest = np.zeros(len(reps), np.int64), Forest(len(reps))
        for at in range(0, len(x[0]), PART):
            i, j = np.nonzero(x[2][at : at + PART] @ y[2].T >= limit)
            i += at
            if first == second:
                i, j = i[i < j], j[i < j]
            again = np.zeros(len(i), bool)  # met in a lesser cell too
            for xs in x[3].T:
                own = xs[i]
                lesser = (own >= 0) & (own < cell)
                if lesser.any():
                    for ys in y[3].T:
                        again |= lesser & (own == ys[j])
            i, j = i[~again], j[~again]
            links += np.bincount(i, y[1][j], len(reps)).astype(np.int64) + np.bincount(j + shift, x[1][i], len(reps)).astype(np.int64)
            forest.link(i, j + shift)
        child = np.flatnonzero(forest.parent != np.arange(len(reps)))
        linked = np.flatnonzero(links)
        b = pa.concat_arrays([pa.nulls(len(linked), pa.int64()), pa.array(reps[forest.parent[child]])])
        n = pa.concat_arrays([pa.array(links[linked]), pa.nulls(len(child), pa.int64())])
        return pa.table({"a": pa.array(np.concatenate([reps[linked], reps[child]])), "b": b, "n": n})

    return run


def fit_centres(rows: DataFrame, n: int, cells: int | None = None) -> dict[int, np.ndarray]:
    """Unit centres by length of vector. rows: v, k1, k2; n of them, of which a sample by hash is used, equal vectors once."""
    widest = rows.agg(F.max(F.size("v"))).first()[0]
    most = min(SAMPLE, max(64, SAMPLE_BYTES // (8 * max(1, widest or 1))))
    share = min(1.0, most / max(n, 1))
    own = rows.where(F.pmod("k2", F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    sample = own.groupBy("k1").agg(F.any_value("v").alias("v")).select("k1", F.size("v").alias("width"), "v").orderBy("k1").limit(most).toArrow().combine_chunks()
    centres, widths = {}, sample.column("width").to_numpy()
    for w in np.unique(widths):
        x = unit_rows(sample.filter(pa.array(widths == w)).column("v").combine_chunks(), int(w))
        k = cells or n_cells(round(n * len(x) / len(sample)))
        centres[int(w)] = spherical_kmeans(x, min(k, max(1, len(x) // 4)), ROUNDS if k <= 1024 else 2)
    return centres


def near_duplicate_vectors(vectors: DataFrame, limit: float = 0.9, probes: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. probes, cells: None takes as many as the number of vectors asks for."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("v")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"))
    rows = rows.withColumn("v", F.when(F.coalesce(good, F.lit(False)), F.transform(v, lambda x: F.when(x == 0, F.lit(0).cast(kind[6:-1])).otherwise(x))))  # no -0.0
    rows = rows.select("vec_id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2"), F.col("v").isNotNull().alias("good"))
    centres = fit_centres(rows.where("good"), rows.where("good").count(), cells)
    reps = rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.any_value("v").alias("vector"))
    reps = reps.select(F.monotonically_increasing_id().alias("rep"), "copies", F.size("vector").alias("width"), "vector", "k1", "k2", "first_id")
    placed = f"rep long, copies long, width int, cells array<int>, vector {kind}, k1 long, k2 long, first_id long"
    assigned = stored(map_arrow(reps, _assign(centres, probes, limit), placed), "placed-vectors")

    each = assigned.select("rep", "copies", "width", "cells", "vector", F.explode("cells").alias("cell"))
    # A row for each cell that is used, at most CELLS for each vector length.
    sizes = assigned.select("width", F.explode("cells").alias("cell")).groupBy("width", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    each = each.join(F.broadcast(sizes), ["width", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # A row goes to each pair of blocks that its own one is in.
    each = each.withColumn("peer", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("*", F.least("block", "peer").alias("first"), F.greatest("block", "peer").alias("second")).drop("blocks", "peer")
    found = stored(each.groupBy("width", "cell", "first", "second").applyInArrow(_compare(limit), COMPARED), "vector-links")

    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "rep")
    classes = assigned.select("rep", "k1", "k2", "first_id", "copies").join(counts, "rep", "left").join(parts, "rep", "left")
    classes = classes.withColumn("component", F.coalesce("component", "rep")).withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    least = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    classes = classes.join(least, "component").select("k1", "k2", "n_links", "component_id")
    out = rows.where("good").select("vec_id", "k1", "k2").join(classes, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    bad = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark, sf_dir):
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
