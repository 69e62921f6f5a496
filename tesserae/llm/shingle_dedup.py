"""Near-duplicate groups by SimHash and the Jaccard similarity of word shingles.

Candidates are texts whose SimHash fingerprints are linked by chains of differences
within a limit, as simhash_dedup finds them by its Gray-order indexes, and texts that share
a band of minhashes (20 bands of 6: of 3,000 made pairs at a similarity of 0.8, 0.996 share
one), since fingerprints of most pairs near that similarity lie too many bits away for an
index. Each fingerprint class is one more band. Candidates are checked by the exact similarity
of the sets of shingles. Texts with one set of shingles are one node, so copies cost
nothing. The nodes of a band are first compared with the least of them; only nodes
that this leaves in different components are then compared with each other, in cells
of bounded size to which each set comes once, so that no pair of texts is moved. These
comparisons still grow with the square of a band whose texts are alike but below the
limit, at under a microsecond each for texts of 400 words.

Null and blank texts have no shingles and are one group; texts of any
length are shingled whole. Of a group the least doc_id stays, on ties the least text digest.
Empty tables give empty results. Further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpointed, map_arrow, text_key
from tesserae.llm.components import connected_components
from tesserae.llm.simhash_dedup import SEED, code_classes, first_of_each, majority

#: Words to a shingle, and the similarity from which texts are near-duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits in which fingerprints that the index links differ at most.
LIMIT = 4
BANDS, ROWS = 20, 6
#: Shingles hashed by all minhashes at a time.
PART = 4096
#: Shingles of a cell's side: as many nodes of a band as hold them about are compared in one task.
CELL = 1 << 20


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of the text's word shingles, each as often as it occurs; a shorter text is one shingle."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    size = min(shingle, len(words))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[size - 1 :].tolist())], np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles."""
    return np.unique(shingle_hashes(text, shingle))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; that of empty ones is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    n = BANDS * ROWS
    return rng.integers(0, 2**64, (n, 1), np.uint64) | np.uint64(1), rng.integers(0, 2**64, (n, 1), np.uint64)


def bands(own: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """A signed 64-bit hash for each band of the set's minhashes, which holds the band's number; none of an empty set."""
    if not len(own):
        return []
    a, b = factors
    least = np.full(len(a), np.iinfo(np.uint64).max)
    for k in range(0, len(own), PART):
        least = np.minimum(least, (own[k : k + PART][None, :] * a + b).min(axis=1))
    rows = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for batch in batches:
            hashes = [shingle_hashes(t.as_py(), shingle) for t in batch.column(2)]
            codes = pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64))
            sets = [np.unique(h) for h in hashes]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            own = pa.array([bands(s, factors) for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(nodes), codes, sizes, own], ["doc_id", "text_key", "node", "code", "shingles", "bands"])

    return run


def _check(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch in batches:
            a, b, keep = batch.column(0).to_pylist(), batch.column(1), []
            for k, node in enumerate(a):
                if node != key:  # pairs come by their lesser node
                    key, own = node, shingle_set(batch.column(2)[k].as_py(), shingle)
                keep.append(similarity(own, shingle_set(batch.column(3)[k].as_py(), shingle)) >= least)
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), b.filter(keep)], ["a", "b"])

    return run


def join_cell(node: list[int], group: list[int], side: list[int], sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs of similar nodes that connect the groups which such pairs connect.

    With two sides, only nodes of different sides are compared.
    """
    label = np.unique(np.array(group), return_inverse=True)[1]
    # The largest group goes last, as its nodes needn't be compared with each other.
    main = np.bincount(label).argmax()
    order = np.lexsort((label == main, np.array(side)))
    label, sizes = label[order], np.array([len(sets[k]) for k in order])
    apart = int(np.sum(np.array(side) == min(side)))
    ids = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    two, mark, found = apart < len(order), np.zeros(int(ids.max()) + 1, bool), []
    for k in range(apart):
        first = apart if two else k + 1
        open_ = (label[first:] != label[k]) & (sizes[first:] >= least * sizes[k]) & (sizes[k] >= least * sizes[first:])
        if not open_.any():
            continue
        # The nodes from the first to the last that may be similar.
        at = np.flatnonzero(open_)
        low, high = first + at[0], first + at[-1] + 1
        own = ids[starts[k] : starts[k + 1]]
        mark[own] = True
        both = np.add.reduceat(mark[ids[starts[low] : starts[high]]], starts[low:high] - starts[low], dtype=np.int64)
        mark[own] = False
        near = open_[at[0] : at[-1] + 1] & (both / (sizes[k] + sizes[low:high] - both) >= least)
        for j in np.flatnonzero(near) + low:
            if label[j] != label[k]:
                found.append((node[order[k]], node[order[j]]))
                label[label == label[j]] = label[k]
    return found


def _join_cells(shingle: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by cell, which may go on in the next batch.
        cell, held = None, ([], [], [], [])

        def flush() -> Iterator[pa.RecordBatch]:
            if len(set(held[1])) > 1 and (found := join_cell(*held, least)):
                a, b = zip(*found)
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            *cells, node, group, side = (c.to_pylist() for c in batch.columns[:6])
            for k, key in enumerate(zip(*cells)):
                if key != cell:
                    yield from flush()
                    cell, held = key, ([], [], [], [])
                for kept, x in zip(held, (node[k], group[k], side[k], shingle_set(batch.column(6)[k].as_py(), shingle))):
                    kept.append(x)
        yield from flush()

    return run


def left_apart(classed: DataFrame, texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links a - b between similar nodes of one band that are in different classes.

    classed: band, node, shingles, class. texts: node, text.
    """
    held = classed.groupBy("band", "class").agg(F.sum("shingles").alias("held"))
    plan = held.groupBy("band").agg(F.count("*").alias("classes"), F.max(F.struct("held", "class")).alias("top"), F.sum("held").alias("all")).where("classes > 1")
    parts = lambda shingles: F.ceil(shingles / CELL)
    plan = plan.select("band", "all", F.col("top.class").alias("main"), parts(F.col("top.held")).alias("mains"), parts(F.col("all") - F.col("top.held")).alias("others"))
    # A band beyond one cell is split: the others among themselves and with the largest class, but not that with itself.
    nth = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    is_main, small = F.col("class") == F.col("main"), F.col("all") <= CELL
    side = F.when(small, F.lit(0)).when(is_main, F.col("others") + nth("mains")).otherwise(nth("others"))
    last = F.when(small, F.lit(0)).when(is_main, F.col("others") - 1).otherwise(F.col("others") + F.col("mains") - 1)
    placed = classed.join(plan, "band").select("band", "node", "class", side.cast("long").alias("side"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("with"))
    rows = placed.join(texts, "node").select("band", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high"), "node", "class", "side", "text")
    rows = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
    return checkpointed(map_arrow(rows, _join_cells(shingle, least), "a long, b long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, text_key, class (a node that stands for the component)."""
    text = F.col(text_col)
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text).alias("text_key"), text.alias("text"))
    prints = checkpointed(map_arrow(thin, _prints(shingle), "doc_id long, text_key long, node long, code long, shingles long, bands array<long>"))
    nodes = prints.groupBy("node").agg(F.min("text_key").alias("text_key"), F.any_value("shingles").alias("shingles"), F.any_value("bands").alias("bands"))
    held = nodes.select("node", "shingles", F.explode("bands").alias("band"))
    # A class of fingerprints is a band too. Texts of one set that repeat other shingles may have several.
    coded = checkpointed(prints.where("shingles > 0").select("node", "shingles", "code").distinct())
    classes = code_classes(checkpointed(coded.select("code").distinct()), limit)
    held = held.unionByName(coded.join(classes, "code").select("node", "shingles", F.xxhash64(F.lit("code"), "class").alias("band")).distinct())
    firsts = held.groupBy("band").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first != last")
    held = checkpointed(held.join(firsts.select("band", "first"), "band"))
    texts = nodes.select("node", "text_key").join(held.select("node").distinct(), "node", "left_semi")
    texts = checkpointed(thin.select("text_key", "text").join(texts, "text_key").groupBy("node").agg(F.any_value("text").alias("text")))

    tried = checkpointed(held.where("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct())
    with_a = tried.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")
    links = checkpointed(map_arrow(both, _check(shingle, least), "a long, b long"))
    parts = connected_components(links)
    # What is left: nodes of one band in different components, each with each.
    classed = held.select("band", "node", "shingles").join(parts, "node", "left")
    more = left_apart(checkpointed(classed.select("band", "node", "shingles", F.coalesce("component", "node").alias("class"))), texts, shingle, least)
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more))
    return prints.join(parts, "node", "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("class"))


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, least: float = SIMILARITY, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, one of each component: the least doc_id, then the least text digest, nulls last; of equal rows, any one."""
    return first_of_each(docs, near_duplicates(docs, shingle, least, limit, id_col, text_col), id_col, text_col)
