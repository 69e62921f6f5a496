"""SimHash near-duplicate groups.

Fingerprints that differ in few bits are found by pigeonhole and Gray-order
indexes: 64 bits are split into limit + 2 blocks, and two codes within the limit
agree in two blocks at least. For each pair of blocks the distinct codes are
partitioned by the bits in them (15 tables of about 21 bits for a limit of 4), so
that no partition grows with one bucket of the corpus; within a partition, codes
are sorted by the Gray rank of the code with those blocks moved to the front, and
runs of buckets are joined with themselves by a hierarchical index that prunes
whole groups. A bucket too large for one index is split into leaves whose shared
bits rule out most pairs of leaves before their codes are compared.

Rows under one fingerprint are one node, so copies cost nothing, and each index
emits a spanning forest of its links rather than all pairs.

A null or blank text has fingerprint zero. Repeated rows, and different texts
under one doc_id, share their component. A component whose doc_ids are all null
has a null component_id. Of a component the least doc_id stays, on ties the least text
digest. Texts of any length are hashed whole, shingle by shingle. Empty tables give empty results; further columns pass
through near_dedup, whatever their names, and are left out by near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import checkpointed, documents, map_arrow, text_key, with_row
from tesserae.llm.components import connected_components
from tesserae.llm.gray_index import Forest, GrayIndex, gray_rank

SEED = 42
#: Codes, each in all its tables, that a task indexes about.
ROUTED = 60_000
#: Shingles hashed at a time.
SHINGLES = 1 << 15
#: Codes to an index, and to a leaf of a bucket that exceeds it.
INDEX_CODES = 8192


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of some hashes have each of the 64 bits."""
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes have; zero for none."""
    ones = sum((_ones(hashes[k : k + SHINGLES]) for k in range(0, len(hashes), SHINGLES)), np.zeros(64, np.int64))
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64-bit SimHash of the text's word shingles, each as often as it occurs."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    starts, ends = starts[:n].tolist(), ends[size - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for k in range(0, n, SHINGLES):
        ones += _ones(np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + SHINGLES], ends[k : k + SHINGLES])], "<u8"))
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(codes)], ["doc_id", "text_key", "code"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key and code (the fingerprint as a signed long) of every row."""
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(F.col(text_col)).alias("text_key"), F.col(text_col).alias("text"))
    return map_arrow(thin, _fingerprints(shingle), "doc_id long, text_key long, code long")


def blocks(limit: int) -> list[tuple[int, int]]:
    """(first bit, width) of limit + 2 blocks of 64 bits."""
    edges = [round(64 * k / (limit + 2)) for k in range(limit + 3)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


class Tables:
    """The pairs of blocks, and codes with the bits of a pair moved to the front."""

    def __init__(self, limit: int) -> None:
        self.limit, self.blocks = limit, blocks(limit)
        self.pairs = list(combinations(range(len(self.blocks)), 2))
        self.masks = [np.uint64(((1 << w) - 1) << s) for s, w in self.blocks]

    def front(self, table: int) -> int:
        return sum(self.blocks[k][1] for k in self.pairs[table])

    def order(self, table: int) -> list[int]:
        first = self.pairs[table]
        return [*first, *(k for k in range(len(self.blocks)) if k not in first)]

    def permute(self, codes: np.ndarray, table: int) -> np.ndarray:
        out, at = np.zeros(len(codes), np.uint64), 64
        for k in self.order(table):
            start, width = self.blocks[k]
            at -= width
            out |= ((codes >> np.uint64(start)) & np.uint64((1 << width) - 1)) << np.uint64(at)
        return out

    def restore(self, codes: np.ndarray, table: int) -> np.ndarray:
        out, at = np.zeros(len(codes), np.uint64), 64
        for k in self.order(table):
            start, width = self.blocks[k]
            at -= width
            out |= ((codes >> np.uint64(at)) & np.uint64((1 << width) - 1)) << np.uint64(start)
        return out


def _route(limit: int):
    """Each code once for each table: table, bucket (the bits of its two blocks), Gray rank of the permuted code, the latter itself."""
    tables = Tables(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(0).to_numpy().view(np.uint64)
            for t in range(len(tables.pairs)):
                moved = tables.permute(codes, t)
                yield pa.record_batch(
                    [
                        pa.array(np.full(len(codes), t, np.int32)),
                        pa.array((moved >> np.uint64(64 - tables.front(t))).astype(np.int64)),
                        pa.array((gray_rank(moved) ^ np.uint64(1 << 63)).view(np.int64)),  # sorts as unsigned
                        pa.array(moved.view(np.int64)),
                    ],
                    ["table_no", "bucket", "gray", "moved"],
                )

    return run


#: kind 0: a link a - b. kind 1: a leaf of an oversized bucket.
JOINED = "kind int, a long, b long, table_no int, bucket long, leaf int, ones long, zeros long, codes array<long>"


def _joined(rows: dict[str, list]) -> pa.RecordBatch:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
    names = [x.split()[0] for x in JOINED.split(", ")]
    return pa.record_batch([pa.array(rows[k], t) for k, t in zip(names, types)], names)


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    n = len(a)
    none = [None] * n
    return _joined({"kind": [0] * n, "a": a.view(np.int64), "b": b.view(np.int64), "table_no": none, "bucket": none, "leaf": none, "ones": none, "zeros": none, "codes": none})


def _join_buckets(limit: int):
    tables = Tables(limit)

    def within(codes: np.ndarray, table: int) -> pa.RecordBatch | None:
        index = GrayIndex(codes)
        forest = Forest(len(index.codes))
        for a, b in index.batches(limit):
            forest.link(a, b)
        child = np.flatnonzero(forest.parent != np.arange(len(forest.parent)))
        if not len(child):
            return None
        plain = tables.restore(index.codes, table)
        return _links(plain[child], plain[forest.parent[child]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by table and Gray rank, hence by bucket. Whole buckets are gathered up to the size of an index.
        held, table, big, leaf = np.zeros(0, np.uint64), -1, None, 0

        def flush(codes: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(codes) > 1 and (found := within(codes, table)):
                yield found

        def leaves(codes: np.ndarray, bucket: int) -> Iterator[pa.RecordBatch]:
            nonlocal leaf
            yield from flush(codes)
            signed = codes.view(np.int64)
            row = {"kind": [1], "a": [None], "b": [None], "table_no": [table], "bucket": [bucket], "leaf": [leaf]}
            row |= {"ones": [int(np.bitwise_and.reduce(signed))], "zeros": [int(np.bitwise_and.reduce(~signed))], "codes": [signed.tolist()]}
            leaf += 1
            yield _joined(row)

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Works off what is held, but for a bucket that may go on."""
            nonlocal held, big, leaf
            while len(held) and (last or len(held) > 2 * INDEX_CODES):
                keys = held >> np.uint64(64 - tables.front(table))
                if big is not None:
                    end = int(np.searchsorted(keys != big, True)) if keys[0] == big else 0
                    if end:
                        part, held = held[: min(end, INDEX_CODES)], held[min(end, INDEX_CODES) :]
                        yield from leaves(part, big)
                    if not end or len(held) and held[0] >> np.uint64(64 - tables.front(table)) != big:
                        big = None
                    continue
                cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1  # where buckets begin
                fits = cuts[cuts <= INDEX_CODES]
                if len(held) <= INDEX_CODES and last:
                    yield from flush(held)
                    held = held[:0]
                elif len(fits):
                    yield from flush(held[: fits[-1]])
                    held = held[fits[-1] :]
                else:
                    big, leaf = keys[0], 0

        for b in batches:
            nos, moved = b.column(0).to_numpy(), b.column(3).to_numpy().view(np.uint64)
            for t in np.unique(nos):
                if t != table:
                    yield from settle(True)
                    held, table, big = np.zeros(0, np.uint64), int(t), None
                held = np.concatenate([held, moved[nos == t]])
                yield from settle(False)
        yield from settle(True)

    return run


def _join_leaves(limit: int):
    tables = Tables(limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for table, left, right in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                left = np.array(left.as_py(), np.int64).view(np.uint64)
                index = GrayIndex(np.array(right.as_py(), np.int64).view(np.uint64))
                forest = Forest(len(left) + len(index.codes))
                for start in range(0, len(left), 256):
                    who, found = index.search(left[start : start + 256], limit)
                    forest.link(who + start, found + len(left))
                both = tables.restore(np.concatenate([left, index.codes]), table)
                child = np.flatnonzero(forest.parent != np.arange(len(both)))
                yield pa.record_batch([pa.array(both[child].view(np.int64)), pa.array(both[forest.parent[child]].view(np.int64))], ["a", "b"])

    return run


def links(codes: DataFrame, limit: int = 4, salts: int = 16) -> DataFrame:
    """Links a - b that connect exactly the distinct codes which a chain of differences within the limit connects.

    codes: a column code of distinct longs.
    """
    routed = map_arrow(codes.select("code"), _route(limit), "table_no int, bucket long, gray long, moved long")
    # By number of rows rather than of bytes: comparing small codes takes long.
    parts = max(int(codes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 15 * codes.count() // ROUTED)
    sorted_ = routed.repartition(parts, "table_no", "bucket").sortWithinPartitions("table_no", "gray")
    joined = checkpointed(map_arrow(sorted_, _join_buckets(limit), JOINED))
    found = joined.where("kind = 0").select("a", "b")
    leaves = joined.where("kind = 1").select("table_no", "bucket", "leaf", "ones", "zeros", "codes")
    if leaves.isEmpty():
        return found
    # Pairs of leaves of one bucket, salted, as a bucket may be large; the bits that a leaf's codes share rule most out.
    left = leaves.withColumn("salt", F.pmod("leaf", F.lit(salts)))
    right = leaves.select("table_no", "bucket", *(F.col(c).alias(f"r_{c}") for c in ("leaf", "ones", "zeros", "codes"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    apart = F.bit_count(F.col("ones").bitwiseAND(F.col("r_zeros")).bitwiseOR(F.col("zeros").bitwiseAND(F.col("r_ones"))))
    pairs = left.join(right, ["table_no", "bucket", "salt"]).where((F.col("leaf") < F.col("r_leaf")) & (apart <= limit))
    pairs = pairs.select("table_no", "codes", "r_codes").repartition(F.col("codes")[0], F.col("r_codes")[0])
    return found.unionByName(map_arrow(pairs, _join_leaves(limit), "a long, b long"))


def group_codes(prints: DataFrame, limit: int = 4) -> DataFrame:
    """code, component_id (least doc_id reachable) and class (one code that stands for the component)."""
    nodes = checkpointed(prints.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    classes = nodes.join(code_classes(nodes.select("code"), limit), "code")
    least = classes.groupBy("class").agg(F.min("first_id").alias("component_id"))
    return classes.join(least, "class").select("code", "component_id", "class")


def code_classes(codes: DataFrame, limit: int = 4) -> DataFrame:
    """code and class (one code that stands for all reachable). codes: a column code of distinct longs."""
    parts = connected_components(links(codes, limit))
    return codes.join(parts, codes.code == parts.node, "left").select("code", F.coalesce("component", "code").alias("class"))


def near_duplicates(docs: DataFrame, limit: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, text_key, code, component_id, class."""
    prints = checkpointed(fingerprints(docs, shingle, id_col, text_col))
    return prints.join(group_codes(prints, limit), "code")


def near_dedup(docs: DataFrame, limit: int = 4, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows, one of each component: the least doc_id, then the least text digest, nulls last; of equal rows, any one."""
    return first_of_each(docs, near_duplicates(docs, limit, shingle, id_col, text_col), id_col, text_col)


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows that near_dedup keeps. found: doc_id, text_key, class."""
    chosen = found.groupBy("class").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"),
    )
    key = lambda i, t: {"no_id": i.isNull(), "k_id": F.coalesce(i, F.lit(0)), "k_text": t}
    chosen = chosen.select(*(c.alias(k) for k, c in key(F.col("first.doc_id"), F.col("first.text_key")).items()))
    rows = with_row(docs, **key(F.col(id_col).cast("long"), text_key(F.col(text_col))))
    on = ["no_id", "k_id", "k_text"]
    # Of rows that agree in id and text one is kept; they are partitioned and sorted by these keys already.
    return rows.join(chosen, on, "left_semi").groupBy(*on).agg(F.any_value("_row").alias("_row")).select("_row.*")


def query(spark, sf_dir):
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
