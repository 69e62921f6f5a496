"""Token ids as a Parquet file format.

A table of documents in ascending order of id, range-partitioned into files:
doc_id, part, part_start (ids before it in its file), n_tokens, and ids as a list
column, dictionary-encoded in bounded row groups with bounded pages and page
indexes. Readers that want metadata never touch the pages of ids, and readers
that want a range of documents skip row groups and pages by doc_id.

A null id sorts first; rows under one id follow each other by text; a null text
counts as empty and holds the end id alone; further columns are left out, whatever their names.
A text of any length is one row and is encoded whole; pages and row groups are bounded by rows,
so a very long one makes its page larger. Equal rows are written each, in no order among
themselves. An empty table gives no file of rows, and reading gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.llm import byte_tokens
from tesserae.llm.common import documents, fresh_folder, map_arrow, tokenizer_path

WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
}
DELTA_OPTIONS = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}
FILE_SCHEMA = "part int, part_start long, n_tokens long, ids array<int>"
#: Rows to an output batch, and ids after which one is closed.
BATCH_IDS = 2_000_000


def encode_part(tokenizer: str, end_id: int | None, id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokens.tokens(tokenizer).encode
        part, start = TaskContext.get().partitionId(), 0
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

        def batch(doc_ids: list, pieces: list[bytes], start: int) -> pa.RecordBatch:
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
            offsets = np.concatenate([[0], np.cumsum(lengths)])
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(pieces), "<i4")))
            return pa.record_batch(
                [pa.array(doc_ids, id_type), pa.array(np.full(len(pieces), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(lengths), ids],
                ["doc_id", "part", "part_start", "n_tokens", "ids"],
            )

        doc_ids, pieces, size = [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                doc_ids.append(doc_id)
                pieces.append(encode(text.as_py()) + end)
                size += len(pieces[-1]) // 4
                if size >= BATCH_IDS:
                    yield batch(doc_ids, pieces, start)
                    start, doc_ids, pieces, size = start + size, [], [], 0
        if pieces:
            yield batch(doc_ids, pieces, start)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None, encoding: str = "dictionary") -> None:
    """Encodes each whole text and writes the table; a lost task is rerun and committed once by Spark's writer."""
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    rows = map_arrow(ordered, encode_part(tokenizer, end_id, pa.int64()), f"doc_id long, {FILE_SCHEMA}")
    rows.write.mode("error").options(**WRITE_OPTIONS | (DELTA_OPTIONS if encoding == "delta" else {})).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The table with start, the number of ids of all documents before."""
    rows = spark.read.parquet(path)
    # A row for each file: their number is that of the writer's partitions.
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids")


def checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column(3)
        offsets, values = ids.offsets.to_pylist(), memoryview(np.ascontiguousarray(ids.values.to_numpy(), "<u4")).cast("B")
        crc = [zlib.crc32(values[4 * s : 4 * e]) for s, e in zip(offsets, offsets[1:])]
        yield pa.record_batch([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def query(spark, sf_dir):
    path = fresh_folder(spark, "token-ids")
    write_tokens(documents(spark, sf_dir), path, tokenizer_path("byte_bpe_50k.json"), end_id=2)
    return map_arrow(read_tokens(spark, path), checksum, "doc_id long, start long, n_tokens long, ids_crc32 long")
