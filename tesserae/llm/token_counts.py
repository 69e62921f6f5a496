"""Token counts through a digest cache.

Contents are known by the SHA-256 of their normalised UTF-8 bytes, tokenizers by
the SHA-256 of their file. Counts stored for a pair are reused; only distinct
contents without one are encoded, and their counts are appended to the cache.

Nulls count as empty texts; rows that repeat share one entry of the cache; an
empty table gives an empty result; further columns of the input are left out, whatever their
names. Texts of any length are encoded whole; a hot text is encoded once. Of equal entries in
the cache either is used, as they agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tesserae.llm import byte_tokens
from tesserae.llm.common import checkpointed, documents, fresh_folder, map_arrow, tokenizer_path

#: Missing digests that may be broadcast: 32 bytes each, 16 MB in all.
BROADCAST_DIGESTS = 500_000
CACHE_SCHEMA = "digest binary, n_tokens long, tokenizer string"


def file_digest(path: str) -> str:
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def read_cache(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer. An entry appended twice (by runs side by side) counts once."""
    spark = docs.sparkSession
    try:
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = spark.createDataFrame([], CACHE_SCHEMA)
    return stored.where(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def encode_counts(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = byte_tokens.counter(path)
        for b in batches:
            counts = [count(t.as_py()) for t in b.column(1)]
            yield pa.record_batch([b.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    cache: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] = lambda text: text,
    limit: int = 1024,
) -> DataFrame:
    """One row for each input row: the id, n_bytes, n_tokens and over_limit, besides the digest.

    tokenizer: a byte-level BPE file of the tokenizers library, at a path that every executor has.
    cache: a Parquet folder that all executors share; it is made at the first append.
    """
    version = file_digest(tokenizer)
    text = normalise(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(F.col(id_col), text.alias("_text")).withColumn("digest", F.unhex(F.sha2("_text", 256)))
    thin = checkpointed(keyed.select(id_col, "digest", F.octet_length("_text").cast("long").alias("n_bytes")))
    distinct = thin.select("digest").distinct()
    missing = checkpointed(distinct.join(read_cache(docs, cache, version), "digest", "left_anti"))
    n_missing = missing.count()
    if n_missing:
        wanted = keyed.select("digest", "_text")
        if n_missing < distinct.count():
            wanted = wanted.join(F.broadcast(missing) if n_missing <= BROADCAST_DIGESTS else missing, "digest", "left_semi")
        once = wanted.groupBy("digest").agg(F.any_value("_text").alias("_text"))  # copies are merged before the shuffle too
        counted = map_arrow(once, encode_counts(tokenizer), "digest binary, n_tokens long")
        counted.withColumn("tokenizer", F.lit(version)).write.mode("append").parquet(cache)
    return thin.join(read_cache(docs, cache, version), "digest", "left").select(
        id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "digest"
    )


def query(spark, sf_dir):
    counts = token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), fresh_folder(spark, "token-counts"))
    return counts.select("doc_id", "n_bytes", "n_tokens", "over_limit", F.lower(F.hex("digest")).alias("content_sha256"))
