"""A corpus pipeline: quality rules, near-duplicates, secrets, mixing, encoding.

Each stage takes the documents that its predecessor kept, and all but the last
return the columns of documents. Stages are written as Parquet and read again, so
that a lost executor costs one stage's tasks at most.

Null, empty and blank texts fail the quality rules and go no further; a stage that gets
them all the same keeps one of them as near-duplicates, masks nothing, takes none of them
beyond whole epochs and encodes them to nothing. Null sources are one source, null ids are
kept apart by text. Repeated rows are one document after the second stage. Texts of any
length are handled whole. Further columns, whatever their names, pass through all stages
but the last. Of near-duplicates the least doc_id stays. An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import bpe_codec, mixing, quality_rules, secret_scan, shingle_dedup
from tesserae.llm.common import documents, fresh_folder, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and frequent lines from the others."""
    return quality_rules.quality_filter(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: five words to a shingle, a similarity of 0.8 at least.

    Candidates come from SimHash fingerprints through Gray-order indexes, and from minhashes.
    """
    return shingle_dedup.near_dedup(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in texts."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents as the mix of sources asks."""
    return mixing.mix(docs, qualities=mixing.label_weights(spark, sf_dir))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of ids and decoded texts."""
    return bpe_codec.digests(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("encode", encode)]
#: Fingerprints, forests and BPE merges are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    *first, (_, last) = STAGES
    for name, stage in first:
        path = fresh_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return last(spark, docs, sf_dir)
