"""Helpers shared by the corpus operators: shared folders, reliable cuts of lineage, the place of tokenizer files."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python spelling of one word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The ASCII white-space characters that separate words.
BLANKS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or on a local master a folder of our own."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = jsc.getCheckpointDir()
    if named is None and current.isDefined():
        named = current.get()
    if named is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tesserae-")
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


#: Folders to delete when the driver ends.
_folders: list[str] = []


def _clean_up() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for folder in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new name in the shared folder; what is written there goes when the driver ends."""
    if not _folders:
        atexit.register(_clean_up)
    _folders.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _folders[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder as Parquet, without lineage; smaller than a checkpoint."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder, without lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context, so that it need not be installed there."""
    context = spark.sparkContext
    if not getattr(context, "_tesserae_shipped", False):
        package = Path(__file__).parents[1]
        context.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp(prefix='tesserae-')}/tesserae", "zip", package.parent, package.name))
        context._tesserae_shipped = True


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where an installed public tokenizer file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty one."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def without(text: Column, characters: str) -> Column:
    """The text less some characters, by byte search rather than a regular expression."""
    for c in characters:
        text = F.replace(text, F.lit(c))
    return text


def with_row(df: DataFrame, **columns: Column) -> DataFrame:
    """Packs the input's columns into one struct, so that helper columns can't clash with them."""
    return df.select(F.struct("*").alias("_row"), *(c.alias(k) for k, c in columns.items()))


def text_key(text: Column) -> Column:
    """64-bit digest that tells texts under one doc_id apart; null differs from empty."""
    return F.xxhash64(text, text.isNull())
