"""Removal of passages that repeat, by sliding spans of sentences.

A text is cut into sentences: after a sentence end (closing quotes and brackets may follow
it) with blanks, and at line breaks. From each sentence on, a run of as many consecutive ones
as it takes to hold MIN_WORDS words is hashed (128 bits over their normalised forms: lower
case, one blank between words). Several short sentences are a run, or a single one as long
as that; a span of that many words does not repeat by chance, as a heading or a formula of
greeting does. Runs are joined globally on their hash; the first of equal runs (by doc_id,
text digest, position) stays, and sentences that any other one covers are removed.

Runs hold digests and byte offsets, no text. A hash that more than one in HOT of all runs
has (there are HOT of these at most) is joined by a broadcast, so that no task gets all
copies of a boilerplate passage; others are joined by a shuffle.

Null texts stay null; empty texts, and texts of fewer words than a run, stay as they are;
texts of any length are cut whole, in linear time; rows under one doc_id with one text are
one document, whose verdict all of them get; null ids are one id, the first; ties of runs
are settled by the digest of the text, then by position. An empty table gives an empty
result. Further columns pass through whatever their names, save `n_removed`, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import documents, map_arrow, stored, text_key, with_row

#: Words that a run holds at least.
MIN_WORDS = 20
#: A hash is hot if more than one in HOT runs has it.
HOT = 1000
#: What ends a sentence, in UTF-8: a mark, closing quotes or brackets and blanks, or a line break.
END = re.compile(rb"(?:[.!?]|\xe2\x80\xa6)(?:[\"'\])]|\xe2\x80[\x98\x99\x9c\x9d]|\xc2\xbb)*+[ \t-\r]++|\n[ \t-\r]*+")


def cuts(text: bytes) -> list[int]:
    """Where the sentences of a text begin, and its length."""
    at = [0, *(m.end() for m in END.finditer(text))]
    return at if at[-1] == len(text) else [*at, len(text)]


def runs_of(text: bytes, min_words: int) -> tuple[list[bytes], list[int], list[int]]:
    """Digests of a text's runs, and where they begin and end."""
    at = cuts(text)
    counts, digests = [], []
    for a, b in zip(at, at[1:]):
        words = text[a:b].decode("utf-8").lower().encode("utf-8").split()
        counts.append(len(words))
        digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
    found, starts, ends = [], [], []
    last = n = 0
    for first, own in enumerate(counts):
        while last < len(counts) and n < min_words:
            n += counts[last]
            last += 1
        if n < min_words:
            break
        if own:  # else the next run is this one
            found.append(xxhash.xxh3_128_digest(b"".join(d for d, c in zip(digests[first:last], counts[first:last]) if c)))
            starts.append(at[first])
            ends.append(at[last])
        n -= own
    return found, starts, ends


def _runs(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts, ends, owner = [], [], [], []
            for k, text in enumerate(batch.column(2).cast(pa.binary())):
                found, s, e = runs_of(text.as_py() or b"", min_words)
                hashes += found
                starts += s
                ends += e
                owner += [k] * len(found)
            h = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            at = pa.array(owner, pa.int32())
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            yield pa.record_batch(columns, ["doc_id", "tk", "h1", "h2", "start", "end"])

    return run


def repeated_runs(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tk and spans (start and end of runs that repeat an earlier one) of the documents that have any."""
    text = F.col(text_col)
    thin = docs.select(F.col(id_col).alias("doc_id"), text_key(text).alias("tk"), text.alias("text")).where("text IS NOT NULL")
    kind = docs.schema[id_col].dataType.simpleString()
    runs = stored(map_arrow(thin, _runs(min_words), f"doc_id {kind}, tk long, h1 long, h2 long, start int, end int"), "passage-runs")
    place = F.struct("doc_id", "tk", "start")
    # Equal rows repeat the same places; they don't make a run repeated, since its first place is theirs too.
    groups = runs.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("NOT first <=> last")
    groups = stored(groups.select("h1", "h2", "first", "n"), "passage-repeats")
    most = max(1000, runs.count() // HOT)
    hot, rest = groups.where(F.col("n") > most), groups.where(F.col("n") <= most)
    with_hot = runs.join(F.broadcast(hot.drop("n")), ["h1", "h2"])  # HOT rows at most
    others = runs.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(rest.drop("n"), ["h1", "h2"])
    later = with_hot.unionByName(others).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))  # a document's own


def islands(spans: Column) -> Column:
    """Spans that overlap or touch as one. Both starts and ends ascend."""
    firsts = F.filter(spans, lambda s, i: (i == 0) | (s["start"] > F.get(spans, i - 1)["end"]))
    lasts = F.filter(spans, lambda s, i: (i == F.size(spans) - 1) | (F.get(spans, i + 1)["start"] > s["end"]))
    return F.zip_with(firsts, lasts, lambda a, b: F.struct(a["start"].alias("start"), b["end"].alias("end")))


def _without(text: Column, gone: Column) -> Column:
    """The text less the bytes of islands."""
    raw = text.cast("binary")
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["end"]))
    starts = F.concat(F.transform(gone, lambda g: g["start"]), F.array(F.octet_length(text)))
    return F.array_join(F.zip_with(ends, starts, lambda a, b: F.call_function("substring", raw, a + 1, b - a).cast("string")), "")


def passage_dedup(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input with the text less its repeated passages, and n_removed, the number of bytes removed."""
    tag = lambda i, t: {"no_id": i.isNull(), "k_id": F.coalesce(i.cast("string"), F.lit("")), "k_text": t}
    found = repeated_runs(docs, min_words, id_col, text_col)
    found = found.select(islands(F.col("spans")).alias("gone"), *(c.alias(k) for k, c in tag(F.col("doc_id"), F.col("tk")).items()))
    rows = with_row(docs, **tag(F.col(id_col), text_key(F.col(text_col))))
    joined = rows.join(found, ["no_id", "k_id", "k_text"], "left").select("_row", "gone")
    text = F.col(f"_row.`{text_col}`")
    clean = F.when(F.col("gone").isNull(), text).otherwise(_without(text, F.col("gone")))
    n = F.coalesce(F.aggregate("gone", F.lit(0).cast("long"), lambda a, g: a + g["end"] - g["start"]), F.lit(0).cast("long"))
    out = joined.select("_row", clean.alias("_text"), n.alias("_n"))
    return out.select(*(F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c != "n_removed"), F.col("_n").alias("n_removed"))


def query(spark, sf_dir):
    out = passage_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", (F.col("n_removed") > 0).alias("repeats"), "n_removed", "text")
