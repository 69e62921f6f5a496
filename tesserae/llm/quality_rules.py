"""Quality rules: per-document base counts, and lines that are frequent on a host.

Lines are normalised (lower case, blanks trimmed and collapsed) and hashed. For
each host, the distinct documents that hold a line are counted; copies of one text
are one document, so that a copied document isn't taken for boilerplate. Lines
in more documents than the limit are removed, and a document is rejected if too
few of its words stay.

Null texts are empty (and fail the base rules); null hosts are one host; repeated
rows get equal verdicts; empty tables give empty results; texts and lines of any length are
counted whole; a line at a limit is not above it. quality_counts leaves further columns out,
quality_filter passes them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import BLANKS, WORD, checkpointed, documents, text_key, with_row, without, words


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    #: Per cent of words in repeated three-word windows.
    max_repeat: int = 50
    #: A line is frequent if more distinct documents of its host hold it than both of these.
    min_docs: int = 20
    max_share: float = 0.01
    #: A document is depleted if fewer words are left, or a lesser share of them.
    left_words: int = 25
    left_share: float = 0.3


#: Frequent lines that may be broadcast: 16 bytes each, 8 MB in all.
BROADCAST_LINES = 500_000
SYMBOLS = "#*$%&|<>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(w: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first included."""
    n = F.size(w)
    windows = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")),
    )

    def twice(s: Column) -> Column:
        return F.filter(s, lambda x, j: (F.get(s, j + 1)["h"] == x["h"]) | (F.get(s, j - 1)["h"] == x["h"]))

    starts = F.sort_array(F.transform(let(F.sort_array(windows), twice), lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )
    return F.when(n < 6, F.when((n >= 4) & (n <= 5), covered).otherwise(F.lit(0))).otherwise(covered)


def normal_line(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), r"[\x20\x09-\x0D]+", " "))


def line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def text_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(BLANKS))) > 0


def base_columns(text: Column, limits: Limits) -> Column:
    """A struct of the base counts and of the lines that hold words, as hash and number of words."""
    text = F.coalesce(text, F.lit(""))
    squeezed = without(text, BLANKS)
    signs = F.length(text) - F.length(without(text, SYMBOLS))
    counted = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeat_words(w).alias("repeat")))
    full = F.filter(text_lines(text), has_word)
    lines = let(
        full,
        lambda ls: F.struct(
            (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup"),
            F.transform(ls, lambda line: F.struct(line_hash(line).alias("h"), F.regexp_count(line, F.lit(WORD)).alias("n"))).alias("each"),
        ),
    )
    return F.struct(
        counted.alias("words"), F.length(squeezed).cast("long").alias("word_chars"), signs.cast("long").alias("n_symbols"), lines.alias("lines")
    )


def measured(docs: DataFrame, limits: Limits, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """The thin table that all later steps read: texts are read once."""
    one = docs.select(
        F.col(id_col).alias("doc_id"),
        text_key(F.col(text_col)).alias("text_key"),
        F.xxhash64(F.col(host_col), F.col(host_col).isNull()).alias("site"),
        base_columns(F.col(text_col), limits).alias("m"),
    )
    n, repeat = F.col("m.words.n").cast("long"), F.col("m.words.repeat").cast("long")
    return checkpointed(
        one.select(
            F.monotonically_increasing_id().alias("row_no"),
            "doc_id",
            "text_key",
            "site",
            n.alias("n_words"),
            F.col("m.word_chars").alias("word_chars"),
            F.col("m.n_symbols").alias("n_symbols"),
            F.col("m.lines.dup").cast("long").alias("n_dup_lines"),
            repeat.alias("n_repeat_words"),
            ((n < limits.min_words) | (100 * repeat > limits.max_repeat * n)).alias("base_failed"),
            F.col("m.lines.each").alias("lines"),
        )
    )


def frequent_lines(thin: DataFrame, limits: Limits) -> DataFrame:
    """site and h of the lines held by too many distinct documents of their site."""
    held = thin.select("site", "text_key", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = held.groupBy("site", "h").agg(F.count_distinct("text_key").alias("n")).where(F.col("n") > limits.min_docs)
    sites = thin.groupBy("site").agg(F.count_distinct("text_key").alias("n_docs"))
    return checkpointed(counts.join(sites, "site").where(F.col("n") > limits.max_share * F.col("n_docs")).select("site", "h"))


def judged(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row for each input row: the base counts, base_failed, removed (hashes of frequent lines), n_left_words, kept."""
    thin = measured(docs, limits, id_col, text_col, host_col)
    frequent = frequent_lines(thin, limits)
    lines = thin.select("row_no", "site", F.explode("lines").alias("line")).select("row_no", "site", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    small = frequent.count() <= BROADCAST_LINES
    hit = lines.join(F.broadcast(frequent) if small else frequent, ["site", "h"])
    removed = hit.groupBy("row_no").agg(F.sum("n").alias("gone"), F.collect_set("h").alias("removed"))
    rows = thin.drop("lines", "site").join(removed, "row_no", "left")
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    depleted = (left < limits.left_words) | (left < limits.left_share * F.col("n_words"))
    return rows.withColumn("n_left_words", left).withColumn("kept", ~F.col("base_failed") & ~depleted).drop("gone", "row_no")


def quality_counts(docs: DataFrame, limits: Limits = Limits(), **columns: str) -> DataFrame:
    return judged(docs, limits, **columns).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left_words"
    )


def quality_filter(docs: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows kept, their frequent lines removed; n_chars, if there is such a column, is set anew for texts that changed."""
    verdicts = judged(docs, limits, id_col, text_col, host_col).where("kept")
    key = F.xxhash64("doc_id", F.col("doc_id").isNull(), "text_key")
    verdicts = verdicts.select(key.alias("k"), "text_key", "removed").groupBy("k", "text_key").agg(F.any_value("removed", ignoreNulls=True).alias("removed"))
    rows = with_row(docs, tk=text_key(F.col(text_col)), rk=F.xxhash64(F.col(id_col), F.col(id_col).isNull(), text_key(F.col(text_col))))
    joined = rows.join(verdicts, (rows.rk == verdicts.k) & (rows.tk == verdicts.text_key))
    text = F.col(f"_row.`{text_col}`")
    cut = F.array_join(F.filter(text_lines(text), lambda line: ~(has_word(line) & F.array_contains(F.col("removed"), line_hash(line)))), "\n")
    text = F.when(F.col("removed").isNull(), text).otherwise(cut)
    out = joined.select("_row", text.alias("_text"), F.col("removed").isNotNull().alias("_changed"))
    each = []
    for c in docs.columns:
        column = F.col(f"_row.`{c}`")
        if c == text_col:
            column = F.col("_text")
        elif c == "n_chars":
            column = F.when(F.col("_changed"), F.length("_text").cast(docs.schema[c].dataType)).otherwise(column)
        each.append(column.alias(c))
    return out.select(*each)


def query(spark, sf_dir):
    return quality_counts(documents(spark, sf_dir))


#: The query's rows, with the default limits; lines are compared as texts rather than by hash.
SQL = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, coalesce(text, '') AS t, source FROM documents),
  w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
  z AS (SELECT r, unnest(list_zip(ws[1:-3], ws[2:-2], ws[3:], range(1, len(ws) - 1))) AS q FROM w WHERE len(ws) >= 3),
  t AS (SELECT r, q[4] AS i, count(*) OVER (PARTITION BY r, q[1], q[2], q[3]) AS n FROM z),
  rep AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM t WHERE n > 1) GROUP BY 1),
  l AS (SELECT r, source, text, unnest(string_split(t, chr(10))) AS line FROM d),
  lw AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, lower(regexp_replace(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM l),
  f AS (SELECT source, h FROM lw JOIN (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY 1) s USING (source) WHERE n > 0 GROUP BY source, h, docs HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.01 * docs),
  dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lw WHERE n > 0 GROUP BY 1),
  gone AS (SELECT r, sum(n) AS n FROM lw SEMI JOIN f USING (source, h) WHERE n > 0 GROUP BY 1),
  b AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ws) - coalesce(gone.n, 0) AS BIGINT) AS n_left_words
    FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left_words >= 25 AND n_left_words >= 0.3 * n_words AS kept, n_left_words FROM b"""
