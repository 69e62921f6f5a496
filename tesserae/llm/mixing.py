"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Targets fill sources by weight, none beyond max_epochs of its size. A source is
taken whole as often as its target allows; the rest of the target is filled by
its documents in ascending order of -ln(u) / weight, where u is a hash of the
document's id and text, as far as their prefix sum comes nearest the target.

A source may hold a third of all rows, so prefix sums are taken in two steps:
over slices of the sorted order within a source, then within a slice.

A null text has size 0 and is taken as often as its source's whole epochs; null
sources are one source, the last in order; repeated rows share u and are ordered
by nothing else, so which of them comes first is of no effect on sums. An empty
table gives an empty result; mix() passes further columns on, whatever their names. Texts of any
length count whole; a document larger than what is left of a target is taken if that brings the
sum nearer to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import WORD, checkpointed, documents, with_row

#: Slices of a source's order: 1/4096 of the largest source goes through one sort.
SLICES = 4096
BITS = 52


def uniform(seed: int, *keys: Column) -> Column:
    """A number in (0, 1) from the MD5 of a seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("\\N")) for k in keys))
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("double")
    return (number + 0.5) / float(1 << BITS)


def source_targets(sizes: DataFrame, weights: list[int], share: float, max_epochs: float) -> DataFrame:
    """target of each source. sizes: source, source_size; a row for each source.

    Filling by weight with excess reshared ends at the level L for which the sum of
    min(max_epochs * size, L * weight) is the whole. Sources are few against
    documents; they are ranked in one window over this aggregated table.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ranked = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", max_epochs * F.col("source_size"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("w"))
    up = Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    ranked = ranked.select(
        "*",
        F.coalesce(F.sum("cap").over(up), F.lit(0.0)).alias("capped"),
        F.coalesce(F.sum("w").over(up), F.lit(0.0)).alias("w_before"),
        F.sum("w").over(every).alias("w_all"),
        (share * F.sum("source_size").over(every)).alias("whole"),
    )
    # If the sources before this one (in order of cap / weight) are at their caps, the rest share this level.
    level = (F.col("whole") - F.col("capped")) / (F.col("w_all") - F.col("w_before"))
    ranked = ranked.withColumn("level", F.when(level <= F.col("ratio"), level))
    # The first source whose cap is not below its level sets it for all.
    first = F.first("level", ignorenulls=True).over(Window.orderBy("ratio", "source").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.select("source", "source_size", F.least("cap", F.coalesce(first, F.lit(float("inf"))) * F.col("w")).alias("target"))


def mixed(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    qualities: DataFrame | None = None,
) -> DataFrame:
    """One row for each input row: doc_id, text_key, source, size, source_size, target, copies (times taken), taken (words).

    qualities: doc_id and weight (above 0; the greatest counts if an id has several); a document without one weighs 1.
    """
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    u = uniform(seed, F.col(id_col), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    thin = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col), F.col(text_col).isNull()).alias("text_key"),
        F.col(source_col).alias("source"),
        size.alias("size"),
        (-F.log(u)).alias("key"),
    )
    if qualities is not None:
        best = qualities.where("doc_id IS NOT NULL AND weight > 0").groupBy("doc_id").agg(F.max("weight").alias("weight"))
        thin = thin.join(best, "doc_id", "left").withColumn("key", F.col("key") / F.coalesce("weight", F.lit(1.0))).drop("weight")
    # exp(-key) would be uniform for equal weights.
    thin = checkpointed(thin.withColumn("slice", F.floor(SLICES * (1 - F.exp(-F.col("key")))).cast("int")))
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, list(weights), share, max_epochs)
    # e whole epochs and a rest; a target of whole epochs has no rest.
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = checkpointed(targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")))
    slices = thin.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    before = slices.select("source", "slice", (F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")).alias("before"))
    # Null sources meet by a flag, as a null-safe join would not be hashed on the column.
    flat = lambda df: df.withColumn("no_source", F.col("source").isNull()).withColumn("s", F.coalesce("source", F.lit(""))).drop("source")
    plan = flat(before).join(flat(targets), ["no_source", "s"])
    rows = flat(thin).join(plan, ["no_source", "s", "slice"])
    inner = Window.partitionBy("no_source", "s", "slice").orderBy("key", "doc_id", "text_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.col("before") + F.sum("size").over(inner) - F.col("size")
    extra = ((F.col("rest") > 0) & (F.col("size") > 0) & (ahead + F.col("size") / 2 <= F.col("rest"))).cast("long")
    rows = rows.withColumn("copies", F.col("epochs") + extra)
    return rows.select(
        "doc_id", "text_key", F.when(~F.col("no_source"), F.col("s")).alias("source"), "size", "source_size", "target", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows, each as often as the mix takes it."""
    key = lambda doc_id, tk: F.xxhash64(doc_id, doc_id.isNull(), tk)
    plan = mixed(docs, id_col=id_col, text_col=text_col, **options)
    # Rows that agree in id and text stand next to each other in the order: their copies are pooled and dealt out evenly.
    plan = plan.select(key(F.col("doc_id"), F.col("text_key")).alias("k"), "text_key", "copies", "doc_id")
    plan = plan.groupBy("k", "text_key").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).where("copies > 0")
    tk = F.xxhash64(F.col(text_col), F.col(text_col).isNull())
    rows = with_row(docs, rk=key(F.col(id_col), tk), tk=tk)
    joined = rows.join(plan, (rows.rk == plan.k) & (rows.tk == plan.text_key))
    single = joined.where("n = 1").select("_row", "copies")
    shared = joined.where("n > 1")
    nth = F.row_number().over(Window.partitionBy("k", "text_key").orderBy("k"))
    shared = shared.withColumn("nth", nth).select("_row", (F.expr("copies div n") + (F.col("nth") <= F.col("copies") % F.col("n")).cast("long")).alias("copies"))
    each = single.unionByName(shared).where("copies > 0")
    return each.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def label_weights(spark, sf_dir) -> DataFrame:
    """Documents labelled good weigh 2, those labelled bad a half."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.where("quality IS NOT NULL").select("doc_id", F.when(F.col("quality") > 0, F.lit(2.0)).otherwise(F.lit(0.5)).alias("weight"))


def query(spark, sf_dir):
    plan = mixed(documents(spark, sf_dir), qualities=label_weights(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", "source", "copies")


#: The query's rows: one window over each source takes the place of slices.
SQL = r"""WITH q AS (SELECT doc_id, max(CASE WHEN quality > 0 THEN 2.0 ELSE 0.5 END) AS weight FROM labels WHERE quality IS NOT NULL GROUP BY 1),
  d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(CAST('0x' || substr(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '\N') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496) / coalesce(weight, 1.0) AS key
    FROM documents LEFT JOIN q USING (doc_id)),
  s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM d GROUP BY 1),
  c AS (SELECT *, 2.0 * source_size AS cap, [3.0, 1.0, 2.0][k % 3 + 1] AS w FROM s),
  o AS (SELECT *, coalesce(sum(cap) OVER up, 0) AS capped, coalesce(sum(w) OVER up, 0) AS w_before, sum(w) OVER () AS w_all, 1.5 * sum(source_size) OVER () AS whole FROM c
    WINDOW up AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  v AS (SELECT (SELECT level FROM (SELECT (whole - capped) / (w_all - w_before) AS level, cap / w AS ratio, source FROM o) WHERE level <= ratio ORDER BY ratio, source LIMIT 1) AS level),
  t AS (SELECT source, source_size, CAST(least(cap, coalesce(level, 'inf'::DOUBLE) * w) AS DOUBLE) AS target FROM o, v),
  e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
  p AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) - size AS ahead
    FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
  SELECT doc_id, size, source_size, round(target, 6) AS target, size * copies AS taken, source, copies FROM
    (SELECT *, epochs + CASE WHEN rest > 0 AND size > 0 AND ahead + size / 2.0 <= rest THEN 1 ELSE 0 END AS copies FROM p)"""
