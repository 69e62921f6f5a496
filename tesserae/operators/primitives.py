"""Data-parallel primitives: compaction, reduction, scans, searches, run-length operations.

Arrays are rows with an order column. Order-dependent results never rely on the
order of partitions: scans cut the order into ranges, sum them, and run within. There
are as many ranges as the size of the input asks for, RANGES at most.
"""

from __future__ import annotations

import math
import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ranges of an order at most, and rows to a range.
RANGES, RANGE_ROWS = 65_536, 2_000_000
#: Rows that a task of a join takes together.
TOGETHER = 1_000_000


def checkpoint_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which executors share; on a local master a folder of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesserae-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows written to the checkpoint folder, without lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def n_ranges(df: DataFrame) -> int:
    """By the number of rows, which is counted; at least as many as shuffles have partitions."""
    return min(RANGES, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // RANGE_ROWS))


def by_rows(rows: int, *sides: tuple[DataFrame, list[str]]) -> list[DataFrame]:
    """Sides of a join, partitioned by their keys into one for each TOGETHER rows, so that the memory of a task doesn't grow: few bytes may be many rows."""
    n = min(RANGES, rows // TOGETHER + 1)
    return [df.repartition(n, *keys) for df, keys in sides]


def range_bounds(df: DataFrame, key: str, ranges: int | None = None) -> list[float]:
    """Approximate quantiles of a numeric order column; at most RANGES - 1 numbers reach the driver."""
    n = ranges or n_ranges(df)
    if n < 2:
        return []
    found = df.select(F.col(key).cast("double").alias("k")).where("k IS NOT NULL").approxQuantile("k", [i / n for i in range(1, n)], 0.5 / n)
    return sorted(set(found))


def range_no(key: Column, bounds: Sequence[float]) -> Column:
    """How many bounds lie at or below the key: rows of one key fall in one range. Looked up in two steps, by groups of bounds."""
    if not bounds:
        return F.lit(0)
    width = math.isqrt(len(bounds)) + 1
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    k = key.cast("double")
    below = lambda array: F.size(F.filter(array, lambda b: b <= k))
    tops = F.array(*(F.lit(g[0]) for g in groups))
    group = F.greatest(below(tops) - 1, F.lit(0))
    inner = F.get(F.array(*(F.array(*map(F.lit, g)) for g in groups)), group)
    return F.coalesce(group * width + below(inner), F.lit(-1))


def scan(df: DataFrame, value: Column, order: str, *ties: str, out: str = "scan", exclusive: bool = False, initial: float | int = 0) -> DataFrame:
    """Running sum in the order of a numeric column (and ties), over all rows.

    A window over all rows would run in one task. The order is cut into ranges instead: their
    sums are added up (a row for each range), and each range runs its own window.
    """
    cut = df.withColumn("_scan_v", value).withColumn("_scan_range", range_no(F.col(order), range_bounds(df, order)))
    sums = cut.groupBy("_scan_range").agg(F.sum("_scan_v").alias("_scan_sum"))
    before = sums.select("_scan_range", F.coalesce(F.sum("_scan_sum").over(Window.orderBy("_scan_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_scan_before"))
    inner = Window.partitionBy("_scan_range").orderBy(order, *ties)
    upto = F.coalesce(F.sum("_scan_v").over(inner.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)), F.lit(0))
    rows = cut.join(F.broadcast(before), "_scan_range")  # RANGES rows at most
    return rows.withColumn(out, F.lit(initial) + F.col("_scan_before") + upto).drop("_scan_v", "_scan_range", "_scan_before")


def scan_extended(df: DataFrame, value: Column, order: str, out: str = "scan") -> DataFrame:
    """Exclusive scan and the total as one more element: columns index (0..n) and scan."""
    inc = scan(scan(df, value, order, out=out), F.lit(1), order, out="_index")
    head = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("index"), F.lit(0).cast(inc.schema[out].dataType).alias(out))
    return head.unionByName(inc.select(F.col("_index").cast("long").alias("index"), out))


def scan_by_key(df: DataFrame, value: Column, key: str, order: str, out: str = "scan", exclusive: bool = False, initial: float | int = 0) -> DataFrame:
    """Running sums within each key, whether its rows are consecutive or not. Keys that hold more than their share of all rows are cut into ranges."""
    n = n_ranges(df)
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_all"))
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("_n") * (4 * n) > F.col("_all")).where("_n > 100000").select(F.col(key).alias("_hot"))  # fewer than 4 n keys
    rows = df.withColumn("_v", value)
    joined = rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left") if not hot.isEmpty() else rows.withColumn("_hot", F.lit(None).cast(df.schema[key].dataType))
    cut = joined.withColumn("_range", F.when(F.col("_hot").isNotNull(), range_no(F.col(order), range_bounds(df, order, n))).otherwise(0))
    sums = cut.where("_hot IS NOT NULL").groupBy(F.col(key).alias("_k"), F.col("_range").alias("_r")).agg(F.sum("_v").alias("_s"))
    before = sums.select("_k", "_r", F.coalesce(F.sum("_s").over(Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    w = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    upto = F.coalesce(F.sum("_v").over(w), F.lit(0))
    placed = cut.withColumn("_upto", upto).join(F.broadcast(before), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_range") == F.col("_r")), "left")  # a row for each hot key and range
    return placed.withColumn(out, F.lit(initial) + F.col("_upto") + F.coalesce("_before", F.lit(0))).drop("_v", "_hot", "_range", "_k", "_r", "_before", "_upto")


def neighbours(df: DataFrame, order: str, previous: dict[str, str]) -> DataFrame:
    """Adds, under each new name, a column's value in the row before (null in the first row), over all rows.

    Ranges run apart; the last row of each range is handed to the next one.
    """
    cut = df.withColumn("_range", range_no(F.col(order), range_bounds(df, order)))
    columns = list(previous.values())
    last = cut.groupBy("_range").agg(F.max_by(F.struct(*columns), order).alias("_last"))
    handed = last.select("_range", F.lag("_last").over(Window.orderBy("_range")).alias("_last"))
    w = Window.partitionBy("_range").orderBy(order)
    rows = cut.join(F.broadcast(handed), "_range").withColumn("_n", F.row_number().over(w))
    for new, column in previous.items():
        rows = rows.withColumn(new, F.when(F.col("_n") == 1, F.col(f"_last.{column}")).otherwise(F.lag(column).over(w)))
    return rows.drop("_range", "_last", "_n")


def runs(df: DataFrame, key: str, order: str) -> DataFrame:
    """Adds run, the number of the run of equal consecutive keys that a row is in (from 0).

    One window numbers the runs within each range; the ranges' ends (a row each) tell how many come before.
    """
    w = Window.partitionBy("_range").orderBy(order)
    cut = df.withColumn("_range", range_no(F.col(order), range_bounds(df, order)))
    marked = cut.withColumn("_changed", (~F.col(key).eqNullSafe(F.lag(key).over(w)) & (F.row_number().over(w) > 1)).cast("long"))
    local = cut_lineage(marked.withColumn("_local", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    ends = local.groupBy("_range").agg(F.min_by(F.struct(key), order).alias("_first"), F.max_by(F.struct(key), order).alias("_last"), F.max("_local").alias("_runs"))
    by = Window.orderBy("_range")
    new = F.when(F.lag("_last").over(by).isNull(), 0).otherwise((~F.col("_first").eqNullSafe(F.lag("_last").over(by))).cast("long"))
    ends = ends.select("_range", new.alias("_new"), F.coalesce(F.lag("_runs").over(by), F.lit(0)).alias("_before"))
    offsets = ends.select("_range", F.sum(F.col("_new") + F.col("_before")).over(by).alias("_offset"))
    return local.join(F.broadcast(offsets), "_range").withColumn("run", F.col("_offset") + F.col("_local")).drop("_range", "_changed", "_local", "_offset")  # RANGES rows at most


def reduce_by_run(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Sums over runs of equal consecutive keys: a key that comes again later is another group."""
    return runs(df, key, order).groupBy("run", key).agg(F.sum(value).alias("total"), F.min(order).alias("first"))


def unique_adjacent(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows whose key differs from the row before."""
    marked = neighbours(df, order, {"_before": key, "_before_order": order})
    return marked.where(F.col("_before_order").isNull() | ~F.col(key).eqNullSafe(F.col("_before"))).drop("_before", "_before_order")


def bounds_search(sorted_values: DataFrame, column: str, queries: DataFrame, query: str, upper: bool = False, out: str = "position") -> DataFrame:
    """For each query the number of values below it (upper: not above it), by one scan over both, not a theta join. Whole numbers are compared as such."""
    whole = all(df.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for df, c in ((sorted_values, column), (queries, query)))
    kind = "long" if whole else "double"
    side = 0 if upper else 1  # on ties, values come before the query, or after it
    values = sorted_values.select(F.col(column).cast(kind).alias("_k"), F.lit(side).alias("_side"), F.lit(1).alias("_one"), F.lit(None).cast(queries.schema).alias("_q"))
    asked = queries.select(F.col(query).cast(kind).alias("_k"), F.lit(1 - side).alias("_side"), F.lit(0).alias("_one"), F.struct("*").alias("_q"))
    both = values.unionByName(asked)
    return scan(both, F.col("_one"), "_k", "_side", out="_n").where("_q IS NOT NULL").select("_q.*", F.col("_n").cast("long").alias(out))


def is_monotonic(df: DataFrame, column: str, order: str) -> DataFrame:
    marked = neighbours(df, order, {"_before": column})
    up, down = F.col(column) >= F.col("_before"), F.col(column) <= F.col("_before")
    return marked.agg(F.coalesce(F.bool_and(up), F.lit(True)).alias("increasing"), F.coalesce(F.bool_and(down), F.lit(True)).alias("decreasing"))


def copy_subrange(df: DataFrame, index: str, start: int, count: int, offset: int) -> DataFrame:
    return df.where(F.col(index).between(start, start + count - 1)).withColumn(index, F.col(index) - start + offset)


def zip_rows(a: DataFrame, b: DataFrame, a_order: str, b_order: str) -> DataFrame:
    """Rows of equal rank side by side."""
    left = scan(a, F.lit(1), a_order, out="_i")
    right = scan(b, F.lit(1), b_order, out="_i")
    return left.join(right, "_i").withColumn("index", (F.col("_i") - 1).cast("long")).drop("_i")
