"""Histograms, entropy and descriptive statistics of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(value: Column, low: Column, delta: Column, n_bins: int) -> Column:
    """Bin by truncation, clamped into [0, n_bins - 1]; a constant field falls in bin 0."""
    raw = F.coalesce(F.try_divide(value - low, delta), F.lit(0.0))
    return F.least(F.greatest(raw.cast("bigint"), F.lit(0)), F.lit(n_bins - 1)).cast("bigint")


def histogram(df: DataFrame, field: str, n_bins: int = 10, value_range: tuple[float, float] | None = None) -> DataFrame:
    """Equal-width counts; every bin is present. Nulls and NaN are left out."""
    x = F.col(field).cast("double")
    data = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    spark = df.sparkSession
    if value_range is None:
        bounds = data.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    else:
        bounds = spark.range(1).select(F.lit(float(value_range[0])).alias("low"), F.lit(float(value_range[1])).alias("high"))
    bounds = bounds.select("low", ((F.col("high") - F.col("low")) / n_bins).alias("delta"))
    counts = (
        data.crossJoin(F.broadcast(bounds))  # one row
        .select(bin_of(F.col("x"), F.col("low"), F.col("delta"), n_bins).alias("bin"))
        .groupBy("bin")
        .agg(F.count("*").alias("n"))
    )
    bins = spark.range(n_bins).select(F.col("id").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("freq"))
