"""Checks over whole tables: counts, ranges, gaps, duplicates, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequencies, nulls included."""
    return df.groupBy(col).agg(F.count("*").alias("n"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(a, b).agg(F.count("*").alias("n"))


def extent(df: DataFrame) -> DataFrame:
    return df.agg(*[f(c).alias(f"{name}_{c}") for c in ("lon", "lat", "time_stamp") for name, f in (("min", F.min), ("max", F.max))])


def summary_stats(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    """Min, quartiles, mean, max and number of nulls."""
    share = F.percentile_approx if approximate else F.percentile
    return df.agg(
        F.min(col).alias("min"), share(col, F.lit(0.25)).alias("q1"), share(col, F.lit(0.5)).alias("median"), F.avg(col).alias("mean"),
        share(col, F.lit(0.75)).alias("q3"), F.max(col).alias("max"), F.count_if(F.col(col).isNull()).alias("n_null"),
    )


def distinct_gaps(df: DataFrame) -> DataFrame:
    """Which differences between successive times each vessel has, in seconds."""
    w = W.partitionBy("vessel_id").orderBy("time_stamp", "rec_id")
    gap = F.unix_micros(F.col("time_stamp").cast("timestamp")) - F.unix_micros(F.lag("time_stamp").over(w).cast("timestamp"))
    return df.select("vessel_id", (gap / 1e6).alias("gap_sec")).filter("gap_sec is not null").distinct()


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """``bin`` (from 1) and ``n``; even bins from least to greatest value, the greatest in the last."""
    ends = df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    bin_ = F.least(F.lit(bins), F.floor((F.col(col) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))) + 1)
    return df.filter(F.col(col).isNotNull()).select(col).join(F.broadcast(ends)).groupBy(F.coalesce(bin_, F.lit(1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def sample_pings(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """n rows in the order of a seeded hash of their ids, so the same ones each time."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col("rec_id").cast("string"), F.lit(str(seed)))), "rec_id").limit(n)


def count_distinct(df: DataFrame, col: str, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(col) if approximate else F.count_distinct(col)).alias("n"))
