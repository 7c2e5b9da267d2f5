"""Filters and deduplication of pings. Ties in time are broken by rec_id, the lowest first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import KNOTS_PER_MS
from ..functions.runs import whole_groups


def filter_extent(df: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """Strictly within; drops 0, 0 fixes and nulls with it."""
    return df.filter((F.col("lat") > lat_min) & (F.col("lat") < lat_max) & (F.col("lon") > lon_min) & (F.col("lon") < lon_max))


def filter_behaviour(df: DataFrame, label: str = "Fishing") -> DataFrame:
    return df.filter(F.col("behaviour") == label)


def _first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def dedupe_time(df: DataFrame, how: str = "first") -> DataFrame:
    """One ping per vessel and time: the first, or one of mean position and speed."""
    if how == "first":
        return _first(df, ["vessel_id", "time_stamp"], ["rec_id"])
    if how != "mean":
        raise ValueError(f"how must be first or mean, not {how!r}")
    mean, rest = ("lon", "lat", "speed"), [c for c in df.columns if c not in ("vessel_id", "time_stamp", "lon", "lat", "speed", "rec_id")]
    return df.groupBy("vessel_id", "time_stamp").agg(F.min("rec_id").alias("rec_id"), *[F.avg(c).alias(c) for c in mean], *[F.min_by(c, "rec_id").alias(c) for c in rest])


def dedupe_position(df: DataFrame) -> DataFrame:
    """The first ping of a vessel at each position, over the whole track."""
    return _first(df, ["vessel_id", "lon", "lat"], ["time_stamp", "rec_id"])


def dedupe_exact(df: DataFrame) -> DataFrame:
    """Distinct rows, then one per vessel, time and position."""
    return _first(df.distinct(), ["vessel_id", "time_stamp", "lon", "lat"], ["rec_id"])


def filter_speed(df: DataFrame, lo: float = 0.1, hi: float = 12.0) -> DataFrame:
    return df.filter(F.col("speed").between(lo, hi))


def flag_speed_sd(df: DataFrame, k: float = 5.0) -> DataFrame:
    """``speed_outlier``: above mean plus k standard deviations of the whole table."""
    limit = df.agg((F.avg("speed") + k * F.stddev_samp("speed")).alias("_limit"))
    return df.join(F.broadcast(limit)).withColumn("speed_outlier", F.coalesce(F.col("speed") > F.col("_limit"), F.lit(False))).drop("_limit")


def smooth_speed(df: DataFrame, n: int = 5, lo: float = 0.1, hi: float = 12.0) -> DataFrame:
    """Speeds out of range become the mean of the good ones among the n pings around."""
    w = W.partitionBy("vessel_id").orderBy("time_stamp", "rec_id").rowsBetween(-(n // 2), n // 2)
    good = F.when(F.col("speed").between(lo, hi), F.col("speed"))
    return df.withColumn("_mean", F.avg(good).over(w)).withColumn("speed", F.coalesce(good, F.col("_mean"))).drop("_mean")


def null_bad_course(df: DataFrame) -> DataFrame:
    return df.withColumn("course", F.when(F.col("course") <= 360, F.col("course")))


def complete_cases(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.na.drop(subset=cols)


def rename_select(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"vessel_id": "vid", "time_stamp": "time"}).select("vid", "time", "lon", "lat", "speed", "rec_id")


def filter_part(df: DataFrame, vessel: str | None = None, trip: str | None = None, day: int | None = None) -> DataFrame:
    """One vessel, trip or day of the month."""
    tests: list[Column] = [F.col(c) == v for c, v in (("vessel_id", vessel), ("trip_id", trip)) if v is not None]
    if day is not None:
        tests.append(F.dayofmonth("time_stamp") == day)
    for t in tests:
        df = df.filter(t)
    return df


def slow_enough(sec: np.ndarray, x: np.ndarray, y: np.ndarray, bounds: np.ndarray, vmax: float) -> np.ndarray:
    """Which pings stay when those whose step to the next of their burst is too fast go, again and again.

    All bursts (``bounds``) are passed over at once. After the first pass only the pings before removed
    ones are tested again, so the work is the number of pings and of removals, whatever the passes.
    """
    n = len(sec)
    stays = np.ones(n, bool)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    filled = np.diff(bounds) > 0
    after[bounds[1:][filled] - 1], before[bounds[:-1][filled]] = -1, -1
    at = np.flatnonzero(after >= 0)
    while len(at):
        to = after[at]
        dt, dist = sec[to] - sec[at], np.hypot(x[to] - x[at], y[to] - y[at])
        with np.errstate(divide="ignore", invalid="ignore"):
            gone = at[dist / dt * KNOTS_PER_MS > vmax]
        if not len(gone):
            break
        stays[gone] = False
        # Removed pings in a row: the one before the first is now followed by the one after the last.
        breaks = after[gone[:-1]] != gone[1:]
        left, right = before[gone[np.append(True, breaks)]], after[gone[np.append(breaks, True)]]
        has = left >= 0
        before[right] = left
        after[left[has]] = right[has]
        at = left[has]
    return stays


def remove_fast_steps(df: DataFrame, burst: str = "burst", vmax: float = 25.0, rows: int = 100_000) -> DataFrame:
    """Drops pings from which the step to the next one of the burst is faster than vmax knots, until none is. Needs x, y in metres.

    A task streams its bursts in order and tests some ``rows`` pings of many bursts at once; a burst (a
    vessel's day) must fit a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, found in whole_groups(batches, rows, burst):
            sec = table["time_stamp"].combine_chunks().cast(pa.timestamp("us")).cast(pa.int64()).to_numpy() / 1e6
            x, y = (table[c].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in "xy")
            yield from table.filter(pa.array(slow_enough(sec, x, y, found, vmax))).to_batches()

    return df.repartition(burst).sortWithinPartitions(burst, "time_stamp", "rec_id").mapInArrow(run, df.schema)
