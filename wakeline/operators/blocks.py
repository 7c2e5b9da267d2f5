"""Windows along tracks for vessels too long for one task: within blocks of time, with what a block hands on.

A block of a vessel is a stretch of time, so a hot vessel's rows are spread over its blocks. What the
next block needs from those before it, the last row's values or the sum so far, is one row a block; only
these meet by vessel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import arcdist, trip_key
from ..functions.order import micros, seconds_between, so_far, track

DAY = 86_400.0


def _placed(df: DataFrame, seconds: float) -> DataFrame:
    return df.withColumn("_block", F.floor(micros("time_stamp") / F.lit(seconds * 1e6)).cast("long"))


def _handed_on(d: DataFrame, each: Column, carried: Column, keys: tuple[str, ...]) -> DataFrame:
    """``d`` with ``_carry`` of each row's block: ``carried``, over a key's blocks in order, of ``each``, an aggregate named ``_own``."""
    own = d.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_block").alias("_b")).agg(each.alias("_own"))
    names = [f"_k{i}" for i in range(len(keys))]
    own = own.select(*names, "_b", carried.over(W.partitionBy(*names).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_carry"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return d.join(own, same).drop("_b", *names)


def lagged(df: DataFrame, columns: dict[str, str], seconds: float = DAY, keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """For each ``new: column`` the value at the ping before, null at a track's first."""
    d = _placed(df, seconds)
    row = F.struct(*(F.col(c).alias(n) for n, c in columns.items()))
    d = _handed_on(d, F.max_by(row, F.struct("time_stamp", "rec_id")), F.last("_own"), keys)
    w = track(*keys, "_block")
    d = d.withColumn("_before", F.when(F.row_number().over(w) == 1, F.col("_carry")).otherwise(F.lag(row).over(w)))
    return d.select(*df.columns, *(F.col(f"_before.{n}").alias(n) for n in columns))


def running_sum(df: DataFrame, value: str, out: str, seconds: float = DAY, keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """``out``: the sum of ``value`` up to and with each ping; null counts as 0."""
    d = _handed_on(_placed(df, seconds), F.coalesce(F.sum(value), F.lit(0)), F.sum("_own"), keys)
    return d.select(*df.columns, (F.coalesce("_carry", F.lit(0)) + F.coalesce(F.sum(value).over(so_far(*keys, "_block")), F.lit(0))).alias(out))


def events(df: DataFrame, col: str, out: str = "event", seconds: float = DAY, keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """As ``track.rb_event``."""
    d = lagged(df, {"_was": col}, seconds, keys)
    d = d.withColumn("_new", F.coalesce((F.col(col) != F.col("_was")).cast("int"), F.lit(1)))
    return running_sum(d, "_new", out, seconds, keys).drop("_was", "_new")


def define_trips(df: DataFrame, harbour: str = "hid", seconds: float = DAY) -> DataFrame:
    """As ``track.rb_define_trips``."""
    runs = events(df.withColumn("_in", F.coalesce(F.col(harbour) != 0, F.lit(False))), "_in", "_run", seconds)
    n = F.floor((F.col("_run") + 1) / 2).cast("long")
    return runs.withColumn("trip", F.when(F.col("_in"), -n).otherwise(n)).drop("_in", "_run")


def trips_by_gap(df: DataFrame, gap_sec: int = 10_800, seconds: float = DAY) -> DataFrame:
    """As ``trips.trips_by_gap``."""
    d = lagged(df, {"_at": "time_stamp"}, seconds)
    d = d.withColumn("_cut", F.coalesce((seconds_between(F.col("_at"), F.col("time_stamp")) >= gap_sec).cast("int"), F.lit(0)))
    d = running_sum(d, "_cut", "_n", seconds)
    return d.withColumn("vessel_trip", trip_key(F.col("vessel_id"), F.col("_n") + 1)).drop("_at", "_cut", "_n")


def segments_by_distance(df: DataFrame, max_m: float = 1000.0, seconds: float = DAY) -> DataFrame:
    """As ``trips.segments_by_distance``."""
    d = lagged(df, {"_lon": "lon", "_lat": "lat"}, seconds)
    step = arcdist(F.col("_lon"), F.col("_lat"), F.col("lon"), F.col("lat"), "km") * 1000
    d = running_sum(d.withColumn("_cut", F.coalesce((step > max_m).cast("int"), F.lit(0))), "_cut", "segment", seconds)
    return d.withColumn("segment", (F.col("segment") + 1).cast("long")).drop("_lon", "_lat", "_cut")


def trips_cumulative(df: DataFrame, seconds: float = DAY, blocks: int = 200) -> DataFrame:
    """As ``trips.trips_cumulative``, a vessel's own count by blocks too."""
    from .trips import harbour_offsets

    d = running_sum(df, "SI_HARB", "_own", seconds).join(harbour_offsets(df, blocks), "vessel_id")
    return d.withColumn("trip", F.when(F.col("SI_HARB") == 1, F.lit(1)).otherwise(F.col("_base") + F.col("_own")).cast("long")).drop("_own", "_base")
