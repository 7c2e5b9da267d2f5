"""Window functions along tracks: intervals, steps, speeds, turns, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import KNOTS_PER_MS, arcdist, bearing, haversine_m
from ..functions.order import seconds_between, so_far, track

NMI_PER_M = 0.539957 / 1000
MS_PER_KNOT = 1852 / 3600


def ping_interval(df: DataFrame) -> DataFrame:
    """``gap_sec`` since the previous ping."""
    return df.withColumn("gap_sec", seconds_between(F.lag("time_stamp").over(track()), F.col("time_stamp")))


def duration_distance_speed2(df: DataFrame) -> DataFrame:
    """From the previous ping: ``duration`` (s), ``distance`` (m, by arc), ``speed2`` (m/s)."""
    w = track()
    metres = arcdist(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"), "km") * 1000
    out = df.withColumns({"duration": seconds_between(F.lag("time_stamp").over(w), F.col("time_stamp")), "distance": metres})
    return out.withColumn("speed2", F.try_divide("distance", "duration"))


def rb_event(df: DataFrame, col: str, out: str = "event", keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """Counts up, from 1, whenever the value differs from the one before; a null differs from everything."""
    changed = F.coalesce((F.col(col) != F.lag(col).over(track(*keys))).cast("int"), F.lit(1))
    return df.withColumn("_new", changed).withColumn(out, F.sum("_new").over(so_far(*keys)).cast("long")).drop("_new")


def rb_define_trips(df: DataFrame, harbour: str = "hid") -> DataFrame:
    """``trip``: number of the run at sea, or minus that of the run in harbour (null or 0: at sea)."""
    inside = F.coalesce(F.col(harbour) != 0, F.lit(False))
    runs = rb_event(df.withColumn("_in", inside), "_in", "_run")
    n = F.floor((F.col("_run") + 1) / 2).cast("long")
    return runs.withColumn("trip", F.when(F.col("_in"), -n).otherwise(n)).drop("_in", "_run")


def rb_speed(df: DataFrame) -> DataFrame:
    """``speed_next``: knots to the next ping."""
    w = track()
    metres = arcdist(F.col("lon"), F.col("lat"), F.lead("lon").over(w), F.lead("lat").over(w), "km") * 1000
    return df.withColumn("speed_next", F.try_divide(metres, seconds_between(F.col("time_stamp"), F.lead("time_stamp").over(w))) * KNOTS_PER_MS)


def _wrapped(angle: Column) -> Column:
    return F.pmod(angle + 180.0, F.lit(360.0)) - 180.0


def step_turn(df: DataFrame) -> DataFrame:
    """``step`` in km to the next ping (the last takes the one before), ``angle`` in radians turned at the ping."""
    w = track()
    step = haversine_m(F.col("lon"), F.col("lat"), F.lead("lon").over(w), F.lead("lat").over(w)) / 1000
    into = bearing(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    out = bearing(F.col("lon"), F.col("lat"), F.lead("lon").over(w), F.lead("lat").over(w))
    df = df.withColumns({"step": step, "angle": F.radians(_wrapped(out - into))})
    return df.withColumn("step", F.coalesce("step", F.last("step", ignorenulls=True).over(so_far())))


def calc_dist(df: DataFrame, keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """``DISTANCE.nm`` as ``distance_nm``, from the previous ping; the first 0."""
    w = track(*keys)
    metres = haversine_m(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat"))
    return df.withColumn("distance_nm", F.coalesce(metres * NMI_PER_M, F.lit(0.0)))


def calc_speed(df: DataFrame, keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """``difftime_secs`` and ``speed_kn`` from the previous ping; the first 0 and 0."""
    df = df if "distance_nm" in df.columns else calc_dist(df, keys)
    first = F.lag("rec_id").over(track(*keys)).isNull()
    df = df.withColumn("difftime_secs", F.when(first, 0.0).otherwise(seconds_between(F.lag("time_stamp").over(track(*keys)), F.col("time_stamp"))))
    return df.withColumn("speed_kn", F.when(first, 0.0).otherwise(F.try_divide(F.col("distance_nm") * 3600, F.col("difftime_secs"))))


def calc_acceleration(df: DataFrame, speed: str = "speed", knots: bool = True, keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """``acceleration``: speed in m/s over the time since the previous ping; the first 0."""
    w = track(*keys)
    ms = F.col(speed) * MS_PER_KNOT if knots else F.col(speed)
    value = F.try_divide(ms, seconds_between(F.lag("time_stamp").over(w), F.col("time_stamp")))
    return df.withColumn("acceleration", F.when(F.lag("rec_id").over(w).isNull(), 0.0).otherwise(value))


def calc_straightness(df: DataFrame, col: str = "course", keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """``abs_heading_change``, not wrapped; the first 1."""
    w = track(*keys)
    return df.withColumn("abs_heading_change", F.when(F.lag("rec_id").over(w).isNull(), 1.0).otherwise(F.abs(F.col(col) - F.lag(col).over(w))))


def calc_heading(df: DataFrame, keys: tuple[str, ...] = ("vessel_id",)) -> DataFrame:
    """``heading_deg`` from the previous ping to this, 0 to 360; the first 0."""
    w = track(*keys)
    return df.withColumn("heading_deg", F.coalesce(bearing(F.lag("lon").over(w), F.lag("lat").over(w), F.col("lon"), F.col("lat")), F.lit(0.0)))


def ltraj_steps(df: DataFrame, burst: str = "burst") -> DataFrame:
    """``dist``, ``dt`` to the next ping of the burst, and ``step_speed`` in knots. Needs x, y in metres."""
    w = track(burst)
    dist = F.hypot(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y"))
    df = df.withColumns({"dist": dist, "dt": seconds_between(F.col("time_stamp"), F.lead("time_stamp").over(w))})
    return df.withColumn("step_speed", F.try_divide("dist", "dt") * KNOTS_PER_MS)


def sort_track(df: DataFrame, whole: bool = False) -> DataFrame:
    """In order within partitions, each vessel in one; ``whole``: the table in one total order."""
    return df.orderBy("vessel_id", "time_stamp", "rec_id") if whole else df.repartition("vessel_id").sortWithinPartitions("vessel_id", "time_stamp", "rec_id")


def row_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({"id": F.row_number().over(track()).cast("long"), "year": F.year("time_stamp").cast("long")})


def fill_forward(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.last(col, ignorenulls=True).over(so_far()))
