"""Filling gaps in tracks by points about a minute apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import arcdist, lon_lat_ratio
from ..functions.order import micros, track

KM_PER_NMI = 1.852


def union_fill(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both; columns that one lacks are null."""
    return a.unionByName(b, allowMissingColumns=True)


def _hermite(t: Column, a: Column, b: Column, ta: Column, tb: Column) -> Column:
    t2, t3 = t * t, t * t * t
    return (2 * t3 - 3 * t * t + 1) * a + (3 * t * t - 2 * t3) * b + (t3 - 2 * t2 + t) * ta + (t3 - t2) * tb


def interpolate_ais(df: DataFrame, min_gap: float = 2.0, max_gap: float = 120.0, heading_adjustment: int = 0) -> DataFrame:
    """Pings and the points put between them where ``min_gap < gap <= max_gap`` minutes and not both ends are in harbour.

    Positions follow a cubic Hermite curve where both courses are known, else a line; time and speed
    are linear. New points have ``source`` INT, ``SI_HARB`` 0, and nulls in columns other than the
    vessel, time, position and speed. A speed missing at an end of a gap becomes the segment's, and
    stays on the ping where it is the start.
    """
    w = track()
    nxt = lambda c: F.lead(c).over(w)
    d = df if "source" in df.columns else df.withColumn("source", F.lit("AIS"))
    d = d.withColumns({"_t": micros("time_stamp"), **{f"_{c}": nxt(c) for c in ("time_stamp", "lon", "lat", "speed", "course", "SI_HARB")}})
    gap = (micros("_time_stamp") - F.col("_t")) / F.lit(6e7)
    d = d.withColumn("_gap", gap)
    d = d.withColumn("_fill", F.coalesce((F.col("_gap") > min_gap) & (F.col("_gap") <= max_gap) & ~((F.col("SI_HARB") == 1) & (F.col("_SI_HARB") == 1)), F.lit(False)))
    # Only gaps with an end that lacks a speed need the segment's.
    lon = F.when(F.col("_fill") & (F.col("speed").isNull() | F.col("_speed").isNull()), F.col("lon"))
    km = arcdist(lon, F.col("lat"), F.col("_lon"), F.col("_lat"), "km")
    d = d.withColumn("_whole", km / F.col("_gap") * 60 / KM_PER_NMI)
    d = d.withColumns({"speed": F.coalesce("speed", "_whole"), "_speed": F.coalesce("_speed", "_whole")})
    own = [c for c in d.columns if not c.startswith("_")]

    # What holds for a whole gap is computed before its points are made.
    scale = F.col("_gap") / 150.0
    start, end = F.radians("course"), F.radians("course" if heading_adjustment == 1 else "_course")
    reach = lambda v: scale * v / 17.5
    d = d.withColumns({
        "_n": F.ceil("_gap"), "_curved": F.col("course").isNotNull() & F.col("_course").isNotNull(),
        "_xa": F.sin(start) * reach(F.col("speed")), "_xb": F.sin(end) * reach(F.col("_speed")),
        "_ya": F.cos(start) * reach(F.col("speed")) * lon_lat_ratio(F.col("lat")), "_yb": F.cos(end) * reach(F.col("_speed")) * lon_lat_ratio(F.col("_lat")),
    })
    d = d.withColumn("_i", F.explode(F.when(F.col("_fill") & (F.col("_n") > 2), F.sequence(F.lit(0).cast("long"), F.col("_n") - 2)).otherwise(F.array(F.lit(0).cast("long")))))
    d = d.withColumn("_u", F.try_divide("_i", F.col("_n") - 1))
    t = F.col("_u")
    line = lambda a, b: a + (b - a) * t
    lon = _hermite(t, F.col("lon"), F.col("_lon"), F.col("_xa"), F.col("_xb"))
    lat = _hermite(t, F.col("lat"), F.col("_lat"), F.col("_ya"), F.col("_yb"))
    curved = F.col("_curved")
    made = {
        "vessel_id": F.col("vessel_id"), "time_stamp": F.timestamp_micros((F.col("_t") + F.round(F.col("_gap") * F.lit(6e7) * t)).cast("long")).cast(df.schema["time_stamp"].dataType),
        "lon": F.when(curved, lon).otherwise(line(F.col("lon"), F.col("_lon"))), "lat": F.when(curved, lat).otherwise(line(F.col("lat"), F.col("_lat"))),
        "speed": line(F.col("speed"), F.col("_speed")), "source": F.lit("INT"), "SI_HARB": F.lit(0),
    }
    return d.select(*[F.when(F.col("_i") == 0, F.col(c)).otherwise(made.get(c, F.lit(None))).alias(c) for c in own])
