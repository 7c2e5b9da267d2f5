"""Pings as they arrive: deduplicated, flagged and cut into trips by gaps, with the batch operators where they apply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import add_harbours


def live_positions(stream: DataFrame, harbours: DataFrame, late: str = "1 hour") -> DataFrame:
    """One ping per vessel and time, with ``SI_HARB``; pings later than ``late`` may be dropped, as a stream must."""
    once = stream.withWatermark("time_stamp", late).dropDuplicatesWithinWatermark(["vessel_id", "time_stamp"])
    return add_harbours(once, harbours)


def live_trips(stream: DataFrame, gap: str = "3 hours", late: str = "1 hour") -> DataFrame:
    """``vessel_id, depart, return, n_pings`` of trips that end with a gap of that length or more, once they are over."""
    trip = stream.withWatermark("time_stamp", late).groupBy("vessel_id", F.session_window("time_stamp", gap))
    return trip.agg(F.min("time_stamp").alias("depart"), F.max("time_stamp").alias("return"), F.count("*").alias("n_pings")).drop("session_window")
