"""The order of a track, and times as numbers."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def track(*keys: str) -> WindowSpec:
    """A vessel's (or other key's) pings in time order, ties by rec_id."""
    return W.partitionBy(*(keys or ("vessel_id",))).orderBy("time_stamp", "rec_id")


def so_far(*keys: str) -> WindowSpec:
    return track(*keys).rowsBetween(W.unboundedPreceding, 0)


def micros(time: Column | str) -> Column:
    """Microseconds since 1970 (sessions run in UTC)."""
    return F.unix_micros((F.col(time) if isinstance(time, str) else time).cast("timestamp"))


def seconds_between(early: Column, late: Column) -> Column:
    return (micros(late) - micros(early)) / F.lit(1e6)
