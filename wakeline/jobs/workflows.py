"""The three workloads end to end: harbour trips, day trips, behaviour models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import to_utm
from ..operators import clean, covariates, interpolate, joins, ml, track, trips
from ..sources import tables
from ..sources.scratch import staged

ZONE = 32


def harbour_trips(spark: SparkSession, sf_dir: str, min_dur: float = 0.8, max_dur: float = 8.0) -> DataFrame:
    """Dedupe, flag harbour, fill gaps, cut trips, schedule: one exchange on the vessel, and one scan of the pings."""
    p = clean.dedupe_time(tables.pings(spark, sf_dir).repartition("vessel_id"))
    filled = interpolate.interpolate_ais(joins.add_harbours(p, tables.harbours(spark, sf_dir)))
    needed = filled.select("vessel_id", "time_stamp", "rec_id", "SI_HARB")
    return trips.with_hours(trips.trip_intervals(needed, min_dur, max_dur))


def day_trips(spark: SparkSession, sf_dir: str, vmax: float = 25.0, hours: float = 1.0) -> DataFrame:
    """Registry, extent, dedupe, land, bursts by day, fast steps out, summary of bursts that are not short."""
    t, trip, device = tables.registry(spark, sf_dir)
    d = clean.filter_extent(joins.attach_registry(t, trip, device), 54, 60, 9, 16).repartition("vessel_id")
    d = joins.remove_land(clean.dedupe_position(clean.dedupe_time(d)), tables.coast(spark, sf_dir), ZONE)
    x, y = to_utm(F.col("lon"), F.col("lat"), ZONE)
    d = trips.trips_by_day(d.withColumns({"x": x, "y": y})).select("rec_id", "time_stamp", "burst", "x", "y")
    travelled = trips.trip_summary(track.ltraj_steps(clean.remove_fast_steps(d, "burst", vmax)))
    return travelled.filter(F.coalesce(F.col("time_travelled"), F.lit(0.0)) >= hours)


FEATURES = ["speed", "course", "heading_deg", "abs_heading_change", "acceleration", *[f"dist_neighbour_{i}" for i in range(1, 10)]]


def covariate_table(spark: SparkSession, sf_dir: str, k: int = 9) -> DataFrame:
    """Covariates of all usable pings of each vessel's days; null where a day has too few neighbours."""
    p = clean.dedupe_time(tables.pings(spark, sf_dir)).withColumn("trip_id", F.concat_ws("_", "vessel_id", F.dayofmonth("time_stamp").cast("string")))
    return covariates.trip_covariates(p, k)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates of the pings of each vessel's days that have enough neighbours."""
    return clean.complete_cases(covariate_table(spark, sf_dir), FEATURES)


def forest_out_of_bag(spark: SparkSession, sf_dir: str, trees: int = 500) -> DataFrame:
    """``predicted, actual, n`` of a forest's out-of-bag votes, and ``error``, the share of all rows with votes that are wrong."""
    rows = staged(features(spark, sf_dir))
    conf = staged(ml.confusion(ml.out_of_bag_votes(rows, FEATURES, trees=trees).filter("predicted is not null")), "confusion", narrow=True)
    total = conf.agg((1 - F.sum(F.when(F.col("predicted") == F.col("actual"), F.col("n")).otherwise(0)) / F.sum("n")).alias("error"))  # a row
    return conf.join(F.broadcast(total)).withColumn("error", F.round("error", 6))


def behaviour_folds(spark: SparkSession, sf_dir: str, trees: int = 100) -> DataFrame:
    """Accuracy and kappa of forest, LDA and QDA over trip folds."""
    done = ml.cross_validate(staged(features(spark, sf_dir)), FEATURES, trees=trees)
    return ml.overall(ml.confusion(done, by=["model"]), ["model"])
