"""Windows by blocks of time against whole windows; sketches against exact figures; the stored layout."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wakeline.operators import blocks, joins, sketches, track, trips
from wakeline.sources import tables

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def pings(spark):
    draw, rows = random.Random(2), []
    for v, n in (("hot", 600), ("a", 200), ("b", 1), ("c", 90), (None, 40)):
        sec = draw.uniform(0, 50_000)
        for _ in range(n):
            sec += draw.choice([0, 10, 600, 4000, 11_000, 200_000])  # some blocks are empty
            rows.append((len(rows), v, T0 + dt.timedelta(seconds=round(sec)), 10 + draw.random() / 50, 55.0, draw.choice([0, 0, 0, 1]), draw.choice([None, "F", "F", "S"])))
    return spark.createDataFrame(rows, "rec_id long, vessel_id string, time_stamp timestamp, lon double, lat double, SI_HARB int, behaviour string").repartition(5).persist()


def rows_of(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("seconds", [3600.0, 86_400.0, 1e9])
def test_blocks_equal_windows(pings, seconds):
    for whole, parts in (
        (track.rb_event(pings, "behaviour"), blocks.events(pings, "behaviour", seconds=seconds)),
        (track.rb_define_trips(pings, "SI_HARB"), blocks.define_trips(pings, "SI_HARB", seconds)),
        (trips.trips_by_gap(pings), blocks.trips_by_gap(pings, seconds=seconds)),
        (trips.segments_by_distance(pings), blocks.segments_by_distance(pings, seconds=seconds)),
        (trips.trips_cumulative(pings), blocks.trips_cumulative(pings, seconds)),
    ):
        assert whole.columns == parts.columns and rows_of(whole) == rows_of(parts)
    assert blocks.events(pings.limit(0), "behaviour").count() == 0


def test_a_hot_vessel_is_spread(spark, pings):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sums = blocks.running_sum(pings, "SI_HARB", "n").withColumn("part", F.spark_partition_id()).filter("vessel_id = 'hot'")
        assert len({r.part for r in sums.select("part", "n").collect()}) >= 4
        whole = track.rb_event(pings, "SI_HARB").withColumn("part", F.spark_partition_id()).filter("vessel_id = 'hot'")
        assert len({r.part for r in whole.select("part", "event").collect()}) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sketches_roll_up(spark):
    df = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("v"), F.col("id") % 700)).alias("vessel_id"), (F.col("id") % 11).alias("day"),
        F.when(F.col("id") % 13 == 0, None).when(F.col("id") % 17 == 0, F.lit(float("nan"))).otherwise(F.pow(F.rand(3), F.lit(2.0)) * 30).alias("speed"), F.lit(None).cast("double").alias("none"),
    ).persist()
    fine = sketches.sketched(df, ["vessel_id", "day"], ["speed", "none"], ["vessel_id"])
    by_vessel = sketches.rolled_up(fine, ["vessel_id"])
    for got, keys in ((sketches.rolled_up(fine, ["vessel_id"]), ["vessel_id"]), (sketches.rolled_up(by_vessel, []), []), (sketches.sketched(df, [], ["speed", "none"], ["vessel_id"]), [])):
        read = {tuple(r[k] for k in keys): r for r in sketches.read_off(got, keys).collect()}
        known = df.filter("not isnan(speed) and speed is not null")
        exact = {tuple(r[k] for k in keys): r for r in known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("speed").alias("mean"), F.min("speed").alias("least"), F.max("speed").alias("most"), F.array_sort(F.collect_list("speed")).alias("all")).collect()}
        assert read.keys() == exact.keys()
        for key, r in read.items():
            e = exact[key]
            assert r.n - r.speed_nulls == e.n and r.speed_mean == pytest.approx(e.mean) and (r.speed_q0, r.speed_q100) == (e.least, e.most)
            for q in (25, 50, 75):
                rank = sum(v <= r[f"speed_q{q}"] for v in e.all) / e.n
                assert abs(rank - q / 100) < 0.01 + 1 / e.n
            assert r.none_q50 is None and r.none_nulls == r.n
        if not keys:
            assert read[()].vessel_id_distinct == pytest.approx(df.select("vessel_id").distinct().count(), rel=0.05)
    assert sketches.read_off(sketches.rolled_up(fine.limit(0), ["vessel_id"]), ["vessel_id"]).count() == 0


def exchanges(df):
    df.write.format("noop").mode("overwrite").save()
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange")


def test_windows_on_the_stored_track_need_no_exchange(spark, pings, tmp_path):
    pings = pings.withColumns({"speed": F.lit(1.0), "course": F.lit(2.0), "x": F.col("lon"), "y": F.col("lat"), "hid": F.col("SI_HARB")})
    stored = tables.store_track(pings, "stored_track_of_test", str(tmp_path / "track"), 4)
    try:
        assert rows_of(stored.select(*pings.columns)) == rows_of(pings)
        for f in (
            track.ping_interval, track.duration_distance_speed2, lambda d: track.rb_event(d, "behaviour"), track.rb_define_trips, track.rb_speed, track.step_turn, track.calc_dist, track.calc_speed,
            track.calc_acceleration, track.calc_straightness, track.calc_heading, lambda d: track.ltraj_steps(d, "vessel_id"), track.row_ids, lambda d: track.fill_forward(d, "behaviour"),
        ):
            assert exchanges(f(stored)) == 0 and exchanges(f(pings)) > 0
        assert exchanges(stored.groupBy("vessel_id").count()) == 0
        assert joins.assign_trips(stored, trips.trip_intervals(stored)).count() >= 0
    finally:
        spark.sql("DROP TABLE stored_track_of_test")
