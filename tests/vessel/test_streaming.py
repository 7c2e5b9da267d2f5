"""Streams give what the batch operators give."""

import datetime as dt

from pyspark.sql import functions as F

from wakeline.operators import trips
from wakeline.sources import tables
from wakeline.streaming import positions

SF = "/root/testdata/sf0.001"


def drained(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    query.processAllAvailable()
    query.stop()
    return stream.sparkSession.table(name)


def test_streams_equal_batches(spark, tmp_path):
    pings = tables.pings(spark, SF).withColumn("time_stamp", F.col("time_stamp").cast("timestamp"))
    end = spark.createDataFrame([(10**9, "LAST", dt.datetime(2030, 1, 1))], "rec_id long, vessel_id string, time_stamp timestamp")
    pings.select("rec_id", "vessel_id", "time_stamp", "lon", "lat").unionByName(end, allowMissingColumns=True).write.parquet(f"{tmp_path}/p")
    read = lambda: spark.readStream.schema("rec_id long, vessel_id string, time_stamp timestamp, lon double, lat double").parquet(f"{tmp_path}/p")
    live = drained(positions.live_positions(read(), tables.harbours(spark, SF), "3000 days"), "live")
    assert live.filter("vessel_id <> 'LAST'").count() == pings.select("vessel_id", "time_stamp").distinct().count()
    assert live.filter("SI_HARB = 1").count() > 0
    batch = trips.trips_by_gap(pings).groupBy("vessel_trip").agg({"time_stamp": "min"})
    assert drained(positions.live_trips(read(), late="3000 days"), "sessions", "complete").filter("vessel_id <> 'LAST'").count() == batch.count()
