"""Reading, typing and writing pings; tables of pings, harbours, coast and registry derived from the given ones."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A ping; ``rec_id`` breaks ties in time.
PINGS = "rec_id long, vessel_id string, time_stamp timestamp, lon double, lat double, speed double, course double, gear string, behaviour string"


def read_pings(spark: SparkSession, path: str, schema: str | None = PINGS, sep: str = ",") -> DataFrame:
    """Parquet, or text with a header and ``sep`` between values where the path ends in .csv, .tsv or .txt; without a schema types are inferred."""
    text = path.rstrip("/").endswith((".csv", ".tsv", ".txt"))
    reader = spark.read.schema(schema) if schema else spark.read.option("inferSchema", True)
    return reader.option("header", True).option("sep", sep).csv(path) if text else reader.parquet(path)


def parse_time(text: Column, fmt: str = "yyyy-MM-dd HH:mm:ss[.SSS]") -> Column:
    """Null where the text is no such time."""
    return F.try_to_timestamp(text, F.lit(fmt))


def excel_date(serial: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))


def write_pings(df: DataFrame, path: str) -> None:
    """One folder per year; a vessel's pings together and in order within the files."""
    df.withColumn("year", F.year("time_stamp")).repartition("vessel_id").sortWithinPartitions("vessel_id", "time_stamp", "rec_id").write.partitionBy("year").mode("overwrite").parquet(path)


def store_track(df: DataFrame, name: str, path: str, buckets: int = 200) -> DataFrame:
    """``df`` as a table of the session's catalog, kept at ``path``, bucketed by vessel with one file a bucket in track order.

    Windows and aggregates by vessel read it without an exchange, whatever is asked of it later; two
    tables of as many buckets are joined by vessel without one too. The number of buckets is that of the tasks that will read it.
    """
    spark = df.sparkSession
    laid = df.repartition(buckets, "vessel_id").write.bucketBy(buckets, "vessel_id").sortBy("vessel_id", "time_stamp", "rec_id")
    laid.mode("overwrite").option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pings of vessels that circle their home port twice a day."""
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    e = events.join(customers, F.col("user_id") == F.col("c_custkey"))
    e = e.withColumn("sec", F.expr("((unix_micros(ts) - 1704067200000000) div 100000000) * 10")).withColumn("m", F.col("sec") / F.lit(60.0))
    turn = 2 * F.pi() * F.col("m") / 720 + F.col("user_id")
    knots = F.col("value") / F.lit(20.0)
    return e.select(
        F.col("event_id").cast("long").alias("rec_id"),
        F.concat(F.lit("EX_"), F.col("user_id").cast("string")).alias("vessel_id"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("sec")).cast("timestamp_ntz").alias("time_stamp"),
        F.round(10 + F.col("c_nationkey") % 5 + 0.2 * F.cos(turn), 6).alias("lon"),
        F.round(55 + F.expr("c_nationkey div 5") * F.lit(0.8) + 0.1 * F.sin(turn), 6).alias("lat"),
        F.when(F.col("event_id") % 17 != 0, knots).alias("speed"),
        F.when(F.col("event_id") % 101 == 0, 511.0).when(F.col("event_id") % 11 != 0, F.get_json_object("props", "$.k").cast("double") * 3.6).alias("course"),
        F.col("c_mktsegment").alias("gear"),
        F.when(F.col("event_type") != "signup", F.when(knots.between(1, 5) != (F.col("event_type") == "error"), "Fishing").otherwise("Steaming")).alias("behaviour"),
    )


def _squares(spark: SparkSession, sf_dir: str, shift: float, half: float, key: str) -> DataFrame:
    n = F.col("n_nationkey")
    x, y = 10 + n % 5 + F.lit(shift), 55 + F.expr("n_nationkey div 5") * F.lit(0.8)
    corner = lambda sx, sy: F.struct((x + sx * half).alias("lon"), (y + sy * half).alias("lat"))
    return table(spark, sf_dir, "nation").select(n.cast("long").alias(key), F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1)).alias("ring"))


def harbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _squares(spark, sf_dir, 0.2, 0.08, "harbour_id")


def coast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _squares(spark, sf_dir, -0.2, 0.03, "coast_id")


def registry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``tracks`` (pings that know a trip only), ``trips`` and ``devices``."""
    p = pings(spark, sf_dir)
    user = F.substring_index("vessel_id", "_", -1).cast("long")
    tracks = p.select("rec_id", "time_stamp", "lon", "lat", (user * 100 + F.dayofmonth("time_stamp")).alias("trip_id"))
    trips = tracks.select("trip_id", F.expr("trip_id div 100").alias("device_id")).distinct()
    devices = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("device_id"), F.concat(F.lit("EX_"), F.col("c_custkey").cast("string")).alias("vessel_id"))
    return tracks, trips, devices
