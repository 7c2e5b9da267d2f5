"""Intermediate tables, Arrow batches and a few column helpers that all operators use."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch, staged

__all__ = ["lean", "lower_ascii", "scratch", "staged", "table"]


def lean(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are small: each task holds one on either side of its Python worker.

    Batches of whole texts are cut smaller in tasks anyway; a lower limit set by the user stays.
    """
    key, most = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
    conf = df.sparkSession.conf
    if int(conf.get(key)) <= 0 or int(conf.get(key)) > most:
        conf.set(key, str(most))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m") in ("64m", "67108864", "67108864b"):
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    return df


def lower_ascii(col: Column) -> Column:
    """A-Z only; other letters stay as they are, whatever the locale."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
