"""Intermediate tables in the folder that the session names in ``spark.checkpoint.dir``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all executors share.

    Where that setting is absent a session on one machine (as in tests) gets a temporary folder, kept as
    its checkpoint folder; on a cluster executors would not share one, so it raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-wakeline-")
        spark.sparkContext.setCheckpointDir(base)
    _made.append(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def staged(df: DataFrame, name: str = "table", narrow: bool = False) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors.

    ``narrow``: a table of a few numbers a row, which is written by a sixteenth of the shuffle's partitions
    (but by two tasks for each core at least) rather than by one task and file for each, most nearly empty.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 16)
    (df.coalesce(tasks) if narrow else df).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes all folders that ``scratch`` named so far; results that were not written yet still need them."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        at = jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(conf).delete(at, True)
