"""Small state tables kept as JSON lines: the times of admitted calls."""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def load_calls(spark: SparkSession, path: str) -> DataFrame:
    """(key, seconds); an empty frame where nothing was saved, an error where a line is malformed.

    Where a save was cut off between its two renames, the state before it is at `path`.old and is read from there.
    """
    fs, p = _files(spark, path)
    if not fs.exists(p):
        fs, p = _files(spark, f"{path}.old")
        if not fs.exists(p):
            return spark.createDataFrame([], "key long, seconds double")
    return spark.read.schema("key long, seconds double").option("mode", "FAILFAST").json(p.toString())


def save_calls(calls: DataFrame, path: str) -> None:
    """Replaces the saved state: the new one is written whole beside it, then two renames put it in its place, so a frame
    that reads the old state can be saved over it, and a crash leaves the old state or the new one."""
    spark = calls.sparkSession
    fs, p = _files(spark, path)
    _, old = _files(spark, f"{path}.old")
    _, new = _files(spark, f"{path}.new-{uuid.uuid4().hex}")
    try:
        calls.select("key", "seconds").write.json(new.toString())
        if fs.exists(p):
            fs.delete(old, True)
            if not fs.rename(p, old):
                raise OSError(f"cannot move {p.toString()}")
        if not fs.rename(new, p):
            raise OSError(f"cannot move {new.toString()}")
    except BaseException:
        fs.delete(new, True)
        raise
    fs.delete(old, True)


def recent(calls: DataFrame, now: float) -> DataFrame:
    """Per key: calls of the last hour and day, older ones not counted."""
    age = F.lit(now) - F.col("seconds")
    return calls.groupBy("key").agg(F.count(F.when(age <= 3600, 1)).alias("in_hour"), F.count(F.when(age <= 86_400, 1)).alias("in_day"))
