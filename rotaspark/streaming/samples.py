"""Measurements that arrive while a sweep runs: an extension, the reports themselves are batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def watch(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """New Parquet files of measurements under a path, as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def running_cells(times: DataFrame) -> DataFrame:
    """Per cell: samples so far, fastest and mean time; state is one row a cell."""
    return times.groupBy("tag", "n", "nz", "threads").agg(F.count("time_sec").alias("n_samples"), F.min("time_sec").alias("fastest"), F.avg("time_sec").alias("mean"))
