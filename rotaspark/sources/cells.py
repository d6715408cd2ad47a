"""Samples kept by cell, and settings in one file that is replaced whole.

A cell is a run configuration named like cde_n10_nz40_t8.  A folder holds a
partition run=CELL of lines under times (a time, or NA, a line) and under checksums (the last
repetition's).  Writing a cell again replaces it and leaves the others alone;
appending adds to it.  A cell's lines may lie in several files, so that one with
most of the samples is written by several tasks.

Null times are NA, and a null checksum is NA as well: the last repetition counts, whether
or not it has one.  Repeated samples stay.  An empty table changes nothing.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.sources.results import dimensions, merge_configs, named_lines, scan_config, scan_times
from rotaspark.sources.scratch import delete

NONE = "NA"


def _put(lines: DataFrame, path: str, replace: bool) -> None:
    """Lines (run, value) into partitions; skewed ones are split by Spark."""
    writer = lines.select("run", "value").hint("rebalance", F.col("run")).write.partitionBy("run")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)
    else:
        writer.mode("append").text(path)


def _written(samples: DataFrame, path: str, replace: bool) -> None:
    last = samples.groupBy("run").agg(F.max_by(F.coalesce("checksum", F.lit(NONE)), "rep").alias("value"))
    _put(samples.select("run", F.coalesce(F.col("time_sec").cast("string"), F.lit(NONE)).alias("value")), f"{path}/times", replace)
    _put(last, f"{path}/checksums", True)


def replace_cells(samples: DataFrame, path: str) -> None:
    """Cells of samples (run, rep, time_sec, checksum) anew; all other cells stay as they are."""
    _written(samples, path, True)


def append_cells(samples: DataFrame, path: str) -> None:
    """More repetitions of cells; their checksums become those of the last repetition in samples."""
    _written(samples, path, False)


def truncate_cells(runs: DataFrame, path: str) -> None:
    """Empty cells for runs (run), before they are run again."""
    empty = runs.select("run", F.lit("").alias("value")).distinct()
    _put(empty, f"{path}/times", True)
    _put(empty, f"{path}/checksums", True)


def scan_cells(spark: SparkSession, path: str) -> DataFrame:
    """file, tag, n, nz, threads, ranks, chunks, variant, time_sec: a row a sample."""
    return scan_times(spark, f"{path}/times")


def scan_checksums(spark: SparkSession, path: str) -> DataFrame:
    """file and its dimensions, checksum (null where the last repetition had none); empty cells are left out."""
    raw = named_lines(spark, f"{path}/checksums")
    return raw.select("file", *[c.alias(k) for k, c in dimensions(F.col("file")).items()], F.nullif("value", F.lit(NONE)).alias("checksum"))


def unfinished_cells(spark: SparkSession, path: str, runs: DataFrame, reps: int) -> DataFrame:
    """run: those of runs (run) that have fewer than reps times."""
    done = scan_cells(spark, path).groupBy(F.col("file").alias("run")).agg(F.count("time_sec").alias("__n")).filter(F.col("__n") >= reps)
    return runs.select("run").distinct().join(done, "run", "left_anti")


def _places(spark: SparkSession, *paths: str) -> tuple:
    jvm = spark.sparkContext._jvm
    found = [jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return jvm, found


def file_exists(spark: SparkSession, path: str) -> bool:
    _, (place,) = _places(spark, path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def _take_name(spark: SparkSession, source: JavaObject, target: JavaObject) -> None:
    """source becomes target in one step."""
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    if target.toUri().getScheme() == "file":  # Hadoop's rename deletes a local target first
        how = array(jvm.java.nio.file.CopyOption, 1)
        how[0] = jvm.java.nio.file.StandardCopyOption.ATOMIC_MOVE
        jvm.java.nio.file.Files.move(*[jvm.java.nio.file.Paths.get(p.toUri()) for p in (source, target)], how)
        return
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)


def replace_config(config: DataFrame, path: str) -> None:
    """One file of lines KEY="a b c" at path (key, values).

    The lines are written beside it first and then take its name in one step, so a reader
    sees the old file or the new one.
    """
    spark = config.sparkSession
    beside = f"{path}.{uuid.uuid4().hex}"
    lines = config.select(F.concat("key", F.lit('="'), F.array_join("values", " "), F.lit('"')).alias("value"))
    lines.coalesce(1).sortWithinPartitions("value").write.text(beside)  # a row a setting
    jvm, (source, target) = _places(spark, beside, path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files = source.getFileSystem(conf)
    parts = [f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-")]
    if not parts:  # no settings at all
        parts = [jvm.org.apache.hadoop.fs.Path(f"{beside}/part-none")]
        files.create(parts[0]).close()
    _take_name(spark, files.makeQualified(parts[0]), files.makeQualified(target))
    delete(spark, beside)


def merge_config(config: DataFrame, path: str, *merged: str) -> None:
    """Settings (key, values) into the file at path: keys in `merged` keep what was there too, in order; others are replaced."""
    spark = config.sparkSession
    if not file_exists(spark, path):
        replace_config(merge_configs(config, config.limit(0)), path)
        return
    old = scan_config(spark, path).select("key", "values")
    both = F.col("key").isin(list(merged))
    kept = old.filter(~both).join(config.select("key"), "key", "left_anti")
    replace_config(merge_configs(config.filter(both), old.filter(both)).unionByName(config.filter(~both).select("key", "values")).unionByName(kept), path)
