"""Result files: logs of key=value lines, one-number-a-line samples, settings, vector dumps.

Scans read with Spark, take dimensions from file names, and give null where a
value is missing; sinks write with Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILE = "_metadata.file_name"


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The first match's group; null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def parse_log(text: Column) -> dict[str, Column]:
    """What a program's output says: matrix statistics, time_sec, checksum, rayleigh, generation_time_sec, vector_dump."""
    return {
        "rows": found(text, r"(?m)^rows=(\d+)").try_cast("long"),
        "total_nnz": found(text, r"total_nnz=(\d+)").try_cast("long"),
        "min_nnz": found(text, r"min_nnz_per_row=(\d+)").try_cast("long"),
        "max_nnz": found(text, r"max_nnz_per_row=(\d+)").try_cast("long"),
        "avg_nnz": found(text, r"avg_nnz_per_row=(\S+)").try_cast("double"),
        "time_sec": found(text, r"(?m)^.*Time \(sec\).*?(\S+)\s*$").try_cast("double"),
        "checksum": found(text, r"checksum=(\S+)"),
        "rayleigh": found(text, r"rayleigh=(\S+)").try_cast("double"),
        "generation_time_sec": found(text, r"generation_time_sec=(\S+)").try_cast("double"),
        "vector_dump": found(text, r"vector_dump=(\S+)"),
    }


def dimensions(name: Column) -> dict[str, Column]:
    """tag, n, nz, threads, ranks, chunks and variant out of a name like mpiov_n10_nz40_r2_t4_c8.times."""
    chunks = found(name, r"_c(\d+)(?:[._]|$)").try_cast("int")
    ranks = found(name, r"_r(\d+)(?:[._]|$)").try_cast("int")
    return {
        "tag": found(name, r"^(.*?)_n\d+_nz"),
        "n": found(name, r"_n(\d+)_nz").try_cast("long"),
        "nz": found(name, r"_nz(\d+)").try_cast("long"),
        "threads": found(name, r"_t(\d+)(?:[._]|$)").try_cast("int"),
        "ranks": ranks,
        "chunks": chunks,
        "variant": F.when(chunks.isNotNull(), "overlap").when(ranks.isNotNull(), "block"),
    }


def parse_config(line: Column) -> dict[str, Column]:
    """key and values of a line KEY="a b c"."""
    text = F.regexp_extract(line, r'^\s*(\w+)="?([^"]*)"?\s*$', 2)
    return {"key": found(line, r'^\s*(\w+)="?([^"]*)"?\s*$'), "values": F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")}


def run_name() -> Column:
    """A file's name, or NAME where it is a part of a folder run=NAME."""
    return F.regexp_extract("_metadata.file_path", r"(?:run=)?([^/]+?)(?:/part-[^/]*)?$", 1)


def named_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, value: lines and their file's name, or NAME in a folder run=NAME.

    Of folders the name is a column of the table's partitions, so a filter on what the name says
    is decided once a folder and not by patterns over each line's path.
    """
    raw = spark.read.text(path)
    name = F.col("run") if dict(raw.dtypes).get("run") == "string" else run_name()
    return raw.select(name.alias("file"), F.trim("value").alias("value")).filter("value <> ''")


def scan_logs(spark: SparkSession, path: str) -> DataFrame:
    """A row a log: its dimensions and what it says.  Logs are files, or folders run=NAME as write_logs makes them."""
    raw = spark.read.text(path, wholetext=True).select(run_name().alias("file"), "value")
    return raw.select("file", *[c.alias(k) for k, c in (dimensions(F.col("file")) | parse_log(F.col("value"))).items()])


def write_logs(logs: DataFrame, path: str) -> None:
    """Logs (run: a name like seq_n5_nz9, text), a folder each; fails if the path exists."""
    logs.select("run", F.col("text").alias("value")).write.partitionBy("run").text(path)


def scan_times(spark: SparkSession, path: str) -> DataFrame:
    """A row a line: dimensions and time_sec (null for NA)."""
    raw = named_lines(spark, path)
    return raw.select("file", *[c.alias(k) for k, c in dimensions(F.col("file")).items()], F.col("value").try_cast("double").alias("time_sec"))


def write_times(times: DataFrame, path: str) -> None:
    """Samples (run, time_sec), a line each (NA for none) in a folder for each run; fails if the path exists."""
    lines = times.select("run", F.coalesce(F.col("time_sec").cast("string"), F.lit("NA")).alias("value"))
    lines.repartition("run").write.partitionBy("run").text(path)


def scan_config(spark: SparkSession, path: str) -> DataFrame:
    """file, key, values."""
    raw = spark.read.text(path).select(F.col(FILE).alias("file"), "value")
    return raw.select("file", *[c.alias(k) for k, c in parse_config(F.col("value")).items()]).filter("key is not null")


def merge_configs(a: DataFrame, b: DataFrame) -> DataFrame:
    """key, values: for each key the union of both, numbers by size before other values by name."""
    both = a.select("key", F.explode("values").alias("v")).unionByName(b.select("key", F.explode("values").alias("v")))
    number = F.col("v").try_cast("double")
    entry = F.struct(number.isNull().alias("other"), number.alias("number"), F.col("v"))
    merged = both.groupBy("key").agg(F.sort_array(F.collect_set(entry)).alias("values"))  # as many as there are settings
    return merged.select("key", F.transform("values", lambda e: e["v"]).alias("values"))


def write_config(config: DataFrame, path: str) -> None:
    """Lines KEY="a b c" in one file, as scan_config reads them: one row a setting; fails if the path exists."""
    lines = config.select(F.concat("key", F.lit('="'), F.array_join("values", " "), F.lit('"')).alias("value"))
    lines.coalesce(1).sortWithinPartitions("value").write.text(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """i, value: the lines of text files, counted through all files in the order of their names.

    A task counts inside its pieces of files; only one row a piece meets in the window over pieces.
    """
    raw = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, k = None, 0
        for batch in batches:
            places = []
            for now in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = k + 1 if now == piece else 0
                piece = now
                places.append(k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["file", "start", "value", "k"])

    lines = raw.mapInArrow(count, "file string, start long, value string, k long")
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    pieces = lines.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
    pieces = pieces.select("file", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return lines.join(pieces, ["file", "start"]).select((F.col("offset") + F.col("k")).cast("long").alias("i"), "value")


def scan_dump(spark: SparkSession, path: str) -> DataFrame:
    """i, v of a dump: the value of element i in line i."""
    return numbered_lines(spark, path).select("i", F.col("value").cast("double").alias("v"))


def write_dump(x: DataFrame, path: str) -> None:
    """One value a line, with 17 digits, in the order of i over the files' names; fails if the path exists."""
    digits = F.format_string("%.16e", F.col("v").cast("double"))
    x.repartitionByRange("i").sortWithinPartitions("i").select(digits.alias("value")).write.text(path)


def log_text(title: Column, rows: Column, total_nnz: Column, min_nnz: Column, max_nnz: Column, generation_sec: Column, rayleigh: Column, checksum: Column, seconds: Column) -> Column:
    """A run's output as the scans above read it; a run without a time did not end."""
    number = lambda c: c.cast("string")
    stats = F.concat(F.lit("rows="), number(rows), F.lit("  total_nnz="), number(total_nnz), F.lit("  min_nnz_per_row="), number(min_nnz), F.lit("  max_nnz_per_row="), number(max_nnz), F.lit("  avg_nnz_per_row="), F.format_string("%.3f", total_nnz / rows))
    end = F.concat(F.lit("rayleigh="), F.format_string("%.15g", rayleigh), F.lit("\nchecksum=0x"), checksum, F.lit("\nTime (sec) = "), F.format_string("%.6f", seconds))
    return F.concat_ws("\n", title, stats, F.concat(F.lit("generation_time_sec="), F.format_string("%.3f", generation_sec)), F.lit(""), F.when(seconds.isNotNull(), end))


def latest_checksums(runs: DataFrame, *keys: str) -> DataFrame:
    """keys, checksum: the last repetition's, whether or not it has one."""
    return runs.groupBy(*keys).agg(F.max_by("checksum", "rep").alias("checksum"))
