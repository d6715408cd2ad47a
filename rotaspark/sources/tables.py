"""Matrices and measurements made of the star schema's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.operators.linear import exact_sums


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def count(spark: SparkSession, sf_dir: str, table: str) -> int:
    return read(spark, sf_dir, table).count()


def trade(spark: SparkSession, sf_dir: str, exact: bool = False) -> DataFrame:
    """(row, col, val): revenue by customer nation and supplier nation; exact sums have the same bits however rows are dealt."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    cells = joined.select(F.col("c_nationkey").cast("long").alias("row"), F.col("s_nationkey").cast("long").alias("col"), "revenue")
    if exact:
        return exact_sums(cells, "revenue", "row", "col").withColumnRenamed("total", "val")
    return cells.groupBy("row", "col").agg(F.sum("revenue").alias("val"))


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, col, val): ordered quantity by part and supplier."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").alias("row"), F.col("l_suppkey").alias("col")).agg(F.sum("l_quantity").alias("val"))


def part_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row, k) for every part key once: its lines, for each part of that key."""
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("row"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("row")).agg(F.count(F.lit(1)).alias("k"))
    return parts.join(lines, "row", "left").groupBy("row").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k"))


def bench_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as run measurements: src, tag, n, nz, threads, ranks, chunks, rep, time_sec (null where the value is below 2)."""
    u = F.col("user_id")
    return read(spark, sf_dir, "events").select(
        F.concat(F.lit("run"), (u % 3).cast("string")).alias("src"),
        F.when(F.col("event_id") % 11 == 0, "seq").otherwise(F.col("event_type")).alias("tag"),
        (F.lit(100000) * (1 + u % 2)).cast("long").alias("n"),
        (F.lit(4000000) * (1 + F.floor(u / 2) % 2)).cast("long").alias("nz"),
        F.call_function("shiftleft", F.lit(1), (F.floor(u / 4) % 6).cast("int")).alias("threads"),
        (1 + F.floor(u / 8) % 3).cast("int").alias("ranks"),
        F.when(u % 5 == 0, None).otherwise(u % 5).cast("int").alias("chunks"),
        F.col("event_id").alias("rep"),
        F.when(F.col("value") >= 2, F.col("value")).alias("time_sec"),
    )


TIMES_SQL = """times AS (
  SELECT 'run' || (user_id % 3)::VARCHAR AS src, CASE WHEN event_id % 11 = 0 THEN 'seq' ELSE event_type END AS tag,
    100000 * (1 + user_id % 2) AS n, 4000000 * (1 + (user_id // 2) % 2) AS nz,
    CAST(1 << ((user_id // 4) % 6)::INT AS INT) AS threads, CAST(1 + (user_id // 8) % 3 AS INT) AS ranks,
    CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id % 5 AS INT) END AS chunks, event_id AS rep,
    CASE WHEN value >= 2 THEN value END AS time_sec
  FROM events)"""


def bench_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last checksum of each cell: src, tag, n, nz, threads, checksum (null at times)."""
    times = bench_times(spark, sf_dir)
    value = F.when(F.col("rep") % 4 == 0, None).otherwise(F.lower(F.hex(F.col("n") + F.col("threads") + F.when(F.col("rep") % 97 == 1, 1).otherwise(0))))
    return times.groupBy("src", "tag", "n", "nz", "threads").agg(F.max_by(value, "rep").alias("checksum"))


CHECKSUMS_SQL = """cksum AS (
  SELECT src, tag, n, nz, threads, arg_max_null(CASE WHEN rep % 4 = 0 THEN NULL ELSE lower(hex(n + threads + CASE WHEN rep % 97 = 1 THEN 1 ELSE 0 END)) END, rep) AS checksum
  FROM times GROUP BY ALL)"""
