"""The roofline model as projections, and the two kernels it is about."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaspark.operators.linear import spmv
from rotaspark.sources.scratch import discard, materialize

#: Measured figures to hold others against (fixed values).
#: threads, peak GFLOP/s, peak GB/s
CEILINGS = [(1, 19.6, 9.9), (32, 287.3, 49.2)]
#: product: matrix, GFLOP/s, intensity with x from memory, with x cached
PRODUCT = [("100k / 4M  (40 nnz/row)", 5.60, 0.1005, 0.1653), ("100k / 20M (200 nnz/row)", 6.12, 0.1001, 0.1664), ("500k / 4M  (8 nnz/row)", 4.60, 0.1023, 0.1607), ("500k / 20M (40 nnz/row)", 5.34, 0.1005, 0.1653)]
#: scaling: matrix, GFLOP/s, intensity
SCALING = [("100k / 4M", 0.2966, 0.0625), ("100k / 20M", 0.2872, 0.0625), ("500k / 4M", 0.5826, 0.0625), ("500k / 20M", 0.3048, 0.0625)]
#: level of memory, GB/s, KB
LEVELS = [("L1", 1000.0, 32.0), ("L2", 580.0, 256.0), ("L3", 325.0, 20480.0), ("DRAM", 51.0, None)]
#: KB worked on, GB/s
SWEEP = [(2.0, 984.5), (4.0, 1018.6), (8.0, 615.0), (16.0, 607.4), (32.0, 555.3), (64.0, 357.9), (128.0, 330.5), (256.0, 322.4), (512.0, 172.9), (1024.0, 59.9), (2048.0, 59.7), (4096.0, 59.7), (8192.0, 59.1), (16384.0, 58.4), (32768.0, 59.1)]


def measured(spark: SparkSession) -> dict[str, DataFrame]:
    """The figures above as tables: ceilings, product, scaling, levels, sweep."""
    return {
        "ceilings": spark.createDataFrame(CEILINGS, "threads int, peak_gflops double, peak_gbs double"),
        "product": spark.createDataFrame(PRODUCT, "label string, gflops double, ai double, ai_cached double"),
        "scaling": spark.createDataFrame(SCALING, "label string, gflops double, ai double"),
        "levels": spark.createDataFrame(LEVELS, "level string, gbs double, cache_kb double"),
        "sweep": spark.createDataFrame(SWEEP, "buffer_kb double, gbs double"),
    }


def spmv_flops(nnz: Column, n: Column) -> Column:
    return 2.0 * (nnz + n)


def spmv_bytes(nnz: Column, n: Column) -> Column:
    """Every access to x goes to memory."""
    return 20.0 * nnz + 16.0 * n


def spmv_bytes_cached(nnz: Column, n: Column) -> Column:
    """x stays in the cache: 12 bytes a nonzero."""
    return 12.0 * nnz + 16.0 * n


def ridge(peak_gflops: Column, peak_gbs: Column) -> Column:
    return peak_gflops / peak_gbs


def attainable(peak_gflops: Column, peak_gbs: Column, intensity: Column) -> Column:
    return F.least(peak_gflops, peak_gbs * intensity)


def roofline(kernels: DataFrame) -> DataFrame:
    """kernels (…, nnz, n, seconds, peak_gflops, peak_gbs) with the model's columns."""
    nnz, n, t = F.col("nnz"), F.col("n"), F.col("seconds")
    flops, low, high = spmv_flops(nnz, n), spmv_flops(nnz, n) / spmv_bytes(nnz, n), spmv_flops(nnz, n) / spmv_bytes_cached(nnz, n)
    peak, width = F.col("peak_gflops"), F.col("peak_gbs")
    reached = F.when(t > 0, flops / t / 1e9)
    roof = attainable(peak, width, low)
    return kernels.withColumns({
        "gflops": F.round(reached, 6), "ai": F.round(low, 6), "ai_cached": F.round(high, 6),
        "roof": F.round(roof, 6), "percent_of_roof": F.round(100 * reached / roof, 4),
        "dram_gbs": F.round(F.when(t > 0, spmv_bytes_cached(nnz, n) / t / 1e9), 6), "ridge": F.round(ridge(peak, width), 6),
        "bound": F.when(low < ridge(peak, width), "memory").otherwise("compute"),
    })


def scale_model(kernels: DataFrame) -> DataFrame:
    """The scaling kernel: n flops and 16 n bytes; (…, n, seconds) with k2_gflops and k2_gbs."""
    n, t = F.col("n"), F.col("seconds")
    return kernels.withColumn("k2_gflops", F.round(F.when(t > 0, n / t / 1e9), 6)).withColumn("k2_gbs", F.round(F.when(t > 0, 16.0 * n / t / 1e9), 6))


def memory_level(kernels: DataFrame) -> DataFrame:
    """kernels (…, nnz, n) with working_kb, the level of memory that holds it, that level's GB/s, the sweep's GB/s at that size, and the roof.

    The working set is the matrix and both vectors; a level holds it if its size
    does, and the last of the levels holds anything.  The sweep counts the smallest measured
    size that is not below it, or its largest one.
    """
    kb = F.col("working_kb")

    def first(rows: list[tuple], place: int, value: int) -> Column:
        """value of the first row whose size at place holds kb; of the last row otherwise."""
        out = F.lit(rows[-1][value])
        for row in reversed(rows[:-1]):
            out = F.when(kb <= row[place], row[value]).otherwise(out)
        return out

    intensity = spmv_flops(F.col("nnz"), F.col("n")) / spmv_bytes_cached(F.col("nnz"), F.col("n"))
    sized = kernels.withColumn("working_kb", (12.0 * F.col("nnz") + 16.0 * F.col("n")) / 1024)
    found = sized.withColumns({"level": first(LEVELS, 2, 0), "level_gbs": first(LEVELS, 2, 1), "sweep_gbs": first(SWEEP, 0, 1)})
    return found.withColumn("level_roof", attainable(F.lit(CEILINGS[-1][1]), F.col("level_gbs"), intensity))


def timed_product(a: DataFrame, x: DataFrame, reps: int = 3) -> DataFrame:
    """rep, nnz, n (rows with entries), seconds of the product A x, run so often over the written matrix and vector; the peaks are those of the largest machine measured."""
    spark = a.sparkSession
    a, x = materialize(a, "matrix"), materialize(x, "vector")
    nnz, n = a.agg(F.count(F.lit(1)), F.countDistinct("row")).first()
    times = []
    for _ in range(reps):
        began = time.perf_counter()
        spmv(a, x, None).write.format("noop").mode("overwrite").save()
        times.append(time.perf_counter() - began)
    discard(a)
    discard(x)
    _, gflops, gbs = CEILINGS[-1]
    return spark.createDataFrame([(k + 1, nnz, n, t, gflops, gbs) for k, t in enumerate(times)], "rep int, nnz long, n long, seconds double, peak_gflops double, peak_gbs double")


def triad(b: Column, c: Column, s: float = 3.0) -> Column:
    return b + s * c
