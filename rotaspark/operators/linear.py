"""Sparse linear algebra on DataFrames: matrices (row, col, val), vectors (i, v)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from rotaspark.functions.bits import LEAST, MANTISSA, whole_mark, with_bits, with_mix, with_parts
from rotaspark.sources.scratch import materialize

#: A vector of at most so many rows may be broadcast (16 bytes each: 32 MB).
BROADCAST_ROWS = 2_000_000


def small(vector: DataFrame, n: int | None) -> DataFrame:
    """A vector of n rows, marked for broadcast if that is few enough; one of unknown length is left to Spark."""
    return F.broadcast(vector) if n is not None and n <= BROADCAST_ROWS else vector


def _rotated(row: Column, n: int | None, shift: int) -> Column:
    return (row if n is None else (row + shift) % n).cast("long")


def spmv(a: DataFrame, x: DataFrame, n: int | None, shift: int = 0) -> DataFrame:
    """y = shift(A) x, with i = (row + shift) % n; rows without entries are left out.

    The rotation is applied after the sum: it permutes whole rows, so the
    grouping by source row stays good.  A square matrix has n rows; n None is for
    others, and for vectors whose length is not known, and then nothing rotates.
    """
    y = a.join(small(x, n).withColumnRenamed("i", "__i"), F.col("col") == F.col("__i")).groupBy("row").agg(F.sum(F.col("val") * F.col("v")).alias("v"))
    return y.select(_rotated(F.col("row"), n, shift).alias("i"), "v")


def spmv_measured(a: DataFrame, x: DataFrame, n: int | None, shift: int = 0) -> tuple[DataFrame, float]:
    """y = shift(A) x, written to the shared folder, and its length, whose squares are summed while y is written."""
    squares = Observation()
    seen = spmv(a, x, n, shift).observe(squares, F.sum(F.col("v") * F.col("v")).alias("squares"))
    return materialize(seen, "product"), math.sqrt(squares.get["squares"] or 0.0)


def spmv_ordered(rows: DataFrame, x: DataFrame, n: int | None, shift: int = 0) -> DataFrame:
    """The same over (row, pos, col, val), each row summed in the order of pos."""
    met = rows.join(small(x, n).withColumnRenamed("i", "__i"), F.col("col") == F.col("__i"))
    terms = met.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("val") * F.col("v")).alias("t")))).alias("terms"))
    return terms.select(_rotated(F.col("row"), n, shift).alias("i"), F.aggregate("terms", F.lit(0.0), lambda s, e: s + e["t"]).alias("v"))


#: Bits of the pieces that a mantissa is summed in: 2**45 values fit a sum.
LIMB = 18


@F.pandas_udf(DoubleType())
def _rounded(bins: pd.Series) -> pd.Series:
    """The double nearest to the sum of (lo + mid 2**18 + hi 2**36) 2**(e - 52); at most one entry an exponent."""

    def nearest(found) -> float:
        low = min((b["e"] for b in found), default=0)
        total = sum((int(b["lo"]) + (int(b["mid"]) << LIMB) + (int(b["hi"]) << 2 * LIMB)) << (b["e"] - low) for b in found)
        k = low - MANTISSA
        try:
            return float(total << k) if k >= 0 else total / (1 << -k)  # a quotient of whole numbers is rounded once
        except OverflowError:
            return float("inf") if total > 0 else float("-inf")

    return bins.map(nearest)


def exact_sums(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """keys, total: the sum of a double without any error but the last rounding, whatever the order and partitions.

    Values are whole mantissas times powers of two; mantissas are summed by exponent,
    in pieces that cannot overflow, before the shuffle and after it.  Nulls are left
    out, an empty sum is null (without keys a row of null), infinities and NaN add as usual.
    """
    parts = with_parts(df.select(*keys, F.col(value).cast("double").alias("__v")), "__v", "__p")
    sign, m = F.when(F.col("__v") < 0, -1).otherwise(1), F.col("__p_m")
    piece = lambda k: (sign * F.shiftright(m, k * LIMB).bitwiseAND(F.lit(2**LIMB - 1))).cast("long")
    odd = F.when(F.col("__p_e").isNull(), F.col("__v"))
    bins = parts.filter("__v is not null").groupBy(*keys, F.coalesce("__p_e", F.lit(LEAST)).alias("e")).agg(*[F.coalesce(F.sum(piece(k)), F.lit(0)).alias(c) for k, c in enumerate(("lo", "mid", "hi"))], F.sum(odd).alias("__odd"))
    whole = bins.groupBy(*keys).agg(F.collect_list(F.struct("e", "lo", "mid", "hi")).alias("__bins"), F.sum("__odd").alias("__odd"), F.count(F.lit(1)).alias("__some"))
    return whole.select(*keys, F.when(F.col("__some") > 0, F.coalesce("__odd", _rounded("__bins"))).alias("total"))


def ordered_sums(df: DataFrame, value: str, place: str, *keys: str) -> DataFrame:
    """keys, total: the sum of a double, added in the order of place, so with the same bits however rows are dealt.

    A window adds up, so no list of a key's values is held.  Nulls are left out, an empty sum is null.
    """
    upto = Window.partitionBy(*keys).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.select(*keys, place, F.sum(value).over(upto).alias("__upto"))
    return sums.groupBy(*keys).agg(F.max_by("__upto", place).alias("total"))


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: dot."""
    return a.join(b.withColumnRenamed("v", "w"), "i").agg(F.coalesce(F.sum(F.col("v") * F.col("w")), F.lit(0.0)).alias("dot"))


def l2_norm(x: DataFrame) -> DataFrame:
    """One row: norm."""
    return x.agg(F.coalesce(F.sqrt(F.sum(F.col("v") * F.col("v"))), F.lit(0.0)).alias("norm"))


def normalize(x: DataFrame) -> DataFrame:
    """x scaled to unit length; a zero vector stays.  x is read twice: give a cheap or a written one."""
    return _scaled(x, l2_norm(x))


def exact_dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: dot, the rounded products summed without error."""
    return exact_sums(a.join(b.withColumnRenamed("v", "w"), "i").select((F.col("v") * F.col("w")).alias("t")), "t").select(F.coalesce("total", F.lit(0.0)).alias("dot"))


def exact_norm(x: DataFrame) -> DataFrame:
    """One row: norm, the rounded squares summed without error."""
    return exact_sums(x.select((F.col("v") * F.col("v")).alias("t")), "t").select(F.coalesce(F.sqrt("total"), F.lit(0.0)).alias("norm"))


def normalize_exactly(x: DataFrame) -> DataFrame:
    """x scaled to unit length with the same bits however its rows are dealt; a zero vector stays."""
    return _scaled(x, exact_norm(x))


def _scaled(x: DataFrame, norm: DataFrame) -> DataFrame:
    scaled = F.when(F.col("norm") > 0, F.col("v") * (F.lit(1.0) / F.col("norm"))).otherwise(F.col("v"))
    return x.join(F.broadcast(norm)).select("i", scaled.alias("v"))  # one row is broadcast


def normalize_rows(a: DataFrame, exact: bool = False) -> DataFrame:
    """a with rows of unit length; rows of zeros stay."""
    squares = a.select("row", (F.col("val") * F.col("val")).alias("total"))
    sums = exact_sums(squares, "total", "row") if exact else squares.groupBy("row").agg(F.sum("total").alias("total"))
    lengths = sums.select("row", F.sqrt("total").alias("__length"))
    return a.join(lengths, "row").withColumn("val", F.when(F.col("__length") > 0, F.col("val") / F.col("__length")).otherwise(F.col("val"))).drop("__length")


def rayleigh(a: DataFrame, x: DataFrame, n: int, shift: int) -> DataFrame:
    """One row: x . shift(A) x, under the name rayleigh."""
    return dot(x, spmv(a, x, n, shift)).withColumnRenamed("dot", "rayleigh")


def checksum(x: DataFrame) -> DataFrame:
    """One row: the xor over i of mix(bits(v) ^ mix(i)), in lower-case hex without leading zeros."""
    terms = with_mix(with_bits(x.select(F.col("i").cast("long").alias("i"), F.col("v").cast("double").alias("v")), "v", "bits"), "i", "t")
    terms = with_mix(terms.select(F.col("bits").bitwiseXOR(F.col("t")).alias("t")), "t", "t")
    return terms.agg(F.lower(F.hex(F.coalesce(F.bit_xor("t"), F.lit(0).cast("long")))).alias("checksum"))


def whole_checksum(x: DataFrame, digits: int = 6) -> DataFrame:
    """The checksum of values rounded to integers of 10**-digits: equal wherever values agree to that."""
    scaled: Column = F.round(F.col("v") * 10**digits).cast("long")
    return x.select(whole_mark(F.col("i").cast("long"), scaled).alias("t")).agg(F.bit_xor("t").alias("checksum"))


def compare_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n_a, n_b, n_common, max_abs_diff, verdict (identical, different length, close)."""
    met = a.withColumnRenamed("v", "__a").join(b.withColumnRenamed("v", "__b"), "i", "full")
    stats = met.agg(F.count("__a").alias("n_a"), F.count("__b").alias("n_b"), F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_common"), F.max(F.abs(F.col("__a") - F.col("__b"))).alias("max_abs_diff"))
    verdict = F.when(F.col("n_a") != F.col("n_b"), "different length").when(F.coalesce("max_abs_diff", F.lit(0.0)) == 0, "identical").otherwise("different")
    return stats.withColumn("verdict", verdict)
