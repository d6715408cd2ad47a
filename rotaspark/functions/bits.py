"""Unsigned 64-bit arithmetic: mixing, random draws, units.

Numpy functions take arrays of unsigned 64-bit numbers, whose sums and products
wrap; the columns made of them (LONG columns that hold the bit pattern) run over
Arrow batches.  The functions at the end do the same in column expressions alone:
a double is taken apart into its sign, exponent and mantissa by exact
scaling, and products that wrap are put together from halves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

#: Fixed values of the generator: state increment and the two multipliers of the mixer.
GAMMA = 0x9E3779B97F4A7C15
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MASK = 2**64 - 1


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLIERS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLIERS[1])
    return x ^ (x >> np.uint64(31))


def drawn(seed: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th draws (from 1) of generators with these seeds; no state is needed."""
    return mixed(seed + np.atleast_1d(k) * np.uint64(GAMMA))


def units(x: np.ndarray) -> np.ndarray:
    """Draws as doubles in [0, 1)."""
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


@F.pandas_udf(LongType())
def mix(x: pd.Series) -> pd.Series:
    return pd.Series(mixed(_unsigned(x)).view(np.int64))


@F.pandas_udf(LongType())
def draw(seed: pd.Series, k: pd.Series) -> pd.Series:
    return pd.Series(drawn(_unsigned(seed), _unsigned(k)).view(np.int64))


@F.pandas_udf(DoubleType())
def unit(x: pd.Series) -> pd.Series:
    return pd.Series(units(_unsigned(x)))


@F.pandas_udf(LongType())
def element_mark(i: pd.Series, v: pd.Series) -> pd.Series:
    """mix(bits of v ^ mix(i)): what an element adds to a vector's checksum."""
    return pd.Series(mixed(v.to_numpy(np.float64).view(np.uint64) ^ mixed(_unsigned(i))).view(np.int64))


@F.pandas_udf(LongType())
def whole_mark(i: pd.Series, w: pd.Series) -> pd.Series:
    """mix(w ^ mix(i)) for an integer w."""
    return pd.Series(mixed(_unsigned(w) ^ mixed(_unsigned(i))).view(np.int64))


#: Fixed values of a double: bits of the mantissa, smallest exponent.
MANTISSA, LEAST = 52, -1022


def _two_to(k: Column) -> Column:
    return F.pow(F.lit(2.0), k)


def with_parts(df: DataFrame, v: str, name: str) -> DataFrame:
    """df with name_e and name_m: |v| = m * 2**(e - 52) with whole m below 2**53, exactly; null unless v is finite."""
    a, e = F.col(f"{name}_a"), F.col(f"{name}_e")
    near = F.floor(F.log2(a)).cast("int")
    df = df.withColumn(f"{name}_a", F.when(~F.isnan(v) & (F.abs(v) < float("inf")), F.abs(F.col(v))))
    df = df.withColumn(f"{name}_e", F.when(a > 0, near))
    # The logarithm may be one off next to a power of two.
    exact = e + F.when(a >= _two_to(e + 1), 1).when(a < _two_to(e), -1).otherwise(0)
    df = df.withColumn(f"{name}_e", F.when(a == 0, LEAST).when(a > 0, F.greatest(exact, F.lit(LEAST))))
    half = F.floor((MANTISSA - e) / 2)
    return df.withColumn(f"{name}_m", (a * _two_to(half) * _two_to(MANTISSA - e - half)).cast("long")).drop(f"{name}_a")


def with_bits(df: DataFrame, v: str, name: str) -> DataFrame:
    """df with name: the 64 bits of a double as a long, in columns alone; every NaN has the same bits."""
    df = with_parts(df, v, f"__{name}")
    e, m, x = F.col(f"__{name}_e"), F.col(f"__{name}_m"), F.col(v)
    field = F.when(m >= 2**MANTISSA, e + 1023).otherwise(0).cast("long")
    whole = F.shiftleft(field, MANTISSA).bitwiseOR(m.bitwiseAND(F.lit(2**MANTISSA - 1)))
    sized = F.when(F.isnan(v), 0x7FF8 << 48).when(F.abs(x) == float("inf"), 0x7FF << 52).otherwise(whole)
    signed = F.when(~F.isnan(v) & ((x < 0) | (x.cast("string") == "-0.0")), sized.bitwiseOR(F.lit(-(2**63)))).otherwise(sized)
    return df.withColumn(name, signed).drop(f"__{name}_e", f"__{name}_m")


def _times(x: Column, by: int) -> Column:
    """x * by modulo 2**64, without a product or sum that leaves 63 bits."""
    low, high, m16, m32 = by & 0xFFFFFFFF, by >> 32, F.lit(0xFFFF).cast("long"), F.lit(0xFFFFFFFF)
    al, ah = x.bitwiseAND(m32), F.shiftrightunsigned(x, 32)
    a0, a1, b0, b1 = al.bitwiseAND(m16), F.shiftright(al, 16), ah.bitwiseAND(m16), F.shiftright(ah, 16)
    up = lambda c: F.shiftleft(c.bitwiseAND(m16), 16)
    first = a0 * F.lit(low) + up(a1 * F.lit(low))
    upper = F.shiftright(a1 * F.lit(low), 16) + F.shiftright(first, 32) + a0 * F.lit(high) + up(a1 * F.lit(high)) + b0 * F.lit(low) + up(b1 * F.lit(low))
    return F.shiftleft(upper.bitwiseAND(m32), 32).bitwiseOR(first.bitwiseAND(m32))


def with_mix(df: DataFrame, x: str, name: str) -> DataFrame:
    """df with name = mix(x), in columns alone; a step a projection, so that none is computed twice."""
    steps = [lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, 30)), lambda c: _times(c, MULTIPLIERS[0]), lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, 27)), lambda c: _times(c, MULTIPLIERS[1]), lambda c: c.bitwiseXOR(F.shiftrightunsigned(c, 31))]
    df = df.withColumn(name, F.col(x))
    for step in steps:
        df = df.withColumn(name, step(F.col(name)))
    return df
