"""Shares of a number of units by any column of weights: largest remainders, without a sort or window.

Row i of n rows gets one unit, the whole part of (units - n) w / sum(w) as far as
the cap allows, and one more if its remainder is among the largest of the rows
below the cap (the smaller i first in a tie).  What is left then fills rows up to the cap
from row 0 on.  The two places where this stops are found by histograms that are
refined until a bin is one number: some counts in each of a few rounds go to the driver,
whatever the number of rows and however many are tied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotaspark.sources.scratch import materialize

#: Bins of a histogram.
BINS = 4096


def place_of(rows: DataFrame, key: Column, amount: Column, wanted: int, low: int, high: int, bins: int = BINS) -> tuple[int, int]:
    """The smallest p in [low, high) with a sum of amount over low <= key <= p of at least wanted, and the sum over key < p.

    high and the whole sum if there is none.  amount is never negative; a round reads the rows of one bin.
    """
    before = 0
    while low < high:
        width = -(-(high - low) // bins)
        bin_ = F.floor((key - low) / width) if width > 1 else key - low
        inside = rows.filter((key >= low) & (key < high)).groupBy(bin_.cast("int").alias("bin")).agg(F.sum(amount.cast("decimal(38,0)")).alias("s"))  # BINS rows at most
        for b, s in sorted(inside.collect()):
            if before + int(s) >= wanted:
                break
            before += int(s)
        else:
            return high, before
        low, high = low + b * width, min(high, low + (b + 1) * width)
        if width == 1:
            return low, before
    return high, before


def apportion(weights: DataFrame, n: int, units: int, key: str = "row", weight: str = "w", cap: int | None = None) -> DataFrame:
    """row, nnz of (row, w): every row of [0, n) once, w whole and not negative; nnz is in [1, cap] and sums to units."""
    cap = n if cap is None else cap
    if not n <= units <= n * cap:
        raise ValueError(f"{units} units do not go into {n} rows of 1 to {cap}")
    extras = units - n
    given = weights.select(F.col(key).cast("long").alias("row"), F.col(weight).cast("long").alias("w"))
    stats = given.agg(F.sum(F.col("w").cast("decimal(38,0)")).alias("total"), F.count("w").alias("rows"), F.min("w").alias("least"), F.min("row").alias("first"), F.max("row").alias("last")).first()
    if stats.rows != n or (n and (stats.least < 0 or stats.first != 0 or stats.last != n - 1)):
        raise ValueError(f"weights must be given for each row from 0 to {n - 1} and not be negative")
    total = max(1, int(stats.total))
    ideal = (F.col("w").cast("decimal(19,0)") * F.lit(extras).cast("decimal(19,0)")).cast("decimal(38,0)")
    rest = F.pmod(ideal, F.lit(total).cast("decimal(38,0)"))
    rows = given.withColumn("ideal", ideal).withColumn("rest", rest.cast("long"))
    whole = F.expr(f"(ideal - rest) div {total}BD").cast("long")
    rows = rows.select("row", F.least(whole, F.lit(cap - 1)).alias("share"), F.when(whole < cap - 1, F.col("rest")).alias("rest"))
    rows = materialize(rows, "shares")
    left = extras - int(rows.agg(F.sum(F.col("share").cast("decimal(38,0)"))).first()[0])
    # Units by remainder: places count down from the largest one.
    open_rows, down, one = rows.filter("rest is not null"), total - 1 - F.col("rest"), F.lit(1)
    place, above = place_of(open_rows, down, one, left, 0, total) if left else (-1, 0)
    tied = open_rows.filter(down == place)
    last, _ = place_of(tied, F.col("row"), one, left - above, 0, n) if left and place < total else (n, 0)
    more = (down < place) | ((down == place) & (F.col("row") <= last)) if left else F.lit(False)
    rows = rows.select("row", (1 + F.col("share") + F.coalesce(more, F.lit(False)).cast("long")).alias("k"))
    taken = min(left, open_rows.count()) if left else 0
    left -= taken
    if not left:
        return rows.select("row", F.col("k").alias("nnz"))
    room = F.lit(cap) - F.col("k")
    end, filled = place_of(rows, F.col("row"), room, left, 0, n)
    added = F.when(F.col("row") < end, room).when(F.col("row") == end, left - filled).otherwise(0)
    return rows.select("row", (F.col("k") + added).cast("long").alias("nnz"))
