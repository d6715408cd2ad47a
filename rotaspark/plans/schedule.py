"""Row rotation schedule, ranges of rows with equal sums, equal pieces of ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITERATIONS, EPOCH = 500, 25


def shift_step(n: int) -> int:
    """Rows the matrix rotates by at each epoch: n/16 + 17, made odd before it is taken modulo n; never 0."""
    s = n // 16 + 17
    s += s % 2 == 0
    return s % n or 1


def shift_at(iteration: int, n: int, epoch: int = EPOCH) -> int:
    """Rotation in force at an iteration; it advances at each multiple of epoch but 0."""
    return shift_step(n) * (iteration // epoch) % n


def final_shift(n: int, iterations: int = ITERATIONS, epoch: int = EPOCH) -> int:
    return shift_at(iterations - 1, n, epoch) if iterations else 0


def shift_schedule(spark: SparkSession, n: int, iterations: int = ITERATIONS, epoch: int = EPOCH) -> DataFrame:
    """iteration, epoch, shift."""
    i = F.col("id")
    e = F.floor(i / epoch).cast("long")
    return spark.range(iterations).select(i.alias("iteration"), e.alias("epoch"), (e * shift_step(n) % n).alias("shift"))


def clamp_parts(parts: int, n: int) -> int:
    return min(max(parts, 1), n)


def prefix_sums(counts: DataFrame, key: str, value: str, block: int = 65_536, by: tuple[str, ...] = (), kind: str = "long") -> DataFrame:
    """counts and `ptr`, the sum of value over smaller keys (of the same group by), in two levels.

    Windows run inside blocks of keys; only one row a block meets in the window over blocks.
    """
    blocked = counts.withColumn("__block", F.floor(F.col(key) / block).cast("long"))
    sums = blocked.groupBy(*by, "__block").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "__block", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*by, "__block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    ptr = F.coalesce(F.sum(value).over(inside), F.lit(0))
    joined = blocked.withColumn("__inside", ptr).join(offsets, [*by, "__block"])
    return joined.withColumn("ptr", (F.col("__inside") + F.col("__offset")).cast(kind)).drop("__block", "__inside", "__offset")


def balanced_parts(counts: DataFrame, key: str, value: str, parts: int, n: int, clamp: bool = True) -> DataFrame:
    """part, lo, hi, nnz: contiguous row ranges of about equal value; counts has each row once, as a rule those of [0, n).

    Part t begins at the first row whose prefix sum reaches floor(total t / parts),
    or at n, where the whole sum is reached, if that is smaller: keys may leave gaps.
    Each row computes from its own prefix sum the last such t, so targets are
    not joined with rows.  More parts than rows are left out, or empty without clamp.
    """
    spark, p = counts.sparkSession, clamp_parts(parts, n) if clamp or not n else parts
    total = counts.agg(F.coalesce(F.sum(value), F.lit(0)).cast("long")).first()[0]
    ptr = prefix_sums(counts.select(key, value), key, value)
    # The smallest t whose target is above a sum, in whole numbers: a quotient of decimals is rounded to 6 places.
    above = F.call_function("div", (F.col("ptr").cast("decimal(30,0)") + 1) * p + (max(total, 1) - 1), F.lit(max(total, 1)))
    reached = ptr.select(F.least(above - 1, F.lit(p)).cast("int").alias("last"), F.col(key).cast("long").alias("lo"), F.col("ptr").alias("at"))
    end = spark.createDataFrame([(p, n, total)], "last int, lo long, at long")
    firsts = reached.unionByName(end).groupBy("last").agg(F.min("lo").alias("lo"), F.min("at").alias("at"))
    # parts + 1 rows; each begins the parts above the row before it.
    firsts = firsts.withColumn("first", F.coalesce(F.lag("last").over(Window.orderBy("last")) + 1, F.lit(0)))
    begins = firsts.select(F.explode(F.sequence("first", "last")).alias("part"), F.least("lo", F.lit(n)).alias("lo"), F.when(F.col("lo") > n, total).otherwise(F.col("at")).alias("at"))
    edges = begins.filter(F.col("part") < p).unionByName(end.withColumnRenamed("last", "part"))
    following = Window.orderBy("part")
    spans = edges.select("part", "lo", F.lead("lo").over(following).alias("hi"), (F.lead("at").over(following) - F.col("at")).alias("nnz"))
    return spans.filter(F.col("part") < p)


def part_bounds(counts: DataFrame, key: str, value: str, parts: int, n: int) -> list[int]:
    """Where the balanced parts begin, and n: parts + 1 numbers."""
    return [r.lo for r in balanced_parts(counts, key, value, parts, n).orderBy("part").collect()] + [n]


def part_of(key: Column, bounds: list[int]) -> Column:
    """The part k with bounds[k] <= key < bounds[k + 1], by bisection; empty parts take nothing."""

    def between(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < bounds[middle], between(low, middle)).otherwise(between(middle, high))

    return between(0, len(bounds) - 1)


def repartition_by_bounds(df: DataFrame, key: str, bounds: list[int]) -> DataFrame:
    """df with the rows of part k in partition k, whatever the keys' spread: no sample, no hash."""
    return df.repartitionById(len(bounds) - 1, part_of(F.col(key), bounds).cast("int"))


def grain_chunks(n: int, parts: int, grain: int | None = None) -> tuple[int, int]:
    """(rows a chunk, chunks): n / (8 parts) rows, at least one, unless grain says otherwise."""
    g = grain or max(1, n // (8 * max(1, parts)))
    return g, -(-n // g)


def chunk_plan(blocks: DataFrame, chunks: int) -> DataFrame:
    """chunk, rank, cnt, displ for blocks (rank, lo, hi): each block in `chunks` pieces, the remainder in front."""
    rows, c = F.col("hi") - F.col("lo"), F.col("chunk")
    base, rest = F.floor(rows / chunks), rows % chunks
    cut = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    return cut.select("chunk", "rank", (base + (c < rest).cast("long")).alias("cnt"), (F.col("lo") + base * c + F.least(c.cast("long"), rest)).alias("displ"))
