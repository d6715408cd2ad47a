"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table; only Spark touches the path, so any store it can open will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A session on one machine that names none (as in tests) gets a folder of its
    own; elsewhere a missing setting is an error, since no local folder is shared.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage with a copy that outlives any executor, and keeps what is
    used more than once from being computed more than once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.scratch = path
    return found


def discard(df: DataFrame) -> None:
    """Delete the files of a table that materialize wrote and nothing reads any more."""
    delete(df.sparkSession, df.scratch)


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str = "text") -> Column:
    """Null counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def salt(n: int, *columns: str) -> Column:
    """An even spread over n salts that is a function of the row alone."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns], F.lit(17)), F.lit(n)).cast("int")


def salted_groups(df: DataFrame, keys: list[str], id_col: str, salts: int, best: str = "max", sums: tuple[str, ...] = (), mins: tuple[str, ...] = ()) -> DataFrame:
    """df with group_keep (largest or smallest id of its keys), group_size, sums and smallest values, without gathering a group.

    Three aggregations of narrow rows: by (keys, salt), by keys over at most
    `salts` rows a group, and back by (keys, salt), so that a group that holds
    a third of all rows is dealt over `salts` tasks at every step.
    """
    pick = F.max if best == "max" else F.min
    salted = df.withColumn("__salt", salt(salts, id_col))
    slots = salted.groupBy(*keys, "__salt").agg(pick(id_col).alias("__top"), F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__{c}") for c in sums], *[F.min(c).alias(f"__min_{c}") for c in mins])
    totals = slots.groupBy(*keys).agg(pick("__top").alias("group_keep"), F.sum("__n").alias("group_size"), *[F.sum(f"__{c}").alias(f"group_{c}") for c in sums], *[F.min(f"__min_{c}").alias(f"group_min_{c}") for c in mins])
    slots = slots.select(*keys, "__salt").join(totals, keys)
    return salted.join(slots, [*keys, "__salt"]).drop("__salt")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], spread: str, salts: int, how: str = "inner") -> DataFrame:
    """big joined to small, which has few rows a key, when very many rows of big may share a key.

    small's rows are repeated once for each salt that big has with their key.
    """
    salted = big.withColumn("__salt", salt(salts, spread))
    wanted = salted.select(*keys, "__salt").distinct().join(small, keys)
    return salted.join(wanted, [*keys, "__salt"], how).drop("__salt")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of the first `keys` integer columns, of batches that are sorted by them.

    Meant for groups whose size the caller has bounded.
    """
    held: list[pa.RecordBatch] = []
    key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        begins = [0, *np.flatnonzero(new).tolist()]
        for b, e in zip(begins, [*begins[1:], batch.num_rows]):
            here = tuple(c[b].item() for c in columns)
            if here != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = here
            held.append(batch.slice(b, e - b))
    if held:
        yield key, pa.Table.from_batches(held)
