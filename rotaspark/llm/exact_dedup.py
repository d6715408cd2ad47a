"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts by their first HEAD
characters and their digest (what is sampled is bounded, whatever the texts), so
equal texts come to stand next to each other in one sorted partition.  Each row is
compared in full with the one before it; where it differs a new run begins, and
runs give the largest id and the size of a group.

A text that a sample finds in more than its share of the rows is dealt over
several places by a salt of the id, in proportion to its share.  Such texts are few (at
most SHARES a partition), and so are their runs: these are compared in full once more, and merged.
A text that the sample misses only makes a partition larger.

Null text is the empty text, and texts of any length are compared whole.  An empty
table gives an empty result.  Ids may be null or repeat: of rows with the same text and
the same largest id one is kept, the first by its other columns.  Other
columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from rotaspark.llm.common import materialize, read, shuffle_partitions, text_of

#: Characters of a text that its place in the order starts with.
HEAD = 48
#: A text is hot with more than this part of a partition's rows; rows sampled a partition.
SHARES, SAMPLED = 4, 400
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(column: str = "text") -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text_of(column), UPPER, LOWER)


def hot_texts(rows: DataFrame, parts: int) -> DataFrame:
    """digest, places: texts with more than a share of a partition's rows, and over how many places they are dealt.

    At most SHARES * parts rows.
    """
    total = rows.count()
    part = min(1.0, SAMPLED * parts / max(1, total))
    some = rows.sample(part, 17) if part < 1 else rows
    found = some.groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
    size = part * total / parts  # of a partition, in sampled rows
    return found.filter(F.col("n") > max(1.0, size / SHARES)).select("digest", F.ceil(F.col("n") / max(1.0, size) + 1).cast("int").alias("places"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id is kept.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(text_col).alias("norm"))
    rows = rows.withColumns({"head": F.substring("norm", 1, HEAD), "digest": F.unhex(F.sha2("norm", 256))})
    hot = F.broadcast(hot_texts(rows.select("digest"), n))  # SHARES * n rows at most
    rows = rows.join(hot, "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.col("places")), F.lit(-1)).cast("int"))
    sorted_rows = rows.drop("places").repartitionByRange(n, "head", "digest", "salt")
    # The range partitioning serves as the windows' distribution: no second shuffle of texts.
    place = ["head", "digest", "salt"]
    order = Window.partitionBy(*place).orderBy("norm", F.desc_nulls_last("doc_id"))
    before = F.lag("norm").over(order)
    compared = sorted_rows.withColumn("first", before.isNull() | (before != F.col("norm")))
    numbered = compared.withColumn("run", F.sum(F.col("first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*place, "run")
    narrow = numbered.select("doc_id", *place, "run", "first", F.when(F.col("first") & (F.col("salt") >= 0), F.col("norm")).alias("norm"))
    narrow = narrow.withColumns({"top": F.max("doc_id").over(run), "size": F.count(F.lit(1)).over(run)})
    narrow = materialize(narrow.withColumn("head", F.when(F.col("salt") >= 0, F.col("head"))), "exact")
    # Runs of hot texts, one for each of their places.
    runs = narrow.filter(F.col("first") & (F.col("salt") >= 0)).select(*place, "run", "norm", "top", "size")
    places = Window.partitionBy("digest").orderBy("norm", "salt")
    above = F.lag("norm").over(places)
    runs = runs.withColumn("new", (above.isNull() | (above != F.col("norm"))).cast("int")).withColumn("text", F.sum("new").over(places.rowsBetween(Window.unboundedPreceding, 0)))
    group = Window.partitionBy("digest", "text")
    winner = F.row_number().over(group.orderBy(F.desc_nulls_last("top"), "salt")) == 1
    merged = runs.select(*place, "run", F.max("top").over(group).alias("all_top"), F.sum("size").over(group).alias("all_size"), winner.alias("winner"))
    met = narrow.drop("norm").join(F.broadcast(merged), [*place, "run"], "left")  # as many rows as hot texts have places
    return met.select(
        "doc_id",
        F.when(F.col("winner").isNull(), F.col("top")).otherwise(F.col("all_top")).alias("keep_id"),
        F.coalesce("all_size", "size").alias("group_size"),
        (F.col("first") & F.coalesce("winner", F.lit(True))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns."""
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias("__id"), F.unhex("text_sha256").alias("__digest"))
    same = docs.withColumn("__digest", F.unhex(F.sha2(normalised(), 256)))
    joined = same.join(kept.withColumnRenamed("__digest", "__kept"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__kept")), "left_semi")
    ordered = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    once = Window.partitionBy("doc_id", "__digest").orderBy(*ordered)
    return joined.withColumn("__place", F.row_number().over(once)).filter("__place = 1").select(*docs.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


OP7_SQL = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""
