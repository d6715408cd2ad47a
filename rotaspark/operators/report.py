"""Reports over run measurements.

times: src, tag, n, nz, threads, ranks, chunks, rep, time_sec (null: no sample)
checksums: src, tag, n, nz, threads, checksum

Medians are exact and take cells of any size; lookups of baselines are joins of
aggregated tables, and nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotaspark.functions import metrics as m
from rotaspark.plans.schedule import prefix_sums

CELL = ["n", "nz"]
#: Display names by tag unless others are given; other tags show themselves.
NAMES = {"seq": "sequential", "base": "threads baseline", "ab": "threads A+B", "cde": "threads C+D+E", "pool": "thread pool", "omp": "OpenMP tasks", "cde_numa": "threads NUMA", "pool_numa": "pool NUMA", "omp_numa": "OpenMP NUMA", "mpi": "MPI", "mpiov": "MPI overlap"}
#: Which variant stands for the threaded versions, best first (fixed values).
PRIORITY = ("cde", "threads", "ab", "base")
#: Values of a setting at most: a grid is made of settings, not of measurements.
SETTINGS = 10_000


def _step(x: Column) -> Column:
    """A number's place on a coarse scale that keeps the order: 4096 steps each time it doubles."""
    up = lambda c: F.floor(F.log2(c) * 4096)
    return F.when(x > 0, up(x)).when(x == 0, F.lit(-(2**40))).otherwise(F.lit(-(2**41)) - up(-x)).cast("long")


def medians(times: DataFrame, *keys: str) -> DataFrame:
    """keys, time: the median of the samples there are, 6 places; null if there are none.

    No task holds a cell: equal samples are counted first, counts by coarse steps say in
    which step or two the middle lies, and only the values of these steps are ordered.
    """
    values = times.groupBy(*keys, F.col("time_sec").alias("__x")).agg(F.count("time_sec").alias("__n"))
    values = values.withColumn("__step", F.when(F.col("__x").isNotNull(), _step(F.col("__x"))))
    counts = values.groupBy(*keys, "__step").agg(F.sum("__n").alias("__n"))
    cell = Window.partitionBy(*keys)
    upto = lambda order: F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*keys, "__step", "__n", upto(cell.orderBy("__step")).alias("__upto"), F.sum("__n").over(cell).alias("__total"))
    low, high = F.floor((F.col("__total") - 1) / 2), F.floor(F.col("__total") / 2)
    has = lambda before, after: (before <= high) & (after > low)
    middle = placed.filter(has(F.col("__upto") - F.col("__n"), F.col("__upto")) | ((F.col("__total") == 0) & F.col("__step").isNull()))
    middle = middle.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__step").alias("__at"), (F.col("__upto") - F.col("__n")).alias("__before"), "__total")
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] + [F.col("__step").eqNullSafe(F.col("__at"))]
    met = values.join(middle, same).withColumn("__upto", F.col("__before") + upto(Window.partitionBy(*keys, "__step").orderBy("__x")))
    # A value that holds both middle places stands for both.
    there = has(F.col("__upto") - F.col("__n"), F.col("__upto"))
    return met.filter(there | F.col("__x").isNull()).groupBy(*keys).agg(F.round(F.avg("__x"), 6).alias("time"))


def pooled_baseline(times: DataFrame, tag: str = "seq") -> DataFrame:
    """n, nz, seq_time, n_samples over all sources together."""
    rows = times.filter(F.col("tag") == tag)
    return medians(rows, *CELL).withColumnRenamed("time", "seq_time").join(rows.groupBy(*CELL).agg(F.count("time_sec").alias("n_samples")), CELL)


def scaling(times: DataFrame, tag: str = "seq") -> DataFrame:
    """tag, n, nz, threads, time, speedup, efficiency, scalability, karp_flatt."""
    cells = medians(times.filter(F.col("tag") != tag), "tag", *CELL, "threads")
    one = F.max(F.when(F.col("threads") == 1, F.col("time"))).over(Window.partitionBy("tag", *CELL))
    met = cells.withColumn("__one", one).join(pooled_baseline(times, tag).drop("n_samples"), CELL, "left")
    sp, p = m.speedup(F.col("seq_time"), F.col("time")), F.col("threads")
    return met.select("tag", *CELL, "threads", "time", F.round(sp, 2).alias("speedup"), F.round(m.efficiency(sp, p), 2).alias("efficiency"), F.round(m.ratio(F.col("__one"), F.col("time")), 2).alias("scalability"), F.round(m.karp_flatt(sp, p), 4).alias("karp_flatt"))


def side_by_side(times: DataFrame, tags: list[str]) -> DataFrame:
    """n, nz, threads and a column of speedups for each tag."""
    return scaling(times).groupBy(*CELL, "threads").pivot("tag", tags).agg(F.first("speedup"))


def checksum_consistency(checksums: DataFrame, tags: list[str], *keys: str) -> DataFrame:
    """keys, reference, status.

    The reference is the first checksum there is in the order of tags; a later
    one that differs or is missing is a DIFF, and where all are missing they match.
    """
    order = F.array_position(F.array(*[F.lit(t) for t in tags]), F.col("tag"))
    found = checksums.filter(F.col("tag").isin(tags)).select(*keys, order.alias("__order"), "checksum")
    grid = found.select(*keys).distinct().withColumn("__order", F.explode(F.sequence(F.lit(1), F.lit(len(tags))).cast("array<bigint>")))
    full = grid.join(found.groupBy(*keys, "__order").agg(F.min("checksum").alias("checksum")), [*keys, "__order"], "left")
    first = F.min_by(F.when(F.col("checksum").isNotNull(), F.struct("__order", "checksum")), F.when(F.col("checksum").isNotNull(), F.col("__order")))
    heads = full.groupBy(*keys).agg(first.alias("__first"))
    later = (F.col("__order") > F.col("__first.__order")) & (F.coalesce("checksum", F.lit("")) != F.col("__first.checksum"))
    met = full.join(heads, list(keys)).groupBy(*keys).agg(F.max(F.col("__first.checksum")).alias("reference"), F.coalesce(F.max(later.cast("int")), F.lit(0)).alias("__bad"))
    return met.select(*keys, "reference", F.when(F.col("__bad") == 1, "DIFF").otherwise("match").alias("status"))


def spread(times: DataFrame, tag: str = "seq") -> DataFrame:
    """n, nz, n_sources, spread_percent between the sources' medians, where there are at least two."""
    each = medians(times.filter(F.col("tag") == tag), "src", *CELL)
    out = each.groupBy(*CELL).agg(F.count("time").alias("n_sources"), F.min("time").alias("low"), F.max("time").alias("high"))
    return out.filter("n_sources >= 2").select(*CELL, "n_sources", F.round(m.spread_percent(F.col("low"), F.col("high")), 2).alias("spread_percent"))


def head_to_head(times: DataFrame, a: str, b: str) -> DataFrame:
    """n, nz, threads, time_a, time_b, ratio = a / b over all cells either has."""
    cells = medians(times.filter(F.col("tag").isin(a, b)), "tag", *CELL, "threads")
    met = cells.groupBy(*CELL, "threads").agg(F.max(F.when(F.col("tag") == a, F.col("time"))).alias("time_a"), F.max(F.when(F.col("tag") == b, F.col("time"))).alias("time_b"))
    return met.withColumn("ratio", m.ratio(F.col("time_a"), F.col("time_b")))


def geometric_mean(ratios: DataFrame, *keys: str) -> DataFrame:
    """keys, geomean, n, slower, faster over the positive ratios; a ratio of 1 is neither."""
    r = F.col("ratio")
    return ratios.filter(r > 0).groupBy(*keys).agg(F.round(F.exp(F.avg(F.log(r))), 6).alias("geomean"), F.count(F.lit(1)).alias("n_ratios"), F.count_if(r > 1).alias("slower"), F.count_if(r < 1).alias("faster"))


def merged_grid(times: DataFrame, *keys: str) -> DataFrame:
    """The distinct values of each key over all sources, as rows key, value, in order."""
    parts = [times.select(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys]
    return reduce(DataFrame.unionByName, parts).filter("value is not null").distinct().orderBy("key", F.length("value"), "value")


def _few(column: str) -> Column:
    """The distinct values of a setting, in order; fails where there are too many for one."""
    values = F.sort_array(F.collect_set(column))
    return F.when(F.size(values) <= SETTINGS, values).otherwise(F.raise_error(F.lit(f"{column} has more than {SETTINGS} values")))


def grid(times: DataFrame, *keys: str) -> DataFrame:
    """Every combination of the keys' values, of which there are SETTINGS each at most."""
    out = times.agg(*[_few(k).alias(k) for k in keys])
    for k in keys:
        out = out.withColumn(k, F.explode(k))
    return out


def complete(times: DataFrame, *keys: str) -> DataFrame:
    """The grid with medians; cells that were never run have none."""
    return grid(times, *keys).join(medians(times, *keys), list(keys), "left")


def compare_runs(times: DataFrame, old: str, new: str) -> DataFrame:
    """tag, n, nz, threads, old_time, new_time, improvement (old / new), status: left join of two sources."""
    key = ["tag", *CELL, "threads"]
    a = medians(times.filter(F.col("src") == old), *key).withColumnRenamed("time", "old_time")
    b = medians(times.filter(F.col("src") == new), *key).withColumnRenamed("time", "new_time")
    met = a.join(b, key, "left")
    return met.select(*key, "old_time", "new_time", F.round(m.ratio(F.col("old_time"), F.col("new_time")), 4).alias("improvement"), F.when(F.col("old_time").isNull() | F.col("new_time").isNull(), "MISSING").otherwise("ok").alias("status"))


def leaderboard(times: DataFrame) -> DataFrame:
    """n, nz, src, tag, threads, speedup: the best configuration of each version, by speedup of 2 places, first one in a tie; best first."""
    cells = medians(times.filter("tag <> 'seq'"), "src", "tag", *CELL, "threads").join(pooled_baseline(times).drop("n_samples"), CELL)
    cells = cells.withColumn("speedup", F.round(m.speedup(F.col("seq_time"), F.col("time")), 2)).filter("speedup is not null")
    best = F.row_number().over(Window.partitionBy(*CELL, "src", "tag").orderBy(F.desc("speedup"), "threads"))
    top = cells.withColumn("__best", best).filter("__best = 1")
    return top.select(*CELL, "src", "tag", "threads", "speedup").orderBy(*CELL, F.desc("speedup"), "src", "tag")


def leaderboard_geometries(times: DataFrame, block: str = "mpi", overlap: str = "mpiov") -> DataFrame:
    """n, nz, src, version, config, speedup, time: the best configuration of each version.

    Versions of one process are ranked over threads; the two of several processes
    over ranks and threads, and over ranks, threads and chunks.  In a tie the first
    configuration by its name stays.
    """
    tag, number = F.col("tag"), lambda c: F.col(c).cast("string")
    name = F.concat(F.lit("r"), number("ranks"), F.lit("xt"), number("threads"))
    config = F.when(tag == block, name).when(tag == overlap, F.concat(name, F.lit("c"), number("chunks"))).otherwise(F.concat(F.lit("t"), number("threads")))
    version = F.when(tag == block, "mpi_block").when(tag == overlap, "mpi_overlap").otherwise(tag)
    rows = times.filter("tag <> 'seq'").withColumns({"version": version, "config": config}).filter("config is not null")
    order = F.when(F.col("version").startswith("mpi_"), 0).otherwise(F.col("threads")).alias("place")
    cells = medians(rows.withColumn("place", order), "src", "version", *CELL, "config", "place").join(pooled_baseline(times).drop("n_samples"), CELL)
    cells = cells.withColumn("speedup", F.round(m.speedup(F.col("seq_time"), F.col("time")), 2)).filter("speedup is not null")
    best = F.row_number().over(Window.partitionBy(*CELL, "src", "version").orderBy(F.desc("speedup"), "place", "config"))
    top = cells.withColumn("__best", best).filter("__best = 1")
    return top.select(*CELL, "src", "version", "config", "speedup", "time").orderBy(*CELL, F.desc("speedup"), "src", "version")


def geometry_report(times: DataFrame) -> DataFrame:
    """n, nz, variant, chunks, ranks, threads, cores, time, speedup, efficiency, gbs; in order of cores, variant, chunks."""
    variant = F.when(F.col("chunks").isNull(), "block").otherwise("overlap")
    cells = medians(times.filter("tag <> 'seq'").withColumn("variant", variant), *CELL, "variant", "chunks", "ranks", "threads")
    met = cells.join(pooled_baseline(times).drop("n_samples"), CELL, "left").withColumn("cores", F.col("ranks") * F.col("threads"))
    sp = m.speedup(F.col("seq_time"), F.col("time"))
    return met.select(*CELL, "variant", "chunks", "ranks", "threads", "cores", "time", F.round(sp, 2).alias("speedup"), F.round(m.efficiency(sp, F.col("cores")), 2).alias("efficiency"), F.round(m.bandwidth(F.col("nz"), F.col("time")), 1).alias("gbs")).orderBy(*CELL, "cores", "variant", "chunks")


def tolerance_verdicts(pairs: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """pairs (…, a, b) with rel_diff and verdict: PASS, FAIL, or RUNERR where a value is missing."""
    rel = m.relative_difference(F.col("a"), F.col("b"))
    return pairs.withColumn("rel_diff", rel).withColumn("verdict", F.when(F.col("rel_diff").isNull(), "RUNERR").when(F.col("rel_diff") <= tolerance, "PASS").otherwise("FAIL"))


def all_pass(verdicts: DataFrame) -> DataFrame:
    """One row: n_cases, ok."""
    return verdicts.agg(F.count(F.lit(1)).alias("n_cases"), F.coalesce(F.bool_and(F.col("verdict") == "PASS"), F.lit(True)).alias("ok"))


def checksum_against(checksums: DataFrame, reference: str, *keys: str) -> DataFrame:
    """keys, tag, checksum, reference, status against another tag's; a missing one never matches."""
    ref = checksums.filter(F.col("tag") == reference).groupBy(*keys).agg(F.max("checksum").alias("reference"))
    met = checksums.filter(F.col("tag") != reference).groupBy("tag", *keys).agg(F.max("checksum").alias("checksum")).join(ref, list(keys), "left")
    return met.withColumn("status", F.when(F.col("checksum") == F.col("reference"), "match").otherwise("DIFF"))


def checksum_pairs(checksums: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """n, nz, threads, base, other, base_checksum, other_checksum, status at the largest number of threads of all; a missing one never matches."""
    most = checksums.agg(F.max("threads").alias("__most"))
    top = checksums.join(F.broadcast(most), F.col("threads") == F.col("__most")).groupBy(*CELL, "threads", "tag").agg(F.max("checksum").alias("checksum"))  # one row is broadcast
    shapes_ = checksums.select(*CELL).distinct().join(F.broadcast(most)).select(*CELL, F.col("__most").alias("threads"))
    wanted = shapes_.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("base"), F.lit(b).alias("other")) for a, b in pairs])).alias("p")).select(*CELL, "threads", "p.*")
    for side in ("base", "other"):
        named = top.select(*CELL, "threads", F.col("tag").alias(side), F.col("checksum").alias(f"{side}_checksum"))
        wanted = wanted.join(named, [*CELL, "threads", side], "left")
    return wanted.withColumn("status", F.when(F.col("base_checksum") == F.col("other_checksum"), "match").otherwise("DIFF"))


def verification(logs: DataFrame, tag: str = "seq") -> DataFrame:
    """tag, n, nz, threads, time_sec, speedup, percent_efficiency, status (match, MISMATCH, FAILED) of scanned logs against the sequential one's."""
    ref = logs.filter(F.col("tag") == tag).groupBy(*CELL).agg(F.min("time_sec").alias("__time"), F.min("checksum").alias("__checksum"))
    met = logs.filter(F.col("tag") != tag).join(ref, CELL, "left")
    failed = F.coalesce(F.col("time_sec"), F.lit(0.0)) == 0
    sp = F.col("__time") / F.col("time_sec")
    status = F.when(failed, "FAILED").when(F.col("checksum") == F.col("__checksum"), "match").otherwise("MISMATCH")
    return met.select("tag", *CELL, "threads", "time_sec", F.when(~failed, F.round(sp, 2)).alias("speedup"), F.when(~failed, F.round(sp / F.col("threads") * 100, 1)).alias("percent_efficiency"), status.alias("status"))


def unfinished(times: DataFrame, reps: int, *keys: str, numeric: bool = True) -> DataFrame:
    """The grid's cells with fewer than reps samples; with numeric=False a run that failed counts as a sample too."""
    samples = F.count("time_sec") if numeric else F.count(F.lit(1))
    done = times.groupBy(*keys).agg(samples.alias("__n")).filter(F.col("__n") >= reps).select(*keys)
    return grid(times, *keys).join(done, list(keys), "left_anti")


def runnable(configs: DataFrame, cpus: int, nodes: int, ranks_per_node: Column) -> DataFrame:
    """Configurations whose threads fit the processors and whose ranks fit the nodes; adds nodes_needed."""
    needed = F.ceil(F.col("ranks") / ranks_per_node).cast("long")
    return configs.withColumn("nodes_needed", needed).filter((F.col("threads") <= cpus) & (F.col("nodes_needed") <= nodes))


def preferred_tag(times: DataFrame, order: tuple[str, ...] = PRIORITY) -> DataFrame:
    """src, n, nz and the first tag of the order that has samples."""
    place = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("tag"))
    some = times.filter(F.col("tag").isin(*order) & F.col("time_sec").isNotNull())
    return some.groupBy("src", *CELL).agg(F.min_by("tag", place).alias("tag"))


def display_names(times: DataFrame, names: dict[str, str] = NAMES) -> DataFrame:
    """tag, name."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return times.select("tag").distinct().select("tag", F.coalesce(table[F.col("tag")], F.col("tag")).alias("name"))


def classify_sources(times: DataFrame) -> DataFrame:
    """src, kind (mpi, shared, unrecognised), n_shapes."""
    has_ranks, has_threads = F.max("ranks") > 1, F.max("threads") >= 1
    return times.groupBy("src").agg(F.when(has_ranks, "mpi").when(has_threads, "shared").otherwise("unrecognised").alias("kind"), F.countDistinct(*CELL).alias("n_shapes"))


def shapes(times: DataFrame) -> DataFrame:
    """n, nz, density in order."""
    return times.select(*CELL).distinct().withColumn("density", m.density(F.col("nz"), F.col("n"))).orderBy(*CELL)


def within_budget(times: DataFrame, seconds: float) -> DataFrame:
    """src, tag, n_runs, used: the runs before which the source and tag had used less than so many seconds."""
    spent = times.select("src", "tag", "rep", "time_sec", F.coalesce("time_sec", F.lit(0.0)).alias("__time"))
    ran = prefix_sums(spent, "rep", "__time", by=("src", "tag"), kind="double").filter(F.col("ptr") < seconds)
    return ran.groupBy("src", "tag").agg(F.count(F.lit(1)).alias("n_runs"), F.round(F.sum("time_sec"), 4).alias("used"))


def sweep(shape_text: DataFrame, split_text: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, rpn, tpr, n, nz from texts `n:nz` and `rpn:tpr`, of which there are SETTINGS each at most."""
    number = lambda c, k, kind: F.split(c, ":")[k].cast(kind)
    splits, shapes_ = (t.select(F.col("text").alias(k)).agg(_few(k).alias(k)) for t, k in ((split_text, "split"), (shape_text, "shape")))
    met = nodes.join(F.broadcast(splits)).join(F.broadcast(shapes_))  # one row each
    met = met.withColumn("split", F.explode("split")).withColumn("shape", F.explode("shape"))
    return met.select("nodes", number("split", 0, "int").alias("rpn"), number("split", 1, "int").alias("tpr"), number("shape", 0, "long").alias("n"), number("shape", 1, "long").alias("nz"))


def first_checksum(checksums: DataFrame, tag: str = "seq") -> DataFrame:
    """n, nz, checksum: the first that is there, in the order of sources."""
    return checksums.filter((F.col("tag") == tag) & F.col("checksum").isNotNull()).groupBy(*CELL).agg(F.min_by("checksum", F.struct("src", "threads")).alias("checksum"))
