import duckdb
from pyspark.sql import functions as F

from rotaspark.operators import report, roofline
from rotaspark.queries import DUMPS, QUERIES, SQL, _dumps
from rotaspark.streaming.samples import running_cells, watch
from tests.oracle import difference

TIMES = "src string, tag string, n long, nz long, threads int, ranks int, chunks int, rep long, time_sec double"


def times(spark, rows):
    return spark.createDataFrame([(s, t, 10, 40, p, 1, None, k, x) for k, (s, t, p, x) in enumerate(rows)], TIMES)


def test_medians_speedups_and_serial_fraction(spark):
    df = times(spark, [("a", "seq", 1, 8.0), ("a", "seq", 1, None), ("b", "seq", 1, 12.0), ("a", "cde", 1, 10.0), ("a", "cde", 2, 4.0), ("a", "cde", 2, 6.0), ("a", "cde", 4, None), ("a", "cde", 8, 0.0)])
    got = {r.threads: r for r in report.scaling(df).collect()}
    assert (got[2].time, got[2].speedup, got[2].efficiency, got[2].scalability, got[2].karp_flatt) == (5.0, 2.0, 1.0, 2.0, 0.0)
    assert got[1].karp_flatt is None and got[1].speedup == 1.0
    assert got[4].time is None and got[4].speedup is None and got[8].speedup is None
    assert report.pooled_baseline(df).first().n_samples == 2
    assert report.spread(df).first().spread_percent == 50.0
    assert report.spread(df.filter("src = 'a'")).count() == 0


def test_medians_of_tied_samples(spark):
    """Equal samples count as one value however many there are; the middle may fall between two values."""
    df = spark.range(100_000).select((F.col("id") % 2).alias("n"), F.when(F.col("id") % 4 < 2, 1.5).otherwise(F.when(F.col("id") < 90_000, 2.5).otherwise(None)).alias("time_sec"))
    want = {r.n: r.m for r in df.groupBy("n").agg(F.median("time_sec").alias("m")).collect()}
    assert {r.n: r.time for r in report.medians(df, "n").collect()} == want == {0: 1.5, 1: 1.5}
    even = spark.createDataFrame([(1.0,)] * 500 + [(2.0,)] * 500, "time_sec double")
    assert report.medians(even).first().time == 1.5
    odd = spark.createDataFrame([(-1.0,), (0.0,), (0.0,), (-0.0,), (None,), (3e-9,), (7e300,)], "time_sec double")
    assert report.medians(odd).first().time == 0.0
    assert report.medians(odd.limit(0), "time_sec").count() == 0


def test_ratio_of_one_is_neither(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (0.5,), (None,), (0.0,)], "ratio double")
    r = report.geometric_mean(df).first()
    assert (r.geomean, r.n_ratios, r.slower, r.faster) == (1.0, 3, 1, 1)


def test_first_configuration_wins_ties(spark):
    df = times(spark, [("a", "seq", 1, 10.0), ("a", "cde", 4, 4.999), ("a", "cde", 2, 5.001), ("a", "ab", 2, 4.0)])
    assert [(r.tag, r.threads, r.speedup) for r in report.leaderboard(df).collect()] == [("ab", 2, 2.5), ("cde", 2, 2.0)]


def test_checksum_rules(spark):
    schema = "src string, tag string, n long, nz long, threads int, checksum string"
    df = spark.createDataFrame(
        [("a", "x", 1, 1, 1, None), ("a", "y", 1, 1, 1, "q"), ("a", "z", 1, 1, 1, "q"), ("a", "x", 1, 1, 2, "q"), ("a", "y", 1, 1, 2, None), ("a", "z", 1, 1, 2, "q"), ("a", "x", 1, 1, 3, None)], schema
    )
    got = {r.threads: (r.reference, r.status) for r in report.checksum_consistency(df, ["x", "y", "z"], "threads").collect()}
    assert got == {1: ("q", "match"), 2: ("q", "DIFF"), 3: (None, "match")}
    against = {(r.tag, r.threads): r.status for r in report.checksum_against(df, "x", "threads").collect()}
    assert against[("y", 1)] == "DIFF" and against[("z", 2)] == "match"
    assert report.first_checksum(df.withColumn("tag", F.lit("seq"))).first().checksum == "q"


def test_grid_missing_and_resume(spark):
    df = times(spark, [("a", "x", 1, 1.0), ("a", "x", 2, None), ("b", "x", 1, 2.0), ("a", "y", 1, 1.0), ("a", "y", 1, 1.0)])
    cells = {(r.tag, r.threads): r.time for r in report.complete(df, "tag", "threads").collect()}
    assert cells == {("x", 1): 1.5, ("x", 2): None, ("y", 1): 1.0, ("y", 2): None}
    assert {(r.tag, r.threads) for r in report.unfinished(df, 2, "tag", "threads").collect()} == {("x", 2), ("y", 2)}
    got = {(r.tag, r.threads): r.status for r in report.compare_runs(df, "a", "b").collect()}
    assert got == {("x", 1): "ok", ("x", 2): "MISSING", ("y", 1): "MISSING"}


def test_verdicts(spark):
    df = spark.createDataFrame([(1.0, 1.0 + 1e-10), (1.0, 1.1), (None, 1.0)], "a double, b double")
    got = report.tolerance_verdicts(df)
    assert [r.verdict for r in got.collect()] == ["PASS", "FAIL", "RUNERR"]
    assert report.all_pass(got).first().ok is False
    assert report.all_pass(got.limit(1)).first().ok is True


def test_sums_of_a_dump_keep_the_order_of_the_file(spark, tmp_path):
    """Lines of an order lie in many tasks, and ties at the tolerance hang on the last bit: as the SQL in one thread."""
    db = duckdb.connect()
    db.sql("SET threads = 1")
    db.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.01/lineitem.parquet') TO '{tmp_path}/lineitem.parquet' (ROW_GROUP_SIZE 2048)")
    db.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted((i, float(a), float(c)) for i, a, c in db.sql(f"WITH {DUMPS} SELECT i, a.v, b.v FROM a JOIN b USING (i)").fetchall())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        a, c = _dumps(spark, str(tmp_path))
        got = sorted(tuple(r) for r in a.join(c.withColumnRenamed("v", "w"), "i").collect())
        verdicts = difference(QUERIES["q_tolerance"](spark, str(tmp_path)), SQL["q_tolerance"], db)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == want and verdicts is None


def test_names_priority_budget_sweep(spark):
    df = times(spark, [("a", "base", 1, 3.0), ("a", "ab", 1, 4.0), ("a", "cde", 1, None), ("a", "new", 1, 5.0)])
    assert report.preferred_tag(df).first().tag == "ab"
    names = {r.tag: r.name for r in report.display_names(df).collect()}
    assert names["new"] == "new" and names["cde"] == "threads C+D+E"
    one = df.withColumn("tag", F.lit("t"))
    assert report.within_budget(one, 5).first().n_runs == 2
    text = spark.createDataFrame([("5:20",)], "text string")
    split = spark.createDataFrame([("2:8",), ("4:4",)], "text string")
    assert report.sweep(text, split, spark.createDataFrame([(1,), (2,)], "nodes int")).count() == 4


def test_roofline(spark):
    k = spark.createDataFrame([(4_000_000, 100_000, 1.0, 287.3, 49.2)], "nnz long, n long, seconds double, peak_gflops double, peak_gbs double")
    r = roofline.roofline(k).first()
    assert r.bound == "memory" and abs(r.ridge - 5.839431) < 1e-6 and abs(r.ai - 8_200_000 / 81_600_000) < 1e-6


def test_stream_of_samples(spark, tmp_path):
    df = times(spark, [("a", "x", 1, 1.0), ("a", "x", 1, 3.0), ("a", "x", 2, None)])
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = running_cells(watch(spark, str(tmp_path / "in"), TIMES)).writeStream.format("memory").queryName("cells").outputMode("complete").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    got = {r.threads: (r.n_samples, r.fastest, r.mean) for r in spark.table("cells").collect()}
    assert got == {1: (2, 1.0, 2.0), 2: (0, None, None)}


def test_medians_of_ties_nulls_and_any_sign(spark):
    import random
    import statistics

    rng = random.Random(1)
    cells = {
        ("a", None): [0.0, -0.0, 1.0], ("b", 1): [None, None], ("c", 1): [-5.0, -1e-9, 3.0, 1e12], ("d", 2): [2.0] * 7, ("e", 2): [7.0, None],
        ("f", 3): [rng.choice([1.0, 1.0001, 2.5, -3.0, 0.0]) for _ in range(200)], ("g", 3): [rng.gauss(0, 100) for _ in range(301)],
    }
    rows = [(tag, n, x) for (tag, n), xs in cells.items() for x in xs]
    got = {(r.tag, r.n): r.time for r in report.medians(spark.createDataFrame(rows, "tag string, n int, time_sec double"), "tag", "n").collect()}
    want = {k: (round(statistics.median(v), 6) if (v := [x for x in xs if x is not None]) else None) for k, xs in cells.items()}
    assert got.keys() == want.keys()
    assert all(got[k] is None if want[k] is None else abs(got[k] - want[k]) <= 1e-6 * max(1, abs(want[k])) for k in want)
