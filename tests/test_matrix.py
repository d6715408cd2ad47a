import math
import os
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rotaspark.functions.bits import GAMMA, MASK, MULTIPLIERS, draw, mix, mixed, unit, units, with_bits, with_mix
from rotaspark.operators import grid, iterate, linear, roofline
from rotaspark.operators.iterate import power_iterate
from rotaspark.plans import schedule
from rotaspark.plans.apportion import apportion, place_of
from rotaspark.plans.pattern import Pattern, validate
from rotaspark.queries import QUERIES, SQL
from rotaspark.sources import generated
from rotaspark.sources.results import merge_configs, scan_config, scan_dump, scan_logs, scan_times, write_config, write_dump
from rotaspark.sources.scratch import materialize
from tests.oracle import connect, difference

#: n, nz, seed, mode, smallest and largest row, rayleigh, first element, sum of x after 500 iterations.
GOLDEN = [
    (1, 1, 111, "regular", 1, 1, 1.0, 1.0, 1.0),
    (4, 16, 111, "irregular", 4, 4, 1.73814069052638, 0.481368413948, 1.99865738281),
    (16, 200, 7, "irregular", 2, 16, 2.84520916806669, 0.264447539521, 3.79707186518),
    (63, 500, 111, "irregular", 2, 63, 2.04331319043048, 0.0746495104822, 6.24911413467),
    (64, 512, 111, "irregular", 2, 64, 2.10319904594754, 0.0673133757142, 6.49453590724),
    (64, 512, 111, "regular", 8, 8, 2.41483232296914, 0.119769615653, 7.98123908083),
    (210, 3000, 111, "irregular", 3, 210, 2.70307158793824, 0.0680170156511, 11.5022026253),
    (1000, 20000, 111, "irregular", 3, 350, 3.04545576384336, 0.0303855585876, 23.6667461203),
]


def test_generator_vectors(spark):
    one = F.lit(1).cast("long")
    row = spark.range(1).select(draw(F.lit(111).cast("long"), one), mix(one), mix(F.lit(2).cast("long")), unit(draw(F.lit(111).cast("long"), one))).first()
    assert [x % 2**64 for x in row[:3]] == [0xF9364C1F89270349, 0x5692161D100B05E5, 0xDBD238973A2B148A]
    assert row[3] == (0xF9364C1F89270349 >> 11) * 2.0**-53
    found = [r.v for r in generated.raw_vector(spark, 3).orderBy("i").collect()]
    assert found == [0.3362305835600484, 0.566904920010844, 0.31665195232946886]


def test_tiny_matrix(spark):
    rows = generated.matrix(spark, 8, 24).orderBy("row", "pos").collect()
    assert [sum(r.row == i for r in rows) for i in range(8)] == [8, 5, 2, 2, 2, 2, 2, 1]
    assert [r.col for r in rows[:13]] == [0, 3, 6, 1, 4, 7, 2, 5, 1, 2, 7, 4, 6]
    assert np.allclose([r.val for r in rows[8:13]], [0.82096213327, 0.399748270393, 0.293455739815, 0.091364320365, 0.267878304063], atol=1e-11)


def plain_run(entries, x, n, iterations=500, epoch=25):
    """The loop one element after the other, in numpy: (rayleigh, x)."""
    row, col, val = (np.array([r[k] for r in entries]) for k in ("row", "col", "val"))
    x = np.array(x) / np.linalg.norm(x)

    def product(x, shift):
        y = np.zeros(n)
        np.add.at(y, (row + shift) % n, val * x[col])
        return y

    for k in range(iterations):
        y = product(x, schedule.shift_at(k, n, epoch))
        x = y / np.linalg.norm(y)
    return float(x @ product(x, schedule.final_shift(n, iterations, epoch))), x


@pytest.mark.parametrize("case", GOLDEN, ids=lambda c: f"{c[0]}-{c[1]}-{c[3]}")
def test_golden_matrices(spark, case):
    n, nz, seed, mode, least, most, value, first, total = case
    entries = generated.matrix(spark, n, nz, mode, seed).collect()
    sizes = np.bincount([r.row for r in entries], minlength=n)
    assert (len(entries), sizes.min(), sizes.max()) == (nz, least, most)
    assert len({(r.row, r.col) for r in entries}) == nz
    got, x = plain_run(entries, [r.v for r in generated.raw_vector(spark, n, seed).orderBy("i").collect()], n)
    assert math.isclose(got, value, rel_tol=1e-9)
    assert math.isclose(x[0], first, rel_tol=1e-9) and math.isclose(x.sum(), total, rel_tol=1e-9)


def test_iterated_golden(spark):
    n, nz = 16, 200
    found = power_iterate(generated.matrix(spark, n, nz, "irregular", 7), generated.raw_vector(spark, n, 7), n)
    assert math.isclose(found.result.first().rayleigh, 2.84520916806669, rel_tol=1e-9)
    assert found.result.first().final_row_shift == 9


def test_long_rows_and_small_batches():
    from rotaspark.sources.generated import entries

    for n, nz in ((40, 900), (7, 49), (1, 1), (90, 1200)):
        pattern = Pattern(n, nz)
        whole = [np.concatenate(c) for c in zip(*entries(0, n, pattern, 5))]
        for batch in (1, 3, 16, 100):
            small = [np.concatenate(c) for c in zip(*entries(0, n, pattern, 5, batch))]
            assert all((a == b).all() for a, b in zip(whole[:3], small[:3])) and np.allclose(whole[3], small[3], rtol=1e-13)


def test_strategies_agree(spark):
    n = 40
    a = generated.matrix(spark, n, 200).cache()
    x0 = generated.raw_vector(spark, n)
    value, want = plain_run(a.collect(), [r.v for r in x0.orderBy("i").collect()], n, 7, 3)
    for s in ("barrier", "grid"):
        found = power_iterate(a, x0, n, 7, 3, s)
        row = found.result.first()
        assert math.isclose(row.rayleigh, value, rel_tol=1e-9) and row.final_row_shift == schedule.final_shift(n, 7, 3)
        assert np.allclose([r.v for r in found.x.orderBy("i").collect()], want, rtol=1e-9)
    with pytest.raises(ValueError):
        power_iterate(a, x0, n, strategy="other")
    with pytest.raises(ValueError):
        power_iterate(a, x0, 10**9, strategy="barrier")


def test_bits_do_not_depend_on_tasks(spark):
    n = 300
    a = generated.matrix(spark, n, 4000)
    runs = [power_iterate(a, generated.raw_vector(spark, n), n, 60, 25, "barrier", tasks) for tasks in (1, 3, 8)]
    assert len({linear.checksum(r.x).first().checksum for r in runs}) == 1
    assert len({r.result.first().rayleigh for r in runs}) == 1


def test_bits_of_the_trade_run(spark, sf):
    """From the line items to the final vector nothing depends on how rows are dealt."""
    before, sums = spark.conf.get("spark.sql.shuffle.partitions"), set()
    for n in ("1", "3", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(20_000 * int(n)))
        sums.add(QUERIES["l_power_bits"](spark, sf).first().checksum)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(sums) == 1


def test_barrier_stages_go_on_where_the_last_ended(spark, monkeypatch):
    n = 40
    a, x0 = generated.matrix(spark, n, 200), generated.raw_vector(spark, n)
    once = power_iterate(a, x0, n, 23, 4, "barrier", 3)
    monkeypatch.setattr(iterate, "SAVED", 5)
    often = power_iterate(a, x0, n, 23, 4, "barrier", 2)
    assert once.result.first() == often.result.first()
    assert sorted(map(tuple, once.x.collect())) == sorted(map(tuple, often.x.collect()))


LOST = """
import os, sys
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession
from rotaspark.operators import iterate, linear
from rotaspark.operators.ring import Ring
from rotaspark.sources import generated

marker = sys.argv[1]

class OnceLost(Ring):
    rounds = 0

    def gather(self, y):
        self.rounds += 1
        if self.rank == 1 and self.rounds == 9 and not os.path.exists(marker):
            open(marker, "w").close()
            os._exit(1)
        super().gather(y)

spark = SparkSession.builder.master("local[4, 4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
a, x0 = generated.matrix(spark, 40, 200), generated.raw_vector(spark, 40)
if sys.argv[2] == "lost":
    iterate.Ring = OnceLost
found = iterate.power_iterate(a, x0, 40, 23, 4, "barrier", 3)
print("SUM", linear.checksum(found.x).first().checksum)
"""


def test_a_lost_worker_costs_a_stage_only(tmp_path):
    """A worker dies in the middle of the exchange; the stage starts again and gives the same bits."""
    sums = []
    for how in ("whole", "lost"):
        script = tmp_path / "lost.py"
        script.write_text(LOST.replace("from rotaspark", "sys.path.insert(0, %r)\nfrom rotaspark" % os.getcwd(), 1))
        run = subprocess.run([sys.executable, str(script), str(tmp_path / "marker"), how], capture_output=True, text=True, timeout=300)
        sums += [x for x in run.stdout.splitlines() if x.startswith("SUM")] or [run.stderr[-2000:]]
    assert (tmp_path / "marker").exists() and sums[0] == sums[1] and sums[0].startswith("SUM")


WEIGHED = """
import resource, sys
from pyspark.sql import SparkSession
from rotaspark.operators import iterate
from rotaspark.operators.ring import Ring
from rotaspark.sources import generated

PLACE = sys.argv[1]

def peak():
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024

class Weighed(Ring):
    def __init__(self, context, bounds):
        super().__init__(context, bounds)
        self.before = peak()

    def __exit__(self, *error):
        with open(PLACE, "w") as out:
            out.write(str(peak() - self.before))
        super().__exit__(*error)

n, nz = 3000, 3_000_000
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").config("spark.python.worker.reuse", "false").getOrCreate()
iterate.Ring = Weighed
iterate.power_iterate(generated.matrix(spark, n, nz), generated.raw_vector(spark, n), n, 3, 2, "barrier", 1)
"""


def test_a_task_holds_few_bytes_an_entry(tmp_path):
    """12 bytes an entry and what a batch takes, not the copies of whole columns."""
    script = tmp_path / "weighed.py"
    script.write_text(WEIGHED.replace("from rotaspark", "sys.path.insert(0, %r)\nfrom rotaspark" % os.getcwd(), 1))
    run = subprocess.run([sys.executable, str(script), str(tmp_path / "peak")], capture_output=True, text=True, timeout=300)
    assert (tmp_path / "peak").exists(), run.stderr[-2000:]
    assert int((tmp_path / "peak").read_text()) < 40 * 3_000_000


def test_many_entries_a_task_go_over_the_grid(spark, monkeypatch):
    a, x0 = generated.matrix(spark, 40, 200), generated.raw_vector(spark, 40)
    taken = []
    monkeypatch.setattr(iterate, "_grid", lambda *given: taken.append("grid"))
    monkeypatch.setattr(iterate, "_barrier", lambda *given: taken.append("barrier"))
    for most in (100, 99):
        monkeypatch.setattr(iterate, "TASK_ENTRIES", most)
        iterate.power_iterate(a, x0, 40, 7, 3, tasks=2)
    assert taken == ["barrier", "grid"]


def test_products_over_a_grid(spark, monkeypatch):
    """Any number of ranges and small records give the product; the matrix is joined where it lies."""
    n = 60
    a = materialize(generated.matrix(spark, n, 700), "matrix")
    x = generated.raw_vector(spark, n)
    entries, values = a.collect(), np.array([r.v for r in x.orderBy("i").collect()])
    for sides, record in (((1, 1), 1000), ((3, 4), 1000), ((5, 2), 7), ((6, 5), 3)):
        monkeypatch.setattr(grid, "RECORD_ENTRIES", record)
        g = grid.Grid(a, n, sides)
        for shift in (0, 17):
            want = np.zeros(n)
            np.add.at(want, [(r.row + shift) % n for r in entries], [r.val * values[r.col] * 0.5 for r in entries])
            y = g.product(g.pieces(x), shift, 0.5)
            got = {r.i: r.v for r in g.vector(y).collect()}
            assert got.keys() == set(range(n)) and np.allclose([got[i] for i in range(n)], want, rtol=1e-12)
            assert math.isclose(g.length(y), np.linalg.norm(want), rel_tol=1e-12)
        g.drop()
    g = grid.Grid(a, n, (2, 3))
    y = g.product(g.pieces(x))
    y.collect()
    plan = y._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    lines = plan.split("\n")
    scan = next(k for k, line in enumerate(lines) if g.name in line or "vals" in line and "FileScan" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    above, at = [], depth(lines[scan])
    for line in reversed(lines[:scan]):
        if depth(line) < at:
            above.append(line)
            at = depth(line)
    until_join = above[: next(k for k, line in enumerate(above) if "Join" in line)]
    assert not any("Exchange" in line for line in until_join)
    g.drop()


def test_rows_by_balanced_bounds(spark):
    sizes = [5, 0, 0, 9, 1, 1, 1, 3, 20, 0, 2, 7, 7, 7]
    rows = spark.createDataFrame([(i, k) for i, size in enumerate(sizes) for k in range(size)], "row long, k int")
    counts = spark.createDataFrame(list(enumerate(sizes)), "row long, k long")
    for parts in (1, 3, 5, 9):
        bounds = schedule.part_bounds(counts, "row", "k", parts, len(sizes))
        dealt = schedule.repartition_by_bounds(rows, "row", bounds)
        assert dealt.rdd.getNumPartitions() == parts
        found = dealt.select(F.spark_partition_id().alias("p"), "row").distinct().collect()
        assert all(bounds[r.p] <= r.row < bounds[r.p + 1] for r in found) and len(found) == sum(s > 0 for s in sizes)
        largest = dealt.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert largest <= sum(sizes) / parts + max(sizes)


def test_skewed_matrix_is_dealt_evenly(spark):
    """The first tenth of the rows has over half of the entries."""
    n, nz = 2000, 60_000
    a = generated.matrix(spark, n, nz)
    bounds = schedule.part_bounds(generated.pattern_counts(spark, n, nz), "row", "k", 8, n)
    sizes = [r["count"] for r in schedule.repartition_by_bounds(a, "row", bounds).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 1.1 * nz / 8


SPECIAL = [0.0, -0.0, 1.0, -1.5, 0.1, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1e300, 1e-300, 2.0**52, 2.0**53 + 2, 1 - 2.0**-53, 3.0, float("inf"), float("-inf"), float("nan")]


def test_bits_in_columns(spark):
    rng = np.random.default_rng(3)
    values = SPECIAL + (rng.standard_normal(500) * 10.0 ** rng.integers(-300, 300, 500)).tolist() + [s * 2.0**k for k in range(-1074, 1024, 7) for s in (1, -1)] + [np.nextafter(2.0**k, 0) for k in range(-1000, 1000, 9)]
    df = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "i long, v double")
    got = [r.b for r in with_bits(df, "v", "b").orderBy("i").collect()]
    assert got == np.array(values, np.float64).view(np.int64).tolist()
    numbers = [0, 1, -1, 2**63 - 1, -(2**63), *rng.integers(-(2**63), 2**63, 500).tolist()]
    longs = spark.createDataFrame([(k, int(x)) for k, x in enumerate(numbers)], "i long, x long")
    got = [r.t for r in with_mix(longs, "x", "t").orderBy("i").collect()]
    assert got == mixed(np.array(numbers, np.int64).view(np.uint64)).view(np.int64).tolist()


def test_exact_sums(spark):
    rng = np.random.default_rng(4)
    groups = {
        "wide": (rng.standard_normal(2000) * 10.0 ** rng.integers(-200, 200, 2000)).tolist(), "cancels": [1e16, 1.0, -1e16, 1e-30, 5e-324], "tiny": [5e-324] * 7, "tie": [1.0, 2.0**-53, 2.0**-53],
        "inf": [1.0, float("inf")], "nan": [float("inf"), float("-inf")], "zero": [0.0, -0.0], "large": [1.7976931348623157e308, -1.7976931348623157e308, 3.5], "over": [1.7976931348623157e308] * 2,
    }
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("none", None), ("tie", None)], "k string, v double")
    for parts in (1, 5):
        got = {r.k: r.total for r in linear.exact_sums(df.repartition(parts), "v", "k").collect()}
        assert got.pop("over") == float("inf") and math.isnan(got.pop("nan"))
        assert got == {k: math.fsum(vs) for k, vs in groups.items() if k not in ("over", "nan")}
    assert linear.exact_sums(df.limit(0), "v").first().total is None
    x = spark.createDataFrame([(0, 3.0), (1, 4.0)], "i long, v double")
    assert linear.exact_norm(x).first().norm == 5.0 and linear.exact_dot(x, x).first().dot == 25.0
    assert sorted(r.v for r in linear.normalize_exactly(x).collect()) == [3 * (1 / 5), 4 * (1 / 5)]
    assert linear.normalize_exactly(x.withColumn("v", F.lit(0.0))).first().v == 0.0


def test_empty_rows_are_zero(spark):
    a = spark.createDataFrame([(0, 1, 1.0), (2, 0, 1.0)], "row long, col long, val double")
    x0 = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0)], "i long, v double")
    want = None
    for s in ("barrier", "grid"):
        got = power_iterate(a, x0, 3, 2, 25, s)
        x = {r.i: r.v for r in got.x.collect() if r.v}
        want = want or x
        assert x.keys() == want.keys() and all(math.isclose(x[k], want[k]) for k in x)


def brute_pattern(n, nz):
    weight = [(160 if i % 16 < 2 else 40) if i < n // 10 else (20 if i % 16 == 0 else 10) if i < n // 4 else 3 if i < 3 * n // 5 else 1 for i in range(n)]
    total, extras = sum(weight), nz - n
    ideal = [np.longdouble(extras) * np.longdouble(w) / np.longdouble(total) for w in weight]
    share = [min(int(np.floor(x)), n - 1) for x in ideal]
    k = [1 + s for s in share]
    left = extras - sum(share)
    for i in sorted((i for i in range(n) if share[i] < n - 1), key=lambda i: (-(ideal[i] - np.floor(ideal[i])), i)):
        if left and k[i] < n:
            k[i] += 1
            left -= 1
    for i in range(n):
        add = min(n - k[i], left)
        k[i] += add
        left -= add
    return k


def shares(weights, units, cap):
    """One unit after the other."""
    n, extras, total = len(weights), units - len(weights), max(1, sum(weights))
    k = [min(extras * w // total, cap - 1) for w in weights]
    left = extras - sum(k)
    for i in sorted((i for i in range(n) if extras * weights[i] // total < cap - 1), key=lambda i: (-(extras * weights[i] % total), i))[:left]:
        k[i] += 1
    left = extras - sum(k)
    for i in range(n):
        add = min(cap - 1 - k[i], left)
        k[i] += add
        left -= add
    return [1 + x for x in k]


@pytest.mark.parametrize("bins", [3, 4096])
def test_apportion(spark, monkeypatch, bins):
    monkeypatch.setattr(place_of, "__defaults__", (bins,))
    rng = np.random.default_rng(bins)
    cases = [([5], 1), ([0, 0, 0], 7), ([1, 1, 1, 1], 6), ([10**12, 1, 10**11, 3], 9), ([7] * 40, 59), ([100, 0, 0, 0, 1], 25), ([9, 1, 1, 1], 16)]
    cases += [(w := rng.integers(0, 9, n).tolist(), int(rng.integers(n, n * n + 1))) for n in (12, 30)]
    for weights, units in cases:
        n = len(weights)
        df = spark.createDataFrame([(i, int(w)) for i, w in enumerate(weights)], "row long, w long")
        got = [r.nnz for r in apportion(df, n, units).orderBy("row").collect()]
        assert got == shares(weights, units, n) and sum(got) == units
    with pytest.raises(ValueError, match="do not go"):
        apportion(df, n, n - 1)
    with pytest.raises(ValueError, match="each row"):
        apportion(df.filter("row > 0"), n, n)


def test_apportioned_classes_are_the_closed_form(spark):
    n, nz = 300, 5000
    weight = F.when(F.col("id") < n // 10, F.when(F.col("id") % 16 < 2, 160).otherwise(40)).when(F.col("id") < n // 4, F.when(F.col("id") % 16 == 0, 20).otherwise(10)).when(F.col("id") < 3 * n // 5, 3).otherwise(1)
    df = spark.range(n).select(F.col("id").alias("row"), weight.alias("w"))
    assert [r.nnz for r in apportion(df, n, nz).orderBy("row").collect()] == [Pattern(n, nz).nnz(i) for i in range(n)]


def test_length_is_taken_while_the_product_is_written(spark):
    a = spark.createDataFrame([(0, 1, 3.0), (1, 0, 2.0), (2, 2, 0.0)], "row long, col long, val double")
    x = spark.createDataFrame([(0, 2.0), (1, 1.0), (2, 9.0)], "i long, v double")
    y, size = linear.spmv_measured(a, x, 3, 1)
    assert size == 5.0 and {r.i: r.v for r in y.collect()} == {1: 3.0, 2: 4.0, 0: 0.0}
    last = iterate.unrolled(a, x, 3, 2, 25)
    assert last._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert linear.spmv_measured(a, x.limit(0), 3)[1] == 0.0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 120), st.data())
def test_pattern_in_closed_form(n, data):
    nz = data.draw(st.integers(n, n * n))
    p = Pattern(n, nz)
    want = brute_pattern(n, nz)
    assert [p.nnz(i) for i in range(n)] == want
    assert [p.row_ptr(i) for i in range(n + 1)] == list(np.cumsum([0, *want])) == p.row_ptr(np.arange(n + 1)).tolist()
    regular = Pattern(n, nz, "regular")
    assert sum(regular.nnz(i) for i in range(n)) == nz == regular.row_ptr(n)
    for parts in (1, 3, 8):
        for t in range(parts):
            target = nz * t // parts
            assert p.first_row_with(target) == next(r for r in range(n + 1) if p.row_ptr(r) >= target)


def plain_stride(raw, n):
    """One draw after the other: odd if it can be, and prime to n."""
    if n <= 1:
        return 1
    s = raw % n or 1
    if s % 2 == 0:
        s = s + 1 if s + 1 < n else 1
    while math.gcd(s, n) != 1:
        s = s + 2 if s + 2 < n else 1
    return s


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=20), st.integers(1, 5000))
def test_strides_are_prime_to_n(raw, n):
    found = generated.strides(np.array(raw, np.uint64), n).tolist()
    assert found == [plain_stride(r, n) for r in raw]
    assert all(math.gcd(s, n) == 1 and 1 <= s <= max(1, n) for s in found)


@pytest.mark.parametrize("shape", [(0, 1, "regular"), (2**32, 2**33, "regular"), (4, 3, "regular"), (4, 17, "regular"), (4, 4, "odd")])
def test_validation(shape):
    with pytest.raises(ValueError):
        validate(*shape)


def plain_mix(x):
    x = ((x ^ (x >> 30)) * MULTIPLIERS[0]) & MASK
    x = ((x ^ (x >> 27)) * MULTIPLIERS[1]) & MASK
    return x ^ (x >> 31)


def test_draws_are_stateless():
    state, seed = 5, 5
    for k in range(1, 50):
        state = (state + GAMMA) & MASK
        assert plain_mix(state) == plain_mix((seed + k * GAMMA) & MASK) == int(mixed(np.array([state], np.uint64))[0])


def test_total_is_checked(spark):
    counts = generated.pattern_counts(spark, 50, 400)
    row = generated.matrix_stats(counts, 50, 400).first()
    assert row == generated.matrix_stats(generated.row_counts(generated.matrix(spark, 50, 400)), 50).first() and row.total_nnz == 400
    with pytest.raises(Exception, match="should hold 401"):
        generated.matrix_stats(counts, 50, 401).collect()


def test_worked_product(spark):
    entries = [(0, 0, 5.0), (0, 2, 0.0), (1, 1, 3.0), (2, 1, 1.0), (2, 2, 5.0), (3, 3, 6.0)]
    a = spark.createDataFrame(entries, "row long, col long, val double")
    x = spark.createDataFrame([(i, float(i + 1)) for i in range(4)], "i long, v double")
    plain = {r.i: r.v for r in linear.spmv(a, x, 4).collect()}
    assert plain == {0: 5.0, 1: 6.0, 2: 17.0, 3: 24.0}
    assert {r.i: r.v for r in linear.spmv(a, x, 4, 1).collect()} == {1: 5.0, 2: 6.0, 3: 17.0, 0: 24.0}
    wide = a.filter("row < 2").unionByName(spark.createDataFrame([(9, 3, 2.0)], "row long, col long, val double"))
    assert {r.i: r.v for r in linear.spmv(wide, x, None).collect()} == {0: 5.0, 1: 6.0, 9: 8.0}
    pos = a.withColumn("pos", F.col("col"))
    assert {r.i: r.v for r in linear.spmv_ordered(pos, x, 4, 1).collect()} == {1: 5.0, 2: 6.0, 3: 17.0, 0: 24.0}
    assert math.isclose(linear.l2_norm(linear.spmv(a, x, 4)).first().norm, math.sqrt(926))
    assert schedule.shift_step(4) == 1 and schedule.shift_step(17) == 2
    assert [schedule.shift_at(i, 100) for i in (0, 24, 25, 499)] == [0, 0, 23, 19 * 23 % 100]


def test_checksum_golden(spark):
    x = spark.createDataFrame([(0, 1.0)], "i long, v double")
    assert linear.checksum(x).first().checksum == "2a20cd80798dae26"


def test_balanced_parts(spark):
    counts = [5, 0, 0, 9, 1, 1, 1, 3, 20, 0, 2]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(counts)], "row long, k long")
    ptr = [0, *np.cumsum(counts).tolist()]
    for parts in (1, 2, 4, 7, 50):
        p = schedule.clamp_parts(parts, len(counts))
        edges = [next(r for r in range(len(ptr)) if ptr[r] >= ptr[-1] * t // p) for t in range(p)] + [len(counts)]
        rows = schedule.balanced_parts(df, "row", "k", parts, len(counts)).orderBy("part").collect()
        assert [(r.lo, r.hi, r.nnz) for r in rows] == [(a, b, ptr[b] - ptr[a]) for a, b in zip(edges, edges[1:])]


#: A total of which a unit is below the sixth place of a quotient, and rows at both sides of the targets.
LARGE = [1, 2_249_998, 1, 1, 2_249_998, 2_250_001, 0, 2_250_001, 11_249_999, 15_749_999, 1, 0]


def test_bounds_of_a_large_total(spark):
    """A barrier stage has a task for each part: no more parts than asked for, in order."""
    df = spark.createDataFrame(list(enumerate(LARGE)), "row long, k long")
    bounds = schedule.part_bounds(df, "row", "k", 8, len(LARGE))
    assert len(bounds) == 9 and bounds == sorted(bounds) and bounds[0] == 0


def large_edges(parts):
    ptr = [0, *np.cumsum(LARGE).tolist()]
    return ptr, [next(r for r in range(len(ptr)) if ptr[r] >= ptr[-1] * t // parts) for t in range(parts)] + [len(LARGE)]


def test_pieces_of_a_large_total(spark):
    _, edges = large_edges(12)
    df = spark.createDataFrame(list(enumerate(LARGE)), "row long, k long")
    ranges = schedule.balanced_parts(df, "row", "k", 12, len(LARGE)).withColumnRenamed("part", "rank")
    want = sorted((t, c, (b - a) // 2 + (c < (b - a) % 2)) for t, (a, b) in enumerate(zip(edges, edges[1:])) for c in range(2))
    assert sorted((r["rank"], r.chunk, r.cnt) for r in schedule.chunk_plan(ranges, 2).collect()) == want


def test_ranges_of_a_large_total(spark):
    ptr, edges = large_edges(12)
    df = spark.createDataFrame(list(enumerate(LARGE)), "row long, k long")
    rows = schedule.balanced_parts(df, "row", "k", 12, len(LARGE)).orderBy("part").collect()
    assert [(r.part, r.lo, r.hi, r.nnz) for r in rows] == [(t, a, b, ptr[b] - ptr[a]) for t, (a, b) in enumerate(zip(edges, edges[1:]))]


def keyed(path, parts, lines):
    """Tables of the given keys, all that the ranges of parts read."""
    pq.write_table(pa.table({"p_partkey": pa.array(parts, pa.int64())}), path / "part.parquet")
    pq.write_table(pa.table({"l_partkey": pa.array(lines, pa.int64())}), path / "lineitem.parquet")
    return str(path)


GAPS = [1000 * i + k for i in range(3) for k in range(20)]


def test_pieces_of_keys_with_gaps(spark, tmp_path):
    sf = keyed(tmp_path, GAPS, [r for r in GAPS for _ in range(r % 7)])
    assert difference(QUERIES["p_chunk_plan"](spark, sf), SQL["p_chunk_plan"], connect(sf)) is None


@pytest.mark.parametrize("parts", [[*range(40), 39, 39, *range(40, 60)], range(5), []])
def test_ranges_of_repeated_and_few_keys(spark, tmp_path, parts):
    sf = keyed(tmp_path, parts, [r for r in range(60) for _ in range(r % 7)])
    assert difference(QUERIES["p_nnz_partition"](spark, sf), SQL["p_nnz_partition"], connect(sf)) is None


def test_files(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "cde_n100_nz400_t8.times").write_text("1.5\nNA\n2.5\n")
    (raw / "mpiov_n100_nz400_r2_t4_c8.times").write_text("3\n")
    rows = sorted(scan_times(spark, str(raw)).collect(), key=lambda r: (r.tag, r.time_sec or 0))
    assert [(r.tag, r.n, r.threads, r.ranks, r.chunks, r.variant, r.time_sec) for r in rows] == [("cde", 100, 8, None, None, None, None), ("cde", 100, 8, None, None, None, 1.5), ("cde", 100, 8, None, None, None, 2.5), ("mpiov", 100, 4, 2, 8, "overlap", 3.0)]
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "seq_n5_nz9.txt").write_text("[seq]\nrayleigh=1.25\nchecksum=0xabc\nchecksum=0xdef\nTime (sec) = 0.500000\n")
    (logs / "seq_n6_nz9.txt").write_text("crash\n")
    a, c = sorted(scan_logs(spark, str(logs)).collect(), key=lambda r: r.n)
    assert (a.n, a.rayleigh, a.checksum, a.time_sec) == (5, 1.25, "0xabc", 0.5)
    assert (c.n, c.rayleigh, c.checksum, c.time_sec) == (6, None, None, None)
    (tmp_path / "config.env").write_text('VTAGS="base ab cde"\n# note\nREPS=3\n')
    config = scan_config(spark, str(tmp_path / "config.env"))
    assert {r.key: r["values"] for r in config.collect()} == {"VTAGS": ["base", "ab", "cde"], "REPS": ["3"]}
    assert {r.key: r["values"] for r in merge_configs(config, config).collect()}["VTAGS"] == ["ab", "base", "cde"]
    x = generated.raw_vector(spark, 50)
    write_dump(x, str(tmp_path / "dump"))
    assert linear.compare_vectors(x, scan_dump(spark, str(tmp_path / "dump"))).first().verdict == "identical"
    (tmp_path / "plain.dump").write_text("".join(f"{v:.17g}\n" for v in (0.1, 1e-300, 3.0)))
    assert sorted((r.i, r.v) for r in scan_dump(spark, str(tmp_path / "plain.dump")).collect()) == [(0, 0.1), (1, 1e-300), (2, 3.0)]
    sizes = spark.createDataFrame([("SIZES", ["10", "9", "x"]), ("EMPTY", [])], "key string, values array<string>")
    write_config(merge_configs(sizes, spark.createDataFrame([("SIZES", ["100", "9"])], "key string, values array<string>")), str(tmp_path / "out"))
    assert [(r.key, r["values"]) for r in scan_config(spark, str(tmp_path / "out")).collect()] == [("SIZES", ["9", "10", "100", "x"])]


def test_measured_figures(spark):
    tables = roofline.measured(spark)
    assert {k: t.count() for k, t in tables.items()} == {"ceilings": 2, "product": 4, "scaling": 4, "levels": 4, "sweep": 15}
    assert tables["levels"].filter("cache_kb is null").first().level == "DRAM"


def test_memory_levels(spark):
    """12 bytes a nonzero and 16 a row, at the edges of the measured sizes."""
    sizes = [(0, 128, "L1", 984.5), (0, 129, "L1", 1018.6), (1024, 1280, "L1", 555.3), (1024, 1281, "L2", 357.9), (0, 1310720, "L3", 59.1), (0, 1310721, "DRAM", 59.1), (10**9, 10**6, "DRAM", 59.1)]
    df = spark.createDataFrame([(k, nnz, n) for k, (nnz, n, _, _) in enumerate(sizes)], "k int, nnz long, n long")
    rows = roofline.memory_level(df).orderBy("k").collect()
    assert [(r.level, r.sweep_gbs) for r in rows] == [(level, gbs) for _, _, level, gbs in sizes]
    assert rows[-1].level_gbs == 51.0 and math.isclose(rows[-1].level_roof, 51.0 * 2 * (10**9 + 10**6) / (12 * 10**9 + 16 * 10**6))


def test_model_over_measured_times(spark):
    a, x = generated.matrix(spark, 50, 400), generated.raw_vector(spark, 50)
    rows = roofline.roofline(roofline.timed_product(a, x, 2)).collect()
    assert [r.rep for r in rows] == [1, 2] and all(r.seconds > 0 and r.nnz == 400 and r.gflops == round(900 / r.seconds / 1e9, 6) for r in rows)


def test_units_are_below_one():
    assert units(np.array([MASK, 0], np.uint64)).tolist() == [1 - 2.0**-53, 0]
