import pytest
from pyspark.sql import functions as F

from rotaspark.sources import formats, generated
from rotaspark.sources.formats import GeneratedMatrix, GeneratedVector


def load(spark, form, **options):
    formats.register(spark)
    return spark.read.format(form).options(**options).load()


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_matrix_equals_the_generator(spark):
    for mode in ("regular", "irregular"):
        found = load(spark, "generated_matrix", n=120, nz=1500, mode=mode, seed=7, entries=100)
        assert rows(found) == rows(generated.matrix(spark, 120, 1500, mode, 7))
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) >= 8 and max(sizes) <= 100 + 120


def test_vector_equals_the_generator(spark):
    found = load(spark, "generated_vector", n=1000, seed="0x6f", entries=300)
    assert rows(found) == rows(generated.raw_vector(spark, 1000, 0x6F)) and found.rdd.getNumPartitions() == 4


FILTERS = [
    ("row >= 10 and row < 20", lambda r: 10 <= r < 20), ("row > 10 and row <= 20 and row > 12", lambda r: 12 < r <= 20), ("row = 5", lambda r: r == 5), ("row in (3, 4, 90, 500)", lambda r: r in (3, 4, 90)),
    ("row in (3, 4, 90) and row <> 4 and row < 50", lambda r: r == 3), ("row < 0", lambda r: False), ("row >= 120", lambda r: False), ("row = 5 and row = 6", lambda r: False), ("row is not null", lambda r: True), ("row is null", lambda r: False), ("row = 1 or row = 2", lambda r: r in (1, 2)),
]


@pytest.mark.parametrize("condition, wanted", FILTERS, ids=[c for c, _ in FILTERS])
def test_filters(spark, condition, wanted):
    df = load(spark, "generated_matrix", n=120, nz=1500, entries=50).filter(condition)
    assert rows(df) == [r for r in rows(generated.matrix(spark, 120, 1500)) if wanted(r[0])]


def test_excluded_rows_are_not_planned(spark):
    whole = load(spark, "generated_matrix", n=120, nz=1500, entries=50)
    part = whole.filter("row >= 60 and row < 64 and val > 0.5")
    assert whole.rdd.getNumPartitions() >= 20 and part.rdd.getNumPartitions() <= 2
    plan = part._jdf.queryExecution().executedPlan().toString()
    # The source took the comparisons with the row; the one with the value is left to Spark.
    assert "val" in plan.split("BatchScan")[0] and "row" not in plan.split("Filter")[1].split("BatchScan")[0].split("\n")[0]
    reader = GeneratedMatrix({"n": "120", "nz": "1500", "entries": "50"}).reader(None)
    reader.low, reader.high = 60, 64
    assert [(p.first, p.last) for p in reader.partitions()][0][0] == 60 and reader.partitions()[-1].last == 64
    reader.high = 0
    assert [(p.first, p.last) for p in reader.partitions()] == [(0, 0)]


def test_wrong_options(spark):
    for options, said in (({"n": "4"}, "needs the option nz"), ({"n": "4", "nz": "17"}, "at most"), ({"n": "x", "nz": "1"}, "whole number"), ({"n": "4", "nz": "4", "mode": "odd"}, "mode")):
        with pytest.raises(ValueError, match=said):
            GeneratedMatrix(options).schema()
    with pytest.raises(ValueError):
        GeneratedVector({"n": "0"}).schema()
    with pytest.raises(Exception, match="needs the option nz"):
        load(spark, "generated_matrix", n=4).collect()
