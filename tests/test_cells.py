import threading

from pyspark.sql import functions as F

from rotaspark.queries import QUERIES
from rotaspark.sources.cells import append_cells, file_exists, merge_config, replace_cells, replace_config, scan_cells, scan_checksums, truncate_cells, unfinished_cells
from rotaspark.sources.results import scan_config

SCHEMA = "run string, rep long, time_sec double, checksum string"
A, B, C = "seq_n10_nz40", "cde_n10_nz40_t8", "mpiov_n10_nz40_r2_t4_c8"


def state(spark, path):
    times, sums = {}, {r.file: r.checksum for r in scan_checksums(spark, path).collect()}
    for r in scan_cells(spark, path).collect():
        times.setdefault(r.file, []).append(r.time_sec)
    return {k: sorted(v, key=lambda x: x or -1) for k, v in times.items()}, sums


def test_a_rerun_replaces_its_cells_only(spark, tmp_path):
    path = str(tmp_path / "results")
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    replace_cells(frame([(A, 1, 1.0, "0x1"), (A, 2, 2.0, "0x2"), (B, 1, 3.0, "0x3"), (C, 1, None, None)]), path)
    assert state(spark, path) == ({A: [1.0, 2.0], B: [3.0], C: [None]}, {A: "0x2", B: "0x3", C: None})
    replace_cells(frame([(A, 1, 5.0, "0x9"), (A, 2, None, None)]), path)
    assert state(spark, path) == ({A: [None, 5.0], B: [3.0], C: [None]}, {A: None, B: "0x3", C: None})
    append_cells(frame([(B, 2, 4.0, "0x4"), (B, 3, 4.0, "0x5")]), path)
    assert state(spark, path) == ({A: [None, 5.0], B: [3.0, 4.0, 4.0], C: [None]}, {A: None, B: "0x5", C: None})
    runs = spark.createDataFrame([(r,) for r in (A, B, C, "new_n1_nz1", A)], "run string")
    assert sorted(r.run for r in unfinished_cells(spark, path, runs, 2).collect()) == sorted([A, C, "new_n1_nz1"])
    truncate_cells(runs.filter(F.col("run") == B), path)
    assert state(spark, path) == ({A: [None, 5.0], C: [None]}, {A: None, C: None})
    replace_cells(frame([]), path)
    assert state(spark, path)[0] == {A: [None, 5.0], C: [None]}
    found = {r.file: (r.tag, r.threads, r.ranks, r.chunks) for r in scan_cells(spark, path).collect()}
    assert found[C] == ("mpiov", 4, 2, 8)


def test_a_cell_with_most_samples(spark, tmp_path):
    rows = spark.range(20_000).select(F.when(F.col("id") % 10 < 9, A).otherwise(B).alias("run"), F.col("id").alias("rep"), F.col("id").cast("double").alias("time_sec"), F.col("id").cast("string").alias("checksum"))
    replace_cells(rows, str(tmp_path))
    times, sums = state(spark, str(tmp_path))
    assert {k: len(v) for k, v in times.items()} == {A: 18_000, B: 2_000} and sums == {A: "19998", B: "19999"}


def test_names_are_not_taken_apart_for_each_line(spark, sf):
    """Patterns in a filter over the lines took most of a rerun's time."""
    plan = QUERIES["s_cell_rerun"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    below = [x for x in plan.splitlines() if "Filter" in x or "FileScan" in x]
    assert below and not any("regexp" in x for x in below)


def settings(spark, **values):
    return spark.createDataFrame([(k, v.split()) for k, v in values.items()], "key string, values array<string>")


def config(spark, path):
    return {r.key: " ".join(r["values"]) for r in scan_config(spark, path).collect()}


def test_settings_are_merged(spark, tmp_path):
    path = str(tmp_path / "config.env")
    assert not file_exists(spark, path)
    merge_config(settings(spark, SIZES="500 100", MODE="irregular"), path, "SIZES")
    assert config(spark, path) == {"SIZES": "100 500", "MODE": "irregular"}
    merge_config(settings(spark, SIZES="9 100", GEO="r2_t4 r1_t8", REPS="3"), path, "SIZES", "GEO")
    assert config(spark, path) == {"SIZES": "9 100 500", "MODE": "irregular", "GEO": "r1_t8 r2_t4", "REPS": "3"}
    merge_config(settings(spark, MODE="regular", GEO="r1_t8"), path, "SIZES", "GEO")
    assert config(spark, path) == {"SIZES": "9 100 500", "MODE": "regular", "GEO": "r1_t8 r2_t4", "REPS": "3"}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["config.env"]
    replace_config(settings(spark, X="").limit(0), path)
    assert config(spark, path) == {}


def test_a_reader_never_sees_half_a_file(spark, tmp_path):
    """Two writers in turn, while a thread reads the file all the time."""
    path, ended, seen = tmp_path / "config.env", threading.Event(), set()
    versions = [settings(spark, **{f"{name}{k}": "1 2 3" for k in range(200)}) for name in ("A", "B")]
    replace_config(versions[0], str(path))

    def look():
        while not ended.is_set():
            seen.add(path.read_text())

    reader = threading.Thread(target=look)
    reader.start()
    for k in range(6):
        replace_config(versions[k % 2], str(path))
    ended.set()
    reader.join()
    want = {"".join(sorted(f'{name}{k}="1 2 3"\n' for k in range(200))) for name in ("A", "B")}
    assert seen <= want and len(seen) == 2
