import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rotaspark.llm.common import read
from rotaspark.llm.exact_dedup import LOWER, UPPER, drop_exact_copies, exact_groups, hot_texts, normalised

from .util import ODD, frame


def norm(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def check(docs):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[norm(r.text)].append(r.doc_id)
    want = sorted((i, max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids)
    got = sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_groups(docs).collect())
    assert got == want
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(max(ids) for ids in groups.values())


def test_odd(spark):
    check(frame(spark, ODD))


def test_hot_group(spark):
    check(frame(spark, ["Same"] * 300 + ["other %d" % i for i in range(300)] + ["sAME"]))


def test_hot_texts_are_found_and_split(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Hot").when(F.col("id") % 7 == 0, "Warm").otherwise(F.col("id").cast("string")).alias("text"))
    found = {r.digest.hex(): r.places for r in hot_texts(rows.select(F.unhex(F.sha2(normalised(), 256)).alias("digest")), 4).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found.keys() == {sha("hot"), sha("warm")} and found[sha("hot")] >= 2
    check(rows.withColumn("salt", F.lit("x")).withColumn("run", F.lit("y")))
    ids = rows.withColumn("doc_id", F.when(F.col("doc_id") % 5 > 0, F.col("doc_id") % 40))
    groups = exact_groups(ids).collect()
    assert sum(r.kept for r in groups) == ids.select("text").distinct().count()
    assert {r.group_size for r in groups if r.text_sha256 == sha("hot")} == {1334} and {r.keep_id for r in groups if r.text_sha256 == sha("hot")} == {39}


def test_equal_digests_of_different_texts_stay_apart(spark, monkeypatch):
    """Only the texts themselves decide, hot ones included."""
    monkeypatch.setattr("rotaspark.llm.exact_dedup.F.sha2", lambda c, n: F.lit("ab" * 32))
    for texts in (["a", "b", "a", "", None, "c"], ["a", "b"] * 40 + ["c"]):
        docs = frame(spark, texts)
        sizes = Counter(norm(t) for t in texts)
        got = {r.doc_id: (r.group_size, r.kept) for r in exact_groups(docs).collect()}
        last = {norm(t): i for i, t in enumerate(texts)}
        assert got == {i: (sizes[norm(t)], last[norm(t)] == i) for i, t in enumerate(texts)}


def test_long_texts(spark):
    check(frame(spark, ["x" * 3_000_000, "X" * 3_000_000, "x" * 2_999_999 + "y", "y"]))


def test_documents(spark, sf):
    check(read(spark, sf, "documents"))


def test_repeated_rows_and_null_ids(spark):
    docs = frame(spark, ["a", "A", "b"]).selectExpr("if(doc_id = 2, null, 5L) doc_id", "text", "lang")
    rows = exact_groups(docs).collect()
    assert sorted((r.keep_id or -1, r.group_size, r.kept) for r in rows) == [(-1, 1, True), (5, 2, False), (5, 2, True)]
    assert drop_exact_copies(docs).count() >= 2
    assert exact_groups(docs.limit(0)).count() == 0
