import corpus_pipeline as cp
from rotaspark.llm.common import materialize, read
from rotaspark.llm.toxicity import fit, score_documents

from .test_exact_dedup import norm
from .test_near_join import brute as near_brute
from .test_suffix_dedup import brute as suffix_brute
from .util import frame


def test_stages_against_brute_force(spark, sf):
    docs = read(spark, sf, "documents")
    columns = docs.columns
    assert [name for name, _ in cp.STAGES] == ["toxicity", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(materialize(stage(spark, out[-1], sf), "test"))
    rows = [{r.doc_id: r.asDict() for r in df.collect()} for df in out[:-1]]
    assert all(df.columns == columns for df in out[:-1])
    rejected = {r.doc_id for r in score_documents(docs, fit(docs, read(spark, sf, "labels"))).filter("predicted = 1").collect()}
    assert rows[1].keys() == rows[0].keys() - rejected
    last = {}
    for i, r in rows[1].items():
        last[norm(r["text"])] = max(i, last.get(norm(r["text"]), -1))
    assert rows[2].keys() == set(last.values())
    assert rows[3].keys() == {i for i, _, _, kept in near_brute([(i, r["text"]) for i, r in rows[2].items()]) if kept}
    for i, n, gone, _, _ in suffix_brute([(i, r["text"]) for i, r in rows[3].items()]):
        text = rows[4][i]["text"]
        if gone:
            assert n - gone - 6 <= len(text.encode()) <= n - gone and rows[4][i]["n_chars"] == len(text)
        else:
            assert rows[4][i] == rows[3][i]
    assert {r.doc_id for r in out[-1].collect()} == rows[3].keys()
    assert cp.run(spark, sf).count() == out[-1].count()


def test_empty_documents(spark, sf):
    docs = frame(spark, [None]).limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
