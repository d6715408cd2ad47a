import hashlib
import random

from rotaspark.llm.common import read
from rotaspark.llm.line_dedup import dedup_lines, op6_line_dedup

from .util import ODD, frame


def brute(rows, k):
    docs, seen = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        lines = (t or "").split("\n")
        full = [x for x, line in enumerate(lines) if line.strip(" \t\r\x0b\x0c")]
        ids = [lines[x] for x in full]
        gone = [False] * len(ids)
        for p in range(len(ids) - k + 1):
            run = tuple(ids[p : p + k])
            if run in seen:
                gone[p : p + k] = [True] * k
            seen.setdefault(run, (i, p))
        drop = set()
        for j, x in enumerate(full):
            if gone[j]:
                drop.update(range(full[j - 1] + 1 if j else 0, x + 1))
        kept = "\n".join(line for x, line in enumerate(lines) if x not in drop)
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        docs.append((i, len(full), sum(gone), runs, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(docs)


def found(df):
    return sorted((r.doc_id, r.n_lines, r.n_removed, r.n_runs, r.kept_sha256) for r in df.collect())


def check(docs, k):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(dedup_lines(docs, min_lines=k)) == brute(rows, k)


def test_documents(spark, sf):
    docs = read(spark, sf, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(op6_line_dedup(spark, sf)) == brute(rows, 2)
    check(docs, 1)


def test_runs_of_several_lines(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["a", "b", "c", "", " ", "d"]) for _ in range(rng.randrange(25))) for _ in range(40)]
    for k in (1, 2, 3):
        check(frame(spark, texts), k)


def test_odd(spark):
    docs = frame(spark, ODD + ["x\ny\nz", "q\nx\ny\nz\n\nend", "a\n" * 300])
    check(docs, 1)
    longest = {r.doc_id: r.longest_copy for r in dedup_lines(docs).collect()}
    assert longest[len(ODD) + 1] == 3 and longest[len(ODD) + 2] == 299
    assert dedup_lines(docs.limit(0)).count() == 0
    null = docs.selectExpr("cast(null as long) doc_id", "text").limit(3)
    assert dedup_lines(null).count() == 3


def brute_copies(rows, k):
    """By id: the maximal copies as (line, size, source id, source line)."""
    out, before = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = [x for x in (t or "").split("\n") if x.strip(" \t\r\x0b\x0c")]
        best = []
        for p in range(len(ids)):
            size, source = 0, None
            for j, q, other in [*before, *((i, q, ids[q:]) for q in range(p))]:
                same = next((n for n, (a, b) in enumerate(zip(ids[p:], other)) if a != b), min(len(ids) - p, len(other)))
                if same > size:
                    size, source = same, (j, q)
            best.append((size, source))
        out[i] = [(p, n, *o) for p, (n, o) in enumerate(best) if n >= k and (p == 0 or best[p - 1][0] != n + 1)]
        before += [(i, q, ids[q:]) for q in range(len(ids))]
    return out


def test_exact_maximal_copies(spark):
    rng = random.Random(3)
    texts = ["\n".join(rng.choice("aab\nc") for _ in range(rng.randrange(30))) for _ in range(25)]
    block = [f"line {i}" for i in range(13)]
    texts += ["\n".join(block), "\n".join(["z", *block[:11], "y", *block[3:], "w"]), "\n".join([*block[:11], "y", "v"]), "\n".join(["b"] * 37)]
    docs = frame(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for k in (1, 3):
        want = brute_copies(rows, k)
        got = dedup_lines(docs, min_lines=k).collect()
        assert {r.doc_id: [tuple(c) for c in r.copies] for r in got} == want
        assert {r.doc_id: r.longest_copy for r in got} == {i: max([c[1] for c in x], default=0) for i, x in want.items()}


def test_blocks_and_buckets_agree_with_one_block(spark, monkeypatch):
    from rotaspark.llm import line_dedup

    rng = random.Random(4)
    docs = frame(spark, ["\n".join(["hot", rng.choice("abc"), rng.choice("ab")] * rng.randrange(1, 9)) for _ in range(60)])
    want = sorted(dedup_lines(docs).collect())
    monkeypatch.setattr(line_dedup, "BLOCK_BYTES", 60)
    assert sorted(dedup_lines(docs).collect()) == want
    check(docs, 2)


def test_ranks_are_in_suffix_order(spark):
    """Ranks of 1, 2 and 4 lines compare like the lines' ids, common first lines among them."""
    from rotaspark.llm import line_dedup as ld

    rng = random.Random(9)
    docs = frame(spark, ["\n".join(rng.choice(["hot"] * 6 + [f"line {k}" for k in range(12)]) for _ in range(30)) for _ in range(40)])
    blocks = 4
    state = ld.materialize(ld.line_ids(docs, "doc_id", "text", blocks).groupBy("block").applyInArrow(ld._build, ld.STATE), "test")
    ids = {}
    for r in state.collect():
        b = ld._lines(r.data)
        ids |= {(b.doc[b.row[i]], b.line[i]): tuple(b.ids[i].tolist()) for i in range(len(b.row))}
    for level in range(3):
        state = ld._round(state, "test", blocks, ld.pairs_up, ld._raised, level == 0)
        found = []
        for r in state.collect():
            b = ld._lines(r.data)
            found += [(int(b.ranks[-1][i]), [ids[b.doc[b.row[i]], b.line[i] + k] for k in range(1 << level)]) for i in range(len(b.row)) if b.ranks[-1][i]]
        assert len(found) > 20
        found.sort()
        for (x, a), (y, c) in zip(found, found[1:]):
            assert (x < y and a < c) or (x == y and a == c)
