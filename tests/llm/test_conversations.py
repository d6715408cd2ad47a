import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from rotaspark.llm import conversations as cv
from rotaspark.llm.common import read

VISIBLE, STEP = re.compile("[^\x20\x09-\x0d]"), {0: 2, 1: 2, 2: 3, 3: 2}


def plan(rows):
    """Cheapest (cost, audit) of rows (initial, must go, cut off): every way forward, best of each state by (cost, audit)."""
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def inserts(ways):
        out = dict(ways)
        for q, (c, a) in ways.items():
            for _ in range(3):
                q, c, a = STEP[q], c + 5, a + "I"
                out[q] = min(out.get(q, (c, a)), (c, a))
        return out

    ways = {0: (0, "")}
    for initial, must, cut in rows:
        following = defaultdict(list)
        for q, (c, a) in inserts(ways).items():
            following[q].append((c + 2, a + "D"))
            if not must:
                if (initial, q) in keep:
                    following[keep[initial, q]].append((c + 5 * cut, a + "K"))
                following[STEP[q]].append((c + 1 + 5 * cut, a + "R"))
        ways = {q: min(w) for q, w in following.items()}
    return min(w for q, w in inserts(ways).items() if q in (0, 3))


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def brute(ids, rows):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r[0]].append(r[1:])
    for conv in ids:
        turns = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, plain, counts = set(), [], [0, 0, 0]
        for _, role, text in turns:
            last = VISIBLE.findall(text)[-1:]
            fault = 0 if not last else 1 if (role, text) in seen else 2 if last[0] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            plain.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = plan(plain) if turns else (0, "")
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(plain, plain[1:]))
        i, q, lines = 0, 0, []
        for e in audit:
            role, text = ("", "") if e == "I" else turns[i][1:]
            i += e != "I"
            if e == "D":
                continue
            q = {"s": 1, "u": 2, "a": 3}[role[:1]] if e == "K" else STEP[q]
            lines.append(f"{role if e == 'K' else ['', '', 'user', 'assistant'][q]}:{text}")
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()), key=repr)


def test_given_table(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(cv.op11_conversations(spark, sf)) == brute({r[0] for r in rows}, damaged(rows))


ROLES = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "éa", "User"]
TEXTS = ["Yes.", "No!", "cut off", "", " \n\t", None, "x", "Why? \r\n", "Same.", "Same.", "a ", " ", "日本。", "word " * 5000]


def odd(rng, n, conversations=40):
    turn = lambda: None if rng.random() < 0.1 else rng.randrange(9)
    rows = [(rng.choice([None, *range(conversations)]), turn(), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]
    return rows + rng.sample(rows, n // 8)


def test_odd_rows(spark, tmp_path):
    rows = odd(random.Random(3), 500) + [(900, None, "user", "a."), (900, None, "user", "a."), (901, 4, "assistant", "b.")]
    rows += [(1000, t, "user" if t % 3 else "assistant", f"{t}{'.' if t % 5 else ''}") for t in range(400)]
    schema = "conv_id long, turn long, role string, text string, audit string, digest string"
    spark.createDataFrame([(*r, "x", "y") for r in rows], schema).write.parquet(f"{tmp_path}/conversations.parquet")
    assert found(cv.op11_conversations(spark, str(tmp_path))) == brute({r[0] for r in rows}, damaged(rows))


def test_repaired_rows_and_no_rows(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "So?"), (1, 1, "user", "So?"), (2, 5, "tool", "x"), (3, 0, "user", "A."), (3, 1, "tool", "B.")], schema)
    audits = cv.audits(rows)
    assert {r.conv_id: (r.cost, r.audit) for r in audits.collect()} == {1: (4, "RRD"), 2: (2, "D"), 3: (1, "KR")}
    turns = sorted(map(tuple, cv.repaired(rows, audits).collect()))
    assert turns == [(1, 0, "user", "Hi."), (1, 1, "assistant", "So?"), (3, 0, "user", "A."), (3, 1, "assistant", "B.")]
    assert cv.audits(rows.limit(0)).count() == 0 and cv.digests(rows.limit(0), cv.audits(rows.limit(0))).count() == 0


def as_bytes(rows):
    return bytes(cv.INITIALS.index(i if i in "sua" else "?") + (cv.BLANK if must else cv.TRUNCATED if cut else 0) for i, must, cut in rows)


@pytest.mark.parametrize("seed", range(4))
def test_search_and_segments_against_every_way(seed):
    rng = random.Random(seed)
    for _ in range(150):
        rows = [(rng.choice("suuaa?"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randrange(14))]
        cost, audit = plan(rows)
        for segment in (cv.SEGMENT, 1, 2, 3, 5):
            assert cv.cheapest(as_bytes(rows), segment) == (cost, audit)


def test_long_conversation():
    rng = random.Random(9)
    rows = [(rng.choice("suuaa?"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(3000)]
    assert cv.cheapest(as_bytes(rows)) == plan(rows)
