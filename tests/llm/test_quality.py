import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from rotaspark.llm import quality as q
from rotaspark.llm.common import read

from .util import ODD, frame

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs, line_docs=q.LINE_DOCS, share=q.LINE_SHARE):
    """Rows (source, text) to their counts and verdicts, word by word."""
    seen, hosts, out = defaultdict(set), Counter(s for s, _ in docs), []
    norm = lambda line: " ".join(WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("[0-9]", "0", line))))
    each = [[x for x in (t or "").split("\n") if WORD.search(x)] for _, t in docs]
    for i, ((s, _), lines) in enumerate(zip(docs, each)):
        for x in lines:
            seen[s, norm(x)].add(i)
    for (s, t), lines in zip(docs, each):
        t = t or ""
        words = WORD.findall(t)
        windows = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        chars = lambda x: sum(map(len, WORD.findall(x)))
        gone = sum(chars(x) for x in lines if len(seen[s, norm(x)]) > line_docs and len(seen[s, norm(x)]) > share * hosts[s])
        failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
        out.append((len(words), chars(t), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), gone, failed, not failed and 2 * (chars(t) - gone) >= chars(t)))
    return out


def rows_of(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.removed_chars, r.base_failed, r.kept) for r in df.collect()), key=repr)


def check(docs, **limits):
    rows = docs.collect()
    want = brute([(r.source, r.text) for r in rows], **{"share" if k == "line_share" else k: v for k, v in limits.items()})
    assert rows_of(q.quality(docs, **limits)) == sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=repr)


def test_odd_texts(spark):
    check(frame(spark, ODD))


def test_documents(spark, sf):
    check(read(spark, sf, "documents"))
    check(read(spark, sf, "documents"), line_docs=1, line_share=0.0)


def text(i, n=60):
    return " ".join(f"w{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(n))


def test_hot_line_depletes_and_is_cut(spark):
    hot = "Shared 17 line  of " + text(99, 55)
    rows = [(i, text(i) + "\n" + hot.replace("17", str(10 + i)), "a") for i in range(40)]
    rows += [(100 + i, "short\n" + hot, "a") for i in range(40)] + [(200, text(7) + "\n" + hot, "b"), (None, text(8), None), (7, text(7), "c"), (7, text(7), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lines", F.lit("x"))
    check(docs)
    kept = {r.doc_id: r.text for r in q.clean_documents(docs).collect()}
    assert kept.keys() == {*range(40), 200, None, 7} and q.clean_documents(docs).columns == docs.columns
    assert kept[3] == text(3) and kept[200].endswith(hot)
    # The limits are crossed, not met.
    check(docs, line_docs=79)
    check(docs, line_docs=80)


def test_empty_table(spark):
    docs = frame(spark, ["a"]).limit(0)
    assert q.quality(docs).count() == 0 and q.clean_documents(docs).count() == 0


def test_long_texts_by_pieces_and_numbers(monkeypatch):
    words = [b"w%d" % (i * i % 977) for i in range(q.MANY // 2)]
    text = b" ".join(words) + b"\n" + "é".encode() * 3
    want = q.repeated_words(text)
    assert want[0] == len(words) + 1 and want[1] > 0
    monkeypatch.setattr(q, "MANY", 10)
    assert q.repeated_words(text) == want
    monkeypatch.setattr(q, "PIECE", 1000)
    assert b"".join(q.pieces(text, 1000)) == text and q.repeated_words(text) == want
