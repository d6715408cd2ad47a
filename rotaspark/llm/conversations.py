"""Repair of damaged conversations by iterative-deepening A*.

Faults of turns (blank, repeated, cut off, roles that do not alternate) are
mended by the cheapest edits: keep, give another role, delete, insert.  The
search is depth first in the ASCII order of the edits' initials under a cost bound
that rises to the least cost found beyond it; states that failed keep the least
cost that is proven for their rest, and are not entered again below it.  So the
first accepted path is the cheapest one, and the first of these in ASCII order.

Rows of a conversation meet in one task, sorted, and pass through it one by one:
its audit is one string and its hash one chain, whatever its length.  The first pass
reads flags instead of texts and keeps a byte a turn; the second reads the texts with the
audit before them and holds one row at a time.  Conversations longer than SEGMENT
turns are searched a segment at a time, from each state to each; segments then
join in pairs by least (cost, audit).  That is exact: two audits of a segment with
equal ends and costs have the same number of inserts, so neither begins the other.

Null role and text are one blank, as are null ids and turns where damage is drawn.
Null conv_ids are one conversation, null turns come first.  Turns with one number
are ordered by role and text hash; repeated rows are duplicates.  A role's initial
is its first character; an empty role has none and goes with nothing.  An empty
table gives an empty result; other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rotaspark.llm.common import read

#: Turns of one search.
SEGMENT = 48
#: Costs of the edits in the order of their initials, and of a cut-off turn that stays.
DELETE, INSERT, KEEP, REROLE, CUT_OFF = 2, 5, 0, 1, 5
#: What was written so far: nothing, a first system turn, a user's turn, an assistant's turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = frozenset((START, ASSISTANT))
#: The state after keeping a turn with this initial, by state before.
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after a turn whose role can be chosen.
CHOSEN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: A row's flags in one byte: the initial's place in INITIALS, blank, duplicate, truncated.
INITIALS, BLANK, DUPLICATE, TRUNCATED = "sua?", 4, 8, 16
#: Fixed values: a character that is no white space; the ends of a sentence; adjacent initials that may be.
VISIBLE, ENDS, LEGAL = r"[^\x20\x09-\x0D]", "[.!?]", ("su", "ua", "au")

Found = tuple[float, str]
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


class Search:
    """Cheapest edits of some rows (flags) from a state to one of several."""

    def __init__(self, rows: bytes, ends: frozenset[int]):
        self.rows, self.ends, n = rows, ends, len(rows)
        # Least cost of each row alone, once nothing or something was written.
        rest, system = [0] * (n + 1), [False] * (n + 1)
        for i in range(n - 1, -1, -1):
            flags = rows[i]
            stay = (CUT_OFF if flags & TRUNCATED else 0) + (KEEP if INITIALS[flags & 3] in "ua" else REROLE)
            rest[i] = rest[i + 1] + (DELETE if flags & (BLANK | DUPLICATE) else min(DELETE, stay))
            system[i] = system[i + 1] or (INITIALS[flags & 3] == "s" and not flags & (BLANK | DUPLICATE))
        open_end = bool(ends & {USER, ASSISTANT})
        #: Least cost that is proven for the rows from i on, by i and state.
        self.proven: list[list[float]] = [
            [
                rest[i] - system[i] if open_end or START in ends or (SYSTEM in ends and system[i]) else inf,
                rest[i] if open_end or SYSTEM in ends else inf,
                rest[i] if open_end else inf,
                rest[i] if open_end else inf,
            ]
            for i in range(n + 1)
        ]

    def edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Initial, cost, and the place and state after it, in ASCII order."""
        last = i == len(self.rows)
        flags = 0 if last else self.rows[i]
        if not last:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, CHOSEN[state]
        if not last and not flags & (BLANK | DUPLICATE):
            more = CUT_OFF if flags & TRUNCATED else 0
            kept = KEPT.get(INITIALS[flags & 3], {}).get(state)
            if kept is not None:
                yield "K", KEEP + more, i + 1, kept
            yield "R", REROLE + more, i + 1, CHOSEN[state]

    def within(self, i: int, state: int, left: float) -> str | None:
        """The first audit in ASCII order that costs `left` at most."""
        if i == len(self.rows) and state in self.ends:
            return ""
        least = inf
        for initial, cost, then, after in self.edits(i, state):
            if cost + self.proven[then][after] <= left:
                audit = self.within(then, after, left - cost)
                if audit is not None:
                    return initial + audit
            least = min(least, cost + self.proven[then][after])
        self.proven[i][state] = max(self.proven[i][state], least)
        return None

    def run(self, state: int) -> Found | None:
        """Cost and audit; None if there is no way."""
        while (bound := self.proven[0][state]) < inf:
            audit = self.within(0, state, bound)
            if audit is not None:
                return bound, audit
        return None


def _joined(a: list[list[Found | None]], b: list[list[Found | None]]) -> list[list[Found | None]]:
    def best(p: int, q: int) -> Found | None:
        ways = [(a[p][k][0] + b[k][q][0], a[p][k][1] + b[k][q][1]) for k in range(4) if a[p][k] and b[k][q]]
        return min(ways, default=None)

    return [[best(p, q) for q in range(4)] for p in range(4)]


def cheapest(rows: bytes, segment: int = SEGMENT) -> tuple[int, str]:
    """Cost and audit of a conversation given as a byte of flags a turn."""
    if len(rows) <= segment:
        cost, audit = Search(rows, ACCEPTED).run(START)
        return int(cost), audit
    parts = []
    for at in range(0, len(rows), segment):
        searches = [Search(rows[at : at + segment], frozenset((q,))) for q in range(4)]
        parts.append([[s.run(p) for s in searches] for p in range(4)])
    while len(parts) > 1:
        parts = [_joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    cost, audit = min(parts[0][START][q] for q in ACCEPTED if parts[0][START][q])
    return int(cost), audit


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows dropped, emptied, cut off, repeated or given to the user, as their ids' checksum says."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(blank("text"), ENDS, "")).otherwise(blank("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(fault == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).filter("fault <> 0").select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def _read(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text, and the text's hash."""
    some = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return some.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _flagged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, flags; a conversation's rows in one task, in order."""
    initial = F.substring("role", 1, 1)
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    blank, ended = ~F.col("text").rlike(VISIBLE), F.regexp_extract("text", rf"({VISIBLE})[\x20\x09-\x0D]*\z", 1).rlike(ENDS)
    # Only flags and hashes travel.
    dealt = _read(rows).select("conv_id", "turn", "role", "digest", place.alias("place"), blank.alias("blank"), ended.alias("ended")).repartition("conv_id")
    before = Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))  # within the same partitions
    again = dealt.withColumn("again", F.row_number().over(before) > 1)
    flags = F.col("place") + F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(0)
    return again.withColumn("flags", flags).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "again").select("conv_id", "turn", "flags")


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[int | None] = []
    flags, lowest, highest, distinct, last = bytearray(), None, None, 0, None

    def ended() -> list:
        counts = [sum(1 for f in flags if f & bit) for bit in (BLANK, DUPLICATE, TRUNCATED)]
        initials = [INITIALS[f & 3] for f in flags]
        illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
        return [held[0], highest - lowest + 1 - distinct if distinct else 0, *counts, illegal, *cheapest(bytes(flags))]

    for batch in batches:
        out = []
        for conv, turn, flag in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if not held or held[0] != conv:
                if held:
                    out.append(ended())
                held, flags, lowest, highest, distinct, last = [conv], bytearray(), None, None, 0, None
            flags.append(flag)
            if turn is not None:  # ascending
                lowest, highest, distinct, last = turn if lowest is None else lowest, turn, distinct + (turn != last), turn
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 7 else pa.int64()) for k, c in enumerate(zip(*out))], _AUDIT_NAMES)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.string() if k == 7 else pa.int64()) for k, x in enumerate(ended())], _AUDIT_NAMES)


_AUDIT_NAMES = [c.split()[0] for c in AUDIT.split(", ")]


def audits(rows: DataFrame) -> DataFrame:
    """A row a conversation that has rows: counts of its faults, cost and audit."""
    return _flagged(rows).mapInArrow(_audit, AUDIT)


class Written:
    """Turns of a repaired conversation as its rows pass by."""

    def __init__(self, conv: int | None, audit: str):
        self.conv, self.audit, self.at, self.state, self.hash, self.place = conv, audit, 0, START, hashlib.sha256(), 0

    def _write(self, role: str, text: str) -> tuple:
        self.hash.update(f"{chr(10) if self.place else ''}{role}:{text}".encode())
        self.place += 1
        return self.conv, self.place - 1, role, text

    def _chosen(self) -> str:
        self.state = CHOSEN[self.state]
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._write(self._chosen(), "")

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = KEPT[role[:1]][self.state]
            yield self._write(role, text)
        elif edit == "R":
            yield self._write(self._chosen(), text)


def _apply(rows: DataFrame, found: DataFrame, schema: str, digest: bool) -> DataFrame:
    none = {c: F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("text", "string"), ("digest", "binary"), ("audit", "string"))}
    heads = found.select("conv_id", *[none[c] for c in ("turn", "role", "text", "digest")], "audit")
    met = _read(rows).withColumn("audit", none["audit"]).unionByName(heads).repartition("conv_id")
    # The audit, then the rows as in the first pass; of equal rows any may come first.
    met = met.sortWithinPartitions("conv_id", F.desc_nulls_last("audit"), F.asc_nulls_first("turn"), "role", "digest")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.string()] if digest else [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def shown(conversation: Written | None, turns: Iterator[tuple], last: bool = False) -> Iterator[tuple]:
        """The turns, or at the end the hash."""
        for turn in turns:
            if not digest:
                yield turn
        if digest and last and conversation is not None:
            yield conversation.conv, conversation.hash.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Written | None = None
        for batch in batches:
            out: list[tuple] = []
            for conv, role, text, audit in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if audit is None:
                    out.extend(shown(now, now.row(role, text)))
                else:
                    out.extend(shown(now, now.inserted() if now else iter(()), last=True))
                    now = Written(conv, audit)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        if now and (out := [*shown(now, now.inserted(), last=True)]):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return met.select("conv_id", "role", "text", "audit").mapInArrow(run, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role, text: the repaired conversations; found is what audits gives for the same rows."""
    return _apply(rows, found, "conv_id long, place long, role string, text string", digest=False)


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: the hash of a repaired conversation's lines role:text."""
    return _apply(rows, found, "conv_id long, repaired_sha256 string", digest=True)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages the conversations, and repairs what is left."""
    given = read(spark, sf_dir, "conversations")
    rows = damage(given)
    found = audits(rows)
    every = given.select(F.col("conv_id").cast("long").alias("id")).distinct()
    for name, table in (("audits", found), ("digests", digests(rows, found))):
        every = every.join(table.withColumnRenamed("conv_id", f"{name}_id"), F.col("id").eqNullSafe(F.col(f"{name}_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _AUDIT_NAMES[1:7]]
    return every.select(F.col("id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


_WAYS = "(VALUES (0, 0, 0, ''), (0, 2, 5, 'I'), (0, 3, 10, 'II'), (1, 1, 0, ''), (1, 2, 5, 'I'), (1, 3, 10, 'II'), (2, 2, 0, ''), (2, 3, 5, 'I'), (3, 3, 0, ''), (3, 2, 5, 'I')) v(q, p, more, mark)"

OP11_SQL = rf"""
WITH RECURSIVE c AS (
  SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 20 AS fault
  FROM conversations),
d AS (SELECT g, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM c, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) WHERE fault <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d),
f AS (SELECT *, left(role, 1) AS mark, NOT regexp_matches(text, '{VISIBLE}') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ 	-]*\z') AS cut FROM o),
r AS MATERIALIZED (SELECT *, blank OR again AS must, cut AND NOT blank AND NOT again AS short, lag(mark) OVER (PARTITION BY g ORDER BY i) AS before FROM f),
n AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (short) AS truncated,
    count(*) FILTER (before || mark NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM r GROUP BY g),
w AS (SELECT g, 0::BIGINT AS i, 0 AS q, 0 AS cost, '' AS audit FROM n UNION ALL
  SELECT g, i, q, b.c, b.a FROM (SELECT g, i, q, min({{'c': cost, 'a': audit}}) AS b FROM (
    SELECT w.g, r.i, e.q, cost + more + e.price + CASE WHEN short AND e.mark <> 'D' THEN 5 ELSE 0 END AS cost, audit || v.mark || e.mark AS audit
    FROM w JOIN {_WAYS} ON v.q = w.q JOIN r ON r.g = w.g AND r.i = w.i + 1
    JOIN (VALUES (0, 0, 2, 'D', ''), (1, 1, 2, 'D', ''), (2, 2, 2, 'D', ''), (3, 3, 2, 'D', ''), (0, 1, 0, 'K', 's'), (0, 2, 0, 'K', 'u'), (1, 2, 0, 'K', 'u'), (3, 2, 0, 'K', 'u'),
      (2, 3, 0, 'K', 'a'), (0, 2, 1, 'R', ''), (1, 2, 1, 'R', ''), (3, 2, 1, 'R', ''), (2, 3, 1, 'R', '')) e(p, q, price, mark, needs)
      ON e.p = v.p AND (e.mark = 'D' OR NOT must) AND (needs = '' OR needs = r.mark)) GROUP BY g, i, q)),
t AS (SELECT g, min({{'c': cost + more, 'a': audit || v.mark}}) AS b FROM w JOIN n USING (g) JOIN {_WAYS} ON v.q = w.q WHERE w.i = rows AND v.p IN (0, 3) GROUP BY g),
a AS (SELECT g, generate_subscripts(string_split(b.a, ''), 1) AS k, unnest(string_split(b.a, '')) AS e FROM t),
s AS (SELECT g, k, e, sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER x AS i, sum(CASE WHEN e = 'D' THEN 0 ELSE 1 END) OVER x AS place FROM a WINDOW x AS (PARTITION BY g ORDER BY k)),
u AS (SELECT s.*, role, text, max(CASE WHEN e = 'K' AND r.mark = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.g) AS system FROM s LEFT JOIN r ON r.g = s.g AND r.i = s.i AND e <> 'I'),
h AS (SELECT g, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (place - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS sum FROM u WHERE e <> 'D' GROUP BY g)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, coalesce(h.sum, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, g FROM c) LEFT JOIN n USING (g) LEFT JOIN t USING (g) LEFT JOIN h USING (g)
"""
