"""Repair of conversations' structure by composing weighted finite-state machines.

A conversation is an input acceptor, a chain of one arc a row. The edit transducer turns a row into
a kept, reroled or deleted one, or makes up a row, each at a cost. The role grammar accepts what a
conversation's role initials may be. Their composition is built lazily, in layers from the start:
a state is (rows read, rows made up since the last one read, grammar state), and only states that
the start reaches are made. Making up rows never reads one, but more than two of them in a row
would come back to a grammar state at a cost, so their number bounds the layers and the composition
has no cycle. Weights are pairs (cost, labels), added in order and compared by cost, then by the
labels' text. One pass against the topological order finds the least cost to the end of every
state; from one state, different arcs have different labels, so a walk from the start along the
least label among the arcs of least cost spells the least text.

Two passes over rows dealt by conversation and sorted by turn. The first moves no texts: their
digests, role initials and flags. It holds two bytes a row of the conversation that is open, and 30
while it searches. The second moves texts and the labels, and feeds each conversation's repaired
rows to its digest one after another (a digest of all rows is one sequence); it holds the labels
alone, one byte a row. Equal rows of one turn are counted before they are moved.

Defined cases: null turns come first; rows of one turn are ordered by role, then by the SHA-256 of
their text, so that equal rows are neighbours; null roles and texts are one blank, so a null text is
a blank fault; a null conversation id is a conversation; an empty role has no initial, so its row is
reroled or deleted; a conversation without rows is repaired to none at no cost; an empty table gives
an empty one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewatch.llm.common import small_batches, tidy
from tidewatch.session import table

SPACES = r"[\x20\x09-\x0D]"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
MADE_UP = 2

#: The role grammar s?(ua)+ or nothing: from each state, the next one by role initial.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (True, False, False, True)

SOUND, BLANK, DUPLICATE, CUT_OFF = range(4)


def edits(initial: str, fault: int) -> list[tuple[str, str, int]]:
    """The edit transducer's arcs of one row: (label, role initial put out, cost)."""
    gone = [("D", "", DELETE)]
    if fault in (BLANK, DUPLICATE):
        return gone
    more = TRUNCATED if fault == CUT_OFF else 0
    return gone + ([("K", initial, KEEP + more)] if initial else []) + [("R", role, REROLE + more) for role in "ua"]


WIDE = len(GRAMMAR) * (MADE_UP + 1)


def _composed(arcs: list[tuple[str, str, int]]) -> list[list[tuple[str, int, int]]]:
    """Arcs that read a row from each state of a layer: (label, state of the next layer, cost)."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(WIDE)]
    for made in range(MADE_UP + 1):
        for g, follows in enumerate(GRAMMAR):
            for label, role, cost in arcs:
                to = g if not role else follows.get(role)
                if to is not None:
                    out[made * len(GRAMMAR) + g].append((label, to, cost))
    return out


#: Arcs that make up a row, within a layer; they lead to states of higher number.
_INSERTS = [
    [("I", (made + 1) * len(GRAMMAR) + to, INSERT) for role, to in GRAMMAR[g].items() if role in "ua"] if made < MADE_UP else []
    for made in range(MADE_UP + 1)
    for g in range(len(GRAMMAR))
]


def shortest(n: int, at: Callable[[int], tuple[str, int]]) -> tuple[int, str]:
    """(cost, labels) of the least path; at(i): (role initial, fault) of row i of n."""
    known: dict[tuple[str, int], list] = {}

    def reads(i: int) -> list:
        row = at(i)
        if row not in known:
            known[row] = _composed(edits(*row))
        return known[row]

    # Ahead: which states of each layer the start reaches.
    reached, now = array("H"), 1
    for i in range(n + 1):
        for state in range(WIDE):
            if now >> state & 1:
                for _, to, _ in _INSERTS[state]:
                    now |= 1 << to
        reached.append(now)
        if i < n:
            arcs, then = reads(i), 0
            for state in range(WIDE):
                if now >> state & 1:
                    for _, to, _ in arcs[state]:
                        then |= 1 << to
            now = then
    # Back: the least cost of each state to the end, and the label and state that it goes on with.
    none = 1 << 60
    best = [none] * WIDE
    steps = bytearray((n + 1) * WIDE)  # 16 for an arc that reads, plus its place among the state's arcs; 255: the end
    after = [none] * WIDE
    for i in range(n, -1, -1):
        best, mask = [none] * WIDE, reached[i]
        arcs = reads(i) if i < n else None
        for state in range(WIDE - 1, -1, -1):
            if not mask >> state & 1:
                continue
            found, label, step = none, "", 255
            if i == n and FINAL[state % len(GRAMMAR)]:
                found = 0
            for k, (name, to, cost) in enumerate(_INSERTS[state]):
                if (total := cost + best[to]) < found or (total == found and name < label):
                    found, label, step = total, name, k
            if arcs is not None:
                for k, (name, to, cost) in enumerate(arcs[state]):
                    if (total := cost + after[to]) < found or (total == found and name < label):
                        found, label, step = total, name, 16 + k
            best[state], steps[i * WIDE + state] = found, step
        after = best
    labels, i, state = bytearray(), 0, 0
    while (step := steps[i * WIDE + state]) != 255:
        name, state, _ = reads(i)[state][step - 16] if step >= 16 else _INSERTS[state][step]
        i += step >= 16
        labels += name.encode()
    return after[0], labels.decode()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of the rows that op12's contract leaves."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn"))) % 20
    return conversations.where(h != 0).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.when(h == 4, "user").otherwise(spaced("role")).alias("role"),
        F.when(h == 1, "").when(h == 2, F.regexp_replace(spaced("text"), "[.!?]", "")).otherwise(spaced("text")).alias("text"), F.when(h == 3, 2).otherwise(1).alias("copies"),
    )


def _last(text: Column) -> Column:
    """The last character that isn't white space."""
    return F.substring(F.regexp_replace(text, SPACES + "+$", ""), -1, 1)


def _flagged(rows: DataFrame) -> DataFrame:
    """Distinct rows of a turn with their copies, role initial, and the fault of the first copy; no texts."""
    key = [F.col("conv_id"), F.col("turn"), F.col("role"), F.unhex(F.sha2("text", 256)).alias("tag")]
    last = _last(F.col("text"))
    slim = rows.select(*key, F.when(last == "", BLANK).when(last.isin(".", "!", "?"), SOUND).otherwise(CUT_OFF).alias("fault"), "copies")
    once = slim.groupBy("conv_id", "turn", "role", "tag", "fault").agg(F.sum("copies").alias("copies"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "tag").orderBy("turn")) > 1
    return once.withColumn("fault", F.when((F.col("fault") != BLANK) & seen, DUPLICATE).otherwise(F.col("fault"))).withColumn("initial", F.substring("role", 1, 1))


LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Open:
    """What is known of the conversation that is being read."""

    def __init__(self, conv):
        self.conv, self.initials, self.faults = conv, bytearray(), bytearray()
        self.first = self.turn = self.before = None
        self.turns = self.illegal = 0

    def add(self, turn: int | None, initial: str, fault: int, copies: int) -> None:
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        self.illegal += (copies - 1) * (2 * initial not in LEGAL)
        self.before = initial
        self.initials += (initial if initial in ("s", "u", "a") else " ").encode() * copies  # the grammar knows no other
        self.faults += bytes([fault]) + bytes([BLANK if fault == BLANK else DUPLICATE]) * (copies - 1)

    def plan(self) -> tuple:
        cost, labels = shortest(len(self.faults), lambda i: (chr(self.initials[i]).strip(), self.faults[i]))
        gaps = 0 if self.first is None else self.turn - self.first + 1 - self.turns
        return self.conv, gaps, *(self.faults.count(x) for x in (BLANK, DUPLICATE, CUT_OFF)), self.illegal, cost, labels


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def plans(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id of ids with COUNTS and the audit: each conversation's faults, and the labels of its edits of least cost.

    rows: conv_id, turn, role, text and copies, the number of times that a row stands there.
    """
    schema = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            done = []
            for conv, turn, initial, fault, copies in _columns(batch, "conv_id", "turn", "initial", "fault", "copies"):
                if fault is None:  # each conversation begins with a row of ids
                    if now is not None:
                        done.append(now.plan())
                    now = _Open(conv)
                else:
                    now.add(turn, initial, fault, copies)
            yield told(done)
        if now is not None:
            yield told([now.plan()])

    def told(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in done], arrow)

    arrow = to_arrow_schema(schema)
    flagged = _flagged(rows)
    marks = ids.select("conv_id").distinct().select("conv_id", *(F.lit(None).cast(flagged.schema[c].dataType).alias(c) for c in flagged.columns[1:]))
    slim = flagged.unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", F.col("fault").isNotNull(), "turn", "role", "tag")
    return slim.select("conv_id", "turn", "initial", "fault", "copies").mapInArrow(tidy(run), schema)


def _walk(batches: Iterator[pa.RecordBatch], begin: Callable, put: Callable, end: Callable) -> Iterator[list]:
    """Go through sorted plans and rows: begin(plan row), put(role, text) of each repaired row, end(), which gives a result or None. Yields the results of each batch."""
    labels, at, g = "", 0, 0

    def take(role: str, text: str) -> None:
        nonlocal g
        g = GRAMMAR[g][role[0]]
        put(role, text)

    def made(role: str | None, text: str) -> None:
        take(role or ("user" if "u" in GRAMMAR[g] else "assistant"), text)

    def inserts() -> None:
        nonlocal at
        while at < len(labels) and labels[at] == "I":
            made(None, "")
            at += 1

    running = False
    for batch in batches:
        out = []
        for n, (audit, role, text, copies) in enumerate(_columns(batch, "audit", "role", "text", "copies")):
            if audit is not None:
                if running:
                    inserts()
                    out.append(end())
                labels, at, g, running = audit, 0, 0, True
                begin({c: batch.column(c)[n].as_py() for c in ("conv_id", *COUNTS, "audit")})
                continue
            for _ in range(copies):
                inserts()
                if (label := labels[at]) != "D":
                    made(role if label == "K" else None, text)
                at += 1
        yield out
    if running:
        inserts()
        yield [end()]


def _planned(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Plans, each followed by its rows in order."""
    both = planned.unionByName(rows.select("conv_id", "turn", "role", "text", "copies"), allowMissingColumns=True)
    tag = F.unhex(F.sha2("text", 256))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), "turn", "role", tag).select("conv_id", *COUNTS, "audit", "role", "text", "copies")


def repaired(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """conv_id, place, role, text of what the plans make of the rows."""
    small_batches(rows.sparkSession)
    schema = T.StructType([rows.schema["conv_id"], T.StructField("place", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, out = None, 0, []

        def begin(plan: dict) -> None:
            nonlocal conv, place
            conv, place = plan["conv_id"], 0

        def put(role: str, text: str) -> None:
            nonlocal place
            out.append({"conv_id": conv, "place": place, "role": role, "text": text})
            place += 1

        for _ in _walk(batches, begin, put, lambda: None):
            yield pa.RecordBatch.from_pylist(out, arrow)
            out.clear()

    arrow = to_arrow_schema(schema)
    return _planned(rows, planned).mapInArrow(tidy(run), schema)


def repair_digests(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The plans with repaired_sha256, of the repaired rows as role:text, joined by newlines."""
    small_batches(rows.sparkSession)
    schema = T.StructType([*planned.schema.fields, T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, digest, any_ = {}, hashlib.sha256(), False

        def begin(found: dict) -> None:
            nonlocal plan, digest, any_
            plan, digest, any_ = found, hashlib.sha256(), False

        def put(role: str, text: str) -> None:
            nonlocal any_
            digest.update(("\n" * any_ + role + ":").encode())
            digest.update(text.encode())
            any_ = True

        for done in _walk(batches, begin, put, lambda: plan | {"repaired_sha256": digest.hexdigest()}):
            yield pa.RecordBatch.from_pylist(done, arrow)

    arrow = to_arrow_schema(schema)
    return _planned(rows, planned).mapInArrow(tidy(run), schema)


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    rows = damaged(given)
    return repair_digests(rows, plans(rows, given))


#: Conversations' rows in a recursion ahead, which keeps the least (cost, labels) of each grammar state.
OP12_SQL = r"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1))))) % 20 AS h
  FROM conversations),
conv AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
rowz AS (
  SELECT c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM given WHERE h <> 0) g JOIN conv ON g.conv_id IS NOT DISTINCT FROM conv.conv_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, right(regexp_replace(text, '[ 	-
]+$', ''), 1) AS z FROM rowz),
faulty AS (
  SELECT *, left(role, 1) AS r, left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) || left(role, 1) AS pair,
    CASE WHEN z = '' THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2 WHEN z IN ('.', '!', '?') THEN 0 ELSE 3 END AS f
  FROM placed),
-- v0 to v3: the least (cost, labels) in grammar states start, s, u and a; w2 and w3 after rows were made up.
path AS (
  SELECT c, 0 AS i, {'k': 0, 'l': ''} AS v0, {'k': 1000000000, 'l': ''} AS v1, {'k': 5, 'l': 'I'} AS w2, {'k': 10, 'l': 'II'} AS w3 FROM conv
  UNION ALL
  SELECT c, i, v0, v1, w2, least(v3, {'k': w2.k + 5, 'l': w2.l || 'I'}) AS w3 FROM (
    SELECT c, i, v0, v1, v3, least(v2, {'k': v0.k + 5, 'l': v0.l || 'I'}, {'k': v1.k + 5, 'l': v1.l || 'I'}, {'k': v3.k + 5, 'l': v3.l || 'I'}) AS w2 FROM (
      SELECT p.c, p.i + 1 AS i, {'k': v0.k + 2, 'l': v0.l || 'D'} AS v0,
        least({'k': v1.k + 2, 'l': v1.l || 'D'}, {'k': v0.k + off + CASE WHEN r = 's' THEN 0 ELSE 1000000000 END, 'l': v0.l || 'K'}) AS v1,
        least({'k': w2.k + 2, 'l': w2.l || 'D'}, {'k': v0.k + off + CASE WHEN r = 'u' THEN 0 ELSE 1 END, 'l': v0.l || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END},
          {'k': v1.k + off + CASE WHEN r = 'u' THEN 0 ELSE 1 END, 'l': v1.l || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END},
          {'k': w3.k + off + CASE WHEN r = 'u' THEN 0 ELSE 1 END, 'l': w3.l || CASE WHEN r = 'u' THEN 'K' ELSE 'R' END}) AS v2,
        least({'k': w3.k + 2, 'l': w3.l || 'D'}, {'k': w2.k + off + CASE WHEN r = 'a' THEN 0 ELSE 1 END, 'l': w2.l || CASE WHEN r = 'a' THEN 'K' ELSE 'R' END}) AS v3
      FROM path p JOIN (SELECT c, i, r, CASE WHEN f IN (1, 2) THEN 1000000000 WHEN f = 3 THEN 5 ELSE 0 END AS off FROM faulty) y ON p.c = y.c AND y.i = p.i + 1))),
chosen AS (SELECT c, arg_max(least(v0, w3), i) AS b FROM path GROUP BY c),
label AS (SELECT c, unnest(string_split(b.l, '')) AS x, unnest(range(1, 1 + len(b.l))) AS t FROM chosen WHERE b.l <> ''),
spelt AS (SELECT *, count(*) FILTER (x <> 'I') OVER s AS i, count(*) FILTER (x <> 'D') OVER s AS o FROM label WINDOW s AS (PARTITION BY c ORDER BY t)),
met AS (
  SELECT s.c, s.o, s.x, y.role, y.r, CASE WHEN s.x = 'I' THEN '' ELSE y.text END AS text,
    max(CASE WHEN s.o = 1 AND s.x = 'K' AND y.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.c) AS sys
  FROM spelt s LEFT JOIN faulty y ON s.c = y.c AND s.i = y.i AND s.x <> 'I' WHERE s.x <> 'D'),
told AS (SELECT c, string_agg(CASE WHEN x = 'K' THEN role WHEN (o - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o) AS t FROM met GROUP BY c),
facts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 1) AS blank, count(*) FILTER (f = 2) AS duplicate, count(*) FILTER (f = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.k::BIGINT AS cost, b.l AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM conv JOIN chosen USING (c) LEFT JOIN facts USING (c) LEFT JOIN told USING (c)
"""
