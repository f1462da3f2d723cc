"""Repair of conversations against a search through all edits."""

import hashlib
import heapq
import random
import zlib

import pytest

from tidewatch.llm import conversations as conv

SCHEMA = "conv_id long, turn long, role string, text string, audit string, place int, copies int"


def first_found(rows):
    """(cost, labels) by best-first search over whole label strings, without any states put together."""
    heap = [(0, "", 0, 0)]
    while heap:
        cost, labels, i, g = heapq.heappop(heap)
        if i == len(rows) and conv.FINAL[g]:
            return cost, labels
        if labels[-2:] != "II":
            for role in "ua":
                if role in conv.GRAMMAR[g]:
                    heapq.heappush(heap, (cost + 5, labels + "I", i, conv.GRAMMAR[g][role]))
        if i < len(rows):
            initial, fault = rows[i]
            more = 5 if fault == conv.CUT_OFF else 0
            heapq.heappush(heap, (cost + 2, labels + "D", i + 1, g))
            if fault not in (conv.BLANK, conv.DUPLICATE):
                if initial in conv.GRAMMAR[g]:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, conv.GRAMMAR[g][initial]))
                for role in "ua":
                    if role in conv.GRAMMAR[g]:
                        heapq.heappush(heap, (cost + 1 + more, labels + "R", i + 1, conv.GRAMMAR[g][role]))


def test_shortest_paths_equal_a_search():
    rng = random.Random(1)
    for _ in range(600):
        rows = [(rng.choice(["s", "u", "u", "a", "a", "", "t"]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randint(0, 6))]
        assert conv.shortest(len(rows), lambda i: rows[i]) == first_found(rows), rows


def expected(rows):
    """Of one conversation's rows (turn, role, text): counts, audit and repaired rows, by plain loops."""
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest())
    rows, seen, faults = sorted(rows, key=key), set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    cost, labels = first_found([(r[1][:1], f) for r, f in zip(rows, faults, strict=True)])
    out, i, g = [], 0, 0
    for x in labels:
        role, text = ("", "") if x == "I" else rows[i][1:]
        i += x != "I"
        if x == "D":
            continue
        if x != "K":
            role = "user" if "u" in conv.GRAMMAR[g] else "assistant"
        g = conv.GRAMMAR[g][role[0]]
        out.append((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in (1, 2, 3)), illegal, cost, labels), out


def test_odd_conversations_equal_plain_loops(spark):
    rng = random.Random(2)
    texts = ["Yes.", "No!", "so", " \t", "", None, "Why? ", "a.b", "é…", "x" * 50_000 + "."]
    roles = ["user", "assistant", "system", "", None, "tool", "User"]
    rows = []
    for c in [None, *range(60)]:
        for _ in range(rng.randint(1, 6)):
            rows.append((c, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(roles), rng.choice(texts), "a", 1, 7))
    rows += rows[:20]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    damaged = conv.damaged(df)
    got = {r.conv_id: r for r in conv.repair_digests(damaged, conv.plans(damaged, df)).collect()}
    messages = {}
    for r in conv.repaired(damaged, conv.plans(damaged, df)).orderBy("place").collect():
        messages.setdefault(r.conv_id, []).append((r.role, r.text))
    by = {}
    for c, turn, role, text, *_ in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text, own = role if role is not None else " ", text if text is not None else " ", by.setdefault(c, [])
        if h == 0:
            continue
        text = "" if h == 1 else text.translate({46: None, 33: None, 63: None}) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    assert set(got) == set(by)
    for c, own in by.items():
        facts, out = expected(own)
        r = got[c]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == facts, own
        assert messages.get(c, []) == out
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()


def test_no_rows_at_all(spark):
    df = spark.createDataFrame([], SCHEMA)
    damaged = conv.damaged(df)
    assert conv.repair_digests(damaged, conv.plans(damaged, df)).count() == 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    df = spark.createDataFrame([(5, dropped, "user", "Hi.", "", 0, 1)], SCHEMA)
    damaged = conv.damaged(df)
    (r,) = conv.repair_digests(damaged, conv.plans(damaged, df)).collect()
    assert tuple(r) == (5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("n", [20_000])
def test_a_long_conversation(spark, n):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"{t}." if t % 7 else f"{t}") for t in range(n)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies int")
    (r,) = conv.repair_digests(df, conv.plans(df, df)).collect()
    assert (r.gaps, r.truncated, r.illegal) == (0, -(-n // 7), 0) and len(r.audit.replace("I", "")) == n
    out = [x for x in conv.repaired(df, conv.plans(df, df)).orderBy("place").select("role").toPandas().role]
    assert out == ["user", "assistant"] * (len(out) // 2)
