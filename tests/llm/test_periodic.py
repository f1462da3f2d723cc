"""Runs of periodic words against brute force, and on odd texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import periodic

SCHEMA = "doc_id long, text string, runs string, collapsed int, n_runs string, start string, __tw_x int"


def all_runs(words, least=12):
    """Every maximal stretch, by trying all periods from all places."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((s, e, q) for (s, e), q in found.items())


def kept(words, runs):
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def odd_text(rng):
    n, k = rng.randint(0, 80), rng.choice([1, 2, 3, 6])
    w = [rng.randint(0, k) for _ in range(n)]
    if n > 4 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = rng.randint(1, max(1, (n - a) // 2))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        w[rng.randrange(n)] = rng.choice([w[0], 99])
        w += w[: rng.randint(0, n)]
    return w


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(100):
        texts = [odd_text(rng) for _ in range(rng.randint(1, 4))]
        bounds = np.cumsum([0, *map(len, texts)])
        got = periodic.text_runs(np.array(sum(texts, []), np.int64), bounds)
        want = [(s + bounds[k], e + bounds[k], q) for k, w in enumerate(texts) for s, e, q in all_runs(w)]
        assert sorted(map(tuple, got.tolist())) == sorted(want)


def test_fibonacci_words_and_powers_have_all_their_runs():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for w in (b, [0] * 500, [0, 1] * 250, ([0, 1, 2, 0, 1] * 30 + [7]) * 3):
        got = periodic.text_runs(np.array(w), np.array([0, len(w)]))
        assert list(map(tuple, got.tolist())) == all_runs(w)


def test_texts_keep_what_no_run_repeats(spark):
    rng = random.Random(5)
    line = " ".join(f"w{i}" for i in range(9))
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "A a " * 12, f"x {line} {line} {line} y", " ".join(map(str, rng.choices(range(3), k=4000))), "é ß " * 20, "x\x0bx\x0c" * 9]
    texts += [" ".join(map(str, odd_text(rng))) for _ in range(40)]
    rows = [(None if i == 20 else i, t, "r", 1, "n", "s", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[7], rows[7]], SCHEMA).repartition(3)
    found = periodic.periodic_runs(docs)
    assert found.columns == ["doc_id", "text", "n_runs", "start", "__tw_x", "runs", "collapsed"]
    got = found.collect()
    assert len(got) == len(rows) + 2 and all((r.n_runs, r.start, r["__tw_x"]) == ("n", "s", 3) for r in got)
    for r in got:
        words = [w.decode() for w in (r.text or "").encode().split()]
        want = all_runs(words)
        assert [(x.start, x.start + x.length, x.period) for x in r.runs] == want
        assert r.collapsed == kept(words, want)
    none = periodic.digests(periodic.periodic_runs(periodic.with_periods(docs.limit(0))))
    assert none.count() == 0 and none.columns[0] == "doc_id"


def test_a_long_text_with_a_period_of_its_half(spark):
    words = [f"w{i % 60_000}" for i in range(120_000)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    (r,) = periodic.periodic_runs(docs).collect()
    assert [tuple(x) for x in r.runs] == [(0, 120_000, 60_000)] and r.collapsed == " ".join(words[:60_000])


def test_planted_periods_follow_the_contract(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 50))) for i in range(200)], "doc_id long, text string")
    import zlib

    for r in periodic.with_periods(docs.withColumn("own", F.col("text"))).collect():
        w, h = r.own.split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        assert r.text.split() == w
