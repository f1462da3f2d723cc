"""The registered queries of the corpus operators against their SQL or brute force, over whole tables."""

import base64
import bisect
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tidewatch.llm import catalog, licenses, quality

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{data}/{name}.parquet')")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def rows(spark, data, name):
    return QUERIES[name](spark, data).collect()


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def low(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data, duck, tmp_path, name):
    df = QUERIES[name](spark, data)
    df.write.parquet(str(tmp_path / "out"))
    cols = ", ".join(f'"{c}"' for c in sorted(df.columns))
    duck.sql(f"CREATE OR REPLACE TEMP TABLE want AS SELECT {cols} FROM ({SQL[name]})")
    got = f"SELECT {cols} FROM read_parquet('{tmp_path}/out/*.parquet')"
    assert duck.sql(f"SELECT {cols} FROM want EXCEPT ALL {got}").fetchall() == []
    assert duck.sql(f"{got} EXCEPT ALL SELECT {cols} FROM want").fetchall() == []


def test_op1_is_near_brute_force(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    got = defaultdict(list)
    for r in rows(spark, data, "op1_ann"):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    asked = [i for i in range(len(ids)) if ids[i] % 100 == 0]
    assert set(got) == {ids[i] for i in asked}
    hits = 0
    for i in asked:
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        best = [ids[j] for j in np.lexsort((ids, d)) if j != i][:10]
        found = sorted(got[ids[i]])
        assert [f[0] for f in found] == list(range(1, 11)) and [f[1:][::-1] for f in found] == sorted(f[1:][::-1] for f in found)
        assert all(f[2] == pytest.approx(d[list(ids).index(f[1])], abs=1e-12) for f in found)
        hits += len(set(best) & {f[1] for f in found})
    assert hits >= 0.9 * 10 * len(asked)


def test_op5_equals_brute_force_and_holds_on_other_labels(spark, data, texts, duck):
    label = duck.sql("SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)").fetchall()
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    x = {c: np.array([quality.statistics(texts[i]) for i, q in label if q == c and i in texts and not out(i)]) for c in (0, 1)}
    n = {c: len(v) for c, v in x.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in x.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])

    def density(c, v):
        own = 0.7 * cov[c] + 0.3 * pooled
        own = 0.99 * own + 0.01 * np.diag(np.diag(own)) + 1e-4 * np.eye(len(own))
        off = v - x[c].mean(axis=0)
        return math.log(n[c]) - 0.5 * np.linalg.slogdet(own)[1] - 0.5 * off @ np.linalg.solve(own, off)

    got = rows(spark, data, "op5_quality")
    assert len(got) == len(texts)
    for r in got:
        v = quality.statistics(texts[r.doc_id])
        want = 1 / (1 + math.exp(-max(-500.0, min(500.0, density(1, v) - density(0, v)))))
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.7) and r.held_out == out(r.doc_id)
    known = dict(label)
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert sum(r.predicted == known[r.doc_id] for r in held) >= 0.9 * len(held)


def test_op7_equals_the_tokenizer(spark, data, texts):
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, data, "op7_byte_bpe")
    assert len(got) == len(texts)
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(texts[r.doc_id].encode()))


def test_op8_equals_brute_force(spark, data, texts):
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None] for i, t in texts.items()}
    pairs = {i: list(zip([None, *t[:-1]], t, strict=True)) for i, t in tokens.items()}
    count = lambda keep, of: Counter(x for i in texts if keep(fold(i)) for x in of[i])
    one, two = count(lambda f: f, tokens), count(lambda f: f, pairs)
    n, v = sum(one.values()), len(one)
    kept_one, kept_two = count(lambda f: f > 1, tokens), count(lambda f: f > 1, pairs)
    kept_n = sum(kept_one.values())
    bucket = lambda c: min(math.ceil(math.log2(c + 1)), 15)
    held = defaultdict(list)
    for i in texts:
        if fold(i) == 1:
            for h, w in pairs[i]:
                held[bucket(kept_one[h])].append((kept_two[h, w] / max(kept_one[h], 1), kept_one[w] / kept_n, 1 / (v + 1)))
    weights = {}
    for b in range(16):
        x = np.array([b > 0, 1, 1], float)
        x /= x.sum()
        p = np.array(held.get(b, [])).reshape(-1, 3)
        for _ in range(50 if len(p) else 0):
            share = p * x
            x = (share / share.sum(axis=1, keepdims=True)).mean(axis=0)
        weights[b] = np.maximum(x, [1e-6 * (b > 0), 1e-6, 1e-6]) / np.maximum(x, [1e-6 * (b > 0), 1e-6, 1e-6]).sum()
    got = rows(spark, data, "op8_lm_scoring")
    assert len(got) == len(texts)
    for r in got:
        t = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(r.doc_id) == 0, len(t), sum(one[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        want = 0.0
        for h, w in pairs[r.doc_id]:
            x = weights[bucket(one[h])]
            want += math.log10(x[0] * two[h, w] / max(one[h], 1) + x[1] * one[w] / n + x[2] / (v + 1))
        assert r.score == pytest.approx(want, rel=0.01)  # the operator's EM reads bins of the held-out estimates


def test_op9_equals_brute_force(spark, data, texts, duck):
    source = dict(duck.sql("SELECT doc_id, source FROM documents").fetchall())
    key = {i: hashlib.md5(f"mix-1:{i}".encode()).hexdigest() for i in texts}
    strata = defaultdict(list)
    for i in texts:
        strata["-" if source[i] is None else "+" + source[i]].append(i)
    place = {}
    for s, own in strata.items():
        for n, i in enumerate(sorted(own, key=lambda i: (key[i], i))):
            place[i] = ((2 * n + 1) / (2 * len(own)), s, key[i], i)
    total = len(texts)
    cuts = [-(-s * total // 24) for s in range(25)]
    want = {}
    for n, i in enumerate(sorted(texts, key=place.get)):
        shard = bisect.bisect_right(cuts, n) - 1
        want[i] = (shard, n - cuts[shard])
    got = rows(spark, data, "op9_sharding")
    assert {r.doc_id: (r.shard, r.slot) for r in got} == want and len(got) == total
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "rows", None)


def test_op10_finds_every_whole_copy(spark, data, texts):
    own = {name: licenses.words_of(t) for name, t in licenses.TEMPLATES.items()}
    got = {r.doc_id: r for r in rows(spark, data, "op10_licenses")}
    assert set(got) == set(texts)
    found = 0
    for i, text in texts.items():
        words = " " + " ".join(licenses.words_of(text)) + " "
        there = {n for n, w in own.items() if " " + " ".join(w) + " " in words}
        named = set(filter(None, got[i].licenses.split(",")))
        # What stands there whole is found, or overlaps a longer one that is.
        assert all(n in named or any(len(own[k]) > len(own[n]) for k in named) for n in there)
        assert (got[i].license is None) == (not named) and (not there or got[i].coverage == 1.0)
        found += bool(there)
    assert found > 0
