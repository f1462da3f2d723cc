"""Corpus operators against brute force, and on nulls, empty tables, ties, repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tidewatch.llm import ann, byte_bpe, decontamination, induced, jaccard, licenses, lm_scoring, quality, sharding, suffix_dedup, url_filter

rng = random.Random(7)
WORDS = ["the", "of", "Tion", "ER", "and", "inter", "über", "naïve", "x1", "don't", "alpha", "beta", "gamma", "delta", "École", "zwölf"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, row int, node string, ids string, kept int, label string"


def sentence(n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", str(rng.randint(0, 99))]) for _ in range(n))


def make(texts, ids=None):
    return [(i if ids is None else ids[i], t, "en", None if i % 5 == 0 else f"s{i % 3}", 1, "clash", i, "n", "i", 7, "l") for i, t in enumerate(texts)]


PASSAGE = sentence(120)
ODD = [None, "", " \n\t", "a", "a b", "a b c", "\U0001f600 é\u00a0x", "Ä" * 700]
BASE = sentence(300)
TEXTS = [
    *ODD, BASE, BASE, BASE.replace("beta", "BETA", 1), BASE + " tail", " ".join(BASE.split()[:-3]), sentence(80) + " " + PASSAGE + " " + sentence(60), PASSAGE + " " + sentence(20),
    sentence(5000), *(sentence(rng.randint(3, 90)) for _ in range(25)), "xy" * 600, ("ab " * 400).strip(),
]


@pytest.fixture(scope="module")
def docs(spark):
    ids = list(range(len(TEXTS)))
    ids[-3] = None
    rows = make(TEXTS, ids)
    return spark.createDataFrame([*rows, rows[8]], DOCS).repartition(3)  # one row twice


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


# Approximate nearest neighbours


def test_ann_is_near_brute_force_and_takes_odd_vectors(spark):
    g = np.random.default_rng(2)
    x = g.normal(size=(600, 32)).astype("float32")
    x[50] = x[60] = x[0]
    rows = [(i, v.tolist(), 1, "clash") for i, v in enumerate(x)]
    rows += [(900, None, 1, ""), (901, [0.0] * 32, 1, ""), (902, [float("nan")] + [1.0] * 31, 1, ""), (903, [None] + [1.0] * 31, 1, ""), (None, x[3].tolist(), 1, ""), (904, [1.0, 2.0], 1, ""), rows[5]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, bucket_rows=40).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == [0, 100, 200, 300, 400, 500] and all(sorted(v) == list(range(1, 11)) for v in got.values())
    hits = 0
    y = x.astype("float64")
    for q, found in got.items():
        d = np.sqrt(((y - y[q]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hits += len(set(best) & {v for v, _ in found.values()})
        assert all(s == pytest.approx(d[v], abs=1e-12) for v, s in found.values())
    assert hits >= 0.9 * 60
    assert [got[0][1][0], got[0][2][0]] == [50, 60]  # ties by id
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    fine = ann.nearest(df, F.col("vec_id") % 100 == 0, axes=2, probes=12).count()
    assert fine > 0


def test_ann_looks_into_the_same_share_of_buckets_whatever_the_size(spark, monkeypatch):
    asked, buckets = [], ann._buckets
    monkeypatch.setattr(ann, "_buckets", lambda first, tables, axes, seed: asked.append((first, tables, axes)) or buckets(first, tables, axes, seed))
    for n in (100, 200_001):
        ann.nearest(spark.range(n).select(F.col("id").alias("vec_id"), F.array((F.col("id") + 1).cast("float")).alias("embedding")), F.col("vec_id") % 100 == 0)
    assert asked[:2] == asked[2:]


# Benchmark decontamination


def brute_hits(texts, items):
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t)) if w]
    out = []
    for t in texts:
        w, hit, who = split(t), set(), set()
        for i, it in items:
            v = split(it)
            n = min(len(v), 10)
            wins = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else ():
                if tuple(w[p : p + n]) in wins and i is not None:
                    hit.update(range(p, p + n))
                    who.add(str(i))
        out.append((len(w), len(hit), sorted(who)))
    return out


def test_decontamination_equals_brute_force(spark, docs, none):
    items = [(1, " ".join(PASSAGE.split()[20:60])), (2, "alpha beta gamma"), (3, ""), (4, None), (5, BASE), (5, "tail"), (None, "the of"), (7, "don't")]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, doc_id string")
    got = decontamination.decontaminate(docs, bench)
    want = Counter((n, h, tuple(w)) for n, h, w in brute_hits([*TEXTS, TEXTS[8]], items))
    assert Counter((r.n_words, r.n_hit, tuple(r.item_ids)) for r in got.collect()) == want
    plain = decontamination.decontaminate(docs, bench.where("item_id = 1"))
    wide = decontamination.hits(docs, bench.where("item_id = 1"), broadcast_rows=0).where("item_id is not null")
    assert {r.doc_id for r in plain.where("contaminated").collect()} == {r.doc_id for r in wide.collect()} == {13, 14}
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    kept = decontamination.drop_contaminated(docs, bench.where("item_id = 1"))
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2


# N-gram Jaccard join


def brute_components(rows, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.setdefault(i, []).append({tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    name = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if name[b] < name[a] and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    name[a], changed = name[b], True
    return name, {i: {len(s) for s in v} for i, v in sets.items()}


def edited(words, k):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.mark.parametrize("chunk", [4000, 5])
def test_jaccard_equals_brute_force(spark, none, chunk):
    rng.seed(11)
    texts = list(TEXTS)
    for _ in range(4):
        base = sentence(rng.randint(60, 220)).split()
        texts += [edited(base, rng.randint(0, 5)) for _ in range(14)]
    texts += ["one two three four", "one two three four five", "ONE two three four"]
    rows = make(texts)
    df = spark.createDataFrame([*rows, rows[8], (None, BASE, *rows[0][2:])], DOCS)
    want, sizes = brute_components([(r[0], r[1]) for r in rows])
    got = jaccard.near_duplicates(df, 90, chunk, 3).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert r.component_id == want[r.doc_id] and r.n_shingles in sizes[r.doc_id]
    assert jaccard.near_duplicates(none).count() == 0
    kept = jaccard.keep_first(df, 90, 3)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {None, *(i for i, c in want.items() if i == c)}


def test_signatures_of_sets_over_the_threshold_meet():
    g = np.random.default_rng(4)
    for _ in range(200):
        n = int(g.integers(1, 120))
        a = np.unique(g.integers(1, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.r_[a[int(g.integers(0, max(1, len(a) // 12 + 1))) :], g.integers(1, 1 << 60, int(g.integers(0, len(a) // 12 + 1))).astype(np.uint64)])
        if 100 * len(np.intersect1d(a, b)) < 90 * len(np.union1d(a, b)) or len(a) == len(b) == len(np.intersect1d(a, b)):
            continue
        doc, sign = jaccard.signatures(np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b], np.array([len(a), len(b)]), 90)
        assert set(sign[doc == 0]) & set(sign[doc == 1])


def test_pipeline_keeps_one_of_near_copies_by_five_words_and_80_percent(spark):
    words = [f"w{i}" for i in range(50)]
    one, two = [*words[:20], "odd", *words[21:]], [*words[:20], "odd", *words[21:35], "even", *words[36:]]  # 41 of 51 and 36 of 56 five-word shingles
    other = [f"v{i}" for i in range(50)]
    df = spark.createDataFrame(make([" ".join(t) for t in (words, one, other, [*other[:25], *two[25:]])]), DOCS)
    near = {r.doc_id: r.component_id for r in jaccard.near_duplicates(df).collect()}
    assert near == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r.doc_id for r in jaccard.keep_first(df, 90, 3).collect()} == {0, 1, 2, 3}  # op3's contract
    assert {r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, df, "").collect()} == {0, 2, 3}
    far = spark.createDataFrame(make([" ".join(words), " ".join(two)]), DOCS)
    assert corpus_pipeline.keep_one_of_near_duplicates(spark, far, "").count() == 2


def test_signatures_of_sets_over_80_percent_meet():
    g = np.random.default_rng(5)
    for _ in range(200):
        n = int(g.integers(5, 120))
        a = np.unique(g.integers(1, 1 << 60, n).astype(np.uint64))
        b = np.unique(np.r_[a[int(g.integers(0, n // 6 + 1)) :], g.integers(1, 1 << 60, int(g.integers(0, n // 6 + 1))).astype(np.uint64)])
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)) or len(a) == len(b) == len(np.intersect1d(a, b)):
            continue
        doc, sign = jaccard.signatures(np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b], np.array([len(a), len(b)]), 80)
        least = jaccard.least_shared(np.repeat([0, 1], [len(a), len(b)]), np.r_[a, b], np.array([len(a), len(b)]), 80)
        assert len(set(sign[doc == 0]) & set(sign[doc == 1])) >= least.max() >= 1


def families_with_a_foreign_pivot(wanted):
    """Texts in fours, of which the last two are linked in a group whose pivot is in another group."""
    own, out = random.Random(3), []
    for f in range(20_000):
        words = [f"f{f}w{i}" for i in range(60)]
        two = list(words)
        for i in own.sample(range(60), 4):
            two[i] = f"f{f}two{i}"
        one = list(two)
        for i in own.sample(range(60), 4):
            one[i] = f"f{f}one{i}"
        four = [*words[:30], f"f{f}four", *words[31:]]
        texts = [" ".join(w) for w in (one, two, words, four)]
        doc, hashed = jaccard.shingle_sets(texts, 3)
        size, node = jaccard.node_ids(doc, hashed, 4)
        if list(np.argsort(node)) not in ([0, 1, 2, 3], [0, 1, 3, 2]):
            continue
        of, sign = jaccard.signatures(doc, hashed, size, 90)
        signs = [set(sign[of == i]) for i in range(4)]
        least = jaccard.least_shared(doc, hashed, size, 90)
        groups = [min([node[j] for k in signs[i] for j in range(4) if k in signs[j] and sum(k in s for s in signs) > 1], default=None) for i in range(4)]
        if groups == [node[0], node[0], node[1], node[1]] and all(len(signs[i] & (signs[0] | signs[1])) < least[i] for i in (2, 3)):
            out += texts
            if len(out) == 4 * wanted:
                return out
    return out


def test_chunks_meet_when_the_pivot_is_in_another_group(spark):
    texts = families_with_a_foreign_pivot(8)
    assert len(texts) == 32
    rows = make(texts)
    want, _ = brute_components([(r[0], r[1]) for r in rows])
    assert all(want[i + 3] == i + 2 and want[i + 2] == i + 2 for i in range(0, 32, 4))
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, DOCS), 90, 1, 3).collect()} == want


# Suffix-array deduplication


def test_suffix_order_equals_sorting(monkeypatch):
    g = np.random.default_rng(1)
    for k in range(150):
        monkeypatch.setattr(induced, "MANY", int(g.choice([1, 4096])))
        t = g.integers(1, g.integers(2, 6), g.integers(1, 80))
        t = np.r_[np.tile(t, 1 + k % 3), 0].astype(np.uint16)
        got = induced.suffix_order(t, limit=int(g.integers(1, 50)))
        assert got.tolist() == sorted(range(len(t)), key=lambda i: tuple(t[i:].tolist()))


@pytest.mark.parametrize(("length", "gram"), [(400, 32), (40, 8)])
def test_repeats_equal_brute_force(docs, none, length, gram):
    texts = [(t or "").encode() for t in [*TEXTS, TEXTS[8]]]
    count = Counter(b[k : k + length] for b in texts for k in range(len(b) - length + 1))
    want = Counter()
    for b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        want[len(b), sum(gone), spans, bytes(x for x, y in zip(b, gone, strict=True) if not y)] += 1
    found = suffix_dedup.remove_repeats(docs, length, gram, shard_bytes=2000)
    assert Counter((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found.collect()) == want
    assert any(k[1] for k in want)
    assert suffix_dedup.remove_repeats(none).count() == 0
    back = suffix_dedup.without_repeats(docs, length, gram, shard_bytes=2000)
    assert back.columns == docs.columns and Counter(tuple(r)[2:3] + tuple(r)[5:] for r in back.collect()) == Counter(tuple(r)[2:3] + tuple(r)[5:] for r in docs.collect())
    assert Counter(r.text or "" for r in back.collect()) == Counter(k[3].decode(errors="ignore") for k in want.elements())


# Quality classifier


def test_quality_learns_and_scores_everything(spark, docs, none):
    good = [sentence(rng.randint(30, 200)) + "." for _ in range(150)]
    bad = [" | ".join(sentence(rng.randint(20, 60)).split()) + " $$$ %%%" for _ in range(150)]
    df = spark.createDataFrame(make(good + bad + [None, "", "?"]), DOCS)
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(5, None, 0), (None, 1, 1), (7, 3, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(df, labels).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == int(r.doc_id < 150) for r in held) >= 0.95 * len(held)
    alone = quality.classify(docs, labels.where("quality = 1")).collect()  # one class only
    assert len(alone) == docs.count() and {r.score for r in alone} == {1.0}
    assert quality.classify(none, labels).count() == 0


# URL filter


def test_urls_follow_rules_then_reputation(spark):
    urls = {
        1: "http://a.example.net/en/1", 2: "http://a.example.net/de/1", 3: "HTTP://B.Example.COM/de/x?y#z", 4: "https://example.org/fr/", 5: None, 6: "no scheme", 7: "ftp://bad.test/x", 8: "ftp://bad.test/y?q",
        9: "http://net", 10: "http://internet/", 11: "http://u@c.bad.test:80/p#f", 12: "http://good.test", 13: "://", 14: "a://b://c/net/", 15: "http://x.net?p",
    }
    pages = spark.createDataFrame([(k, u, "h", "clash") for k, u in urls.items()], "page_id long, url string, html string, host string")
    seen = spark.createDataFrame([("ftp://bad.test/z", 0)] * 40 + [("http://good.test/", 1)] * 40 + [("http://good.test/", None)], "url string, good int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, seen).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2] == ("a.example.net", "/de/1", "net/", "block")
    assert got[3] == ("b.example.com", "/de/x", "example.com/de/", "block") and got[4] == ("example.org", "/fr/", "org/fr/", "allow")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[13] == ("", "", None, "allow")
    assert got[7] == ("bad.test", "/x", None, "block") and got[8][1:] == ("/y", None, "block") and got[11] == ("u@c.bad.test:80", "/p", None, "block")
    assert got[9] == ("net", "", None, "allow") and got[10][2] is None and got[12][3] == "allow" and got[14][:2] == ("b:", "//c/net/") and got[15] == ("x.net", "", None, "allow")
    assert {r.verdict for r in url_filter.filter_urls(pages.where("page_id > 5 and page_id < 8"), seen.limit(0)).collect()} == {"allow"}
    assert url_filter.filter_urls(pages.limit(0), seen).count() == 0


# Byte-level BPE


@pytest.fixture(scope="module")
def own_encoding():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 1024), (60, 25), (40, 9)])
def test_ids_do_not_depend_on_cuts(docs, none, own_encoding, chunk, overlap):
    extra = ["<|endoftext|> it's\n\n  x   " * 30, "a" * 500, " " * 300 + "b", "don't stop\r\n\t" * 40]
    df = docs.sparkSession.createDataFrame(make([*TEXTS, *extra]), DOCS).drop("ids")
    got = byte_bpe.round_trip(df, chunk=chunk, overlap=overlap)
    assert got.columns == [*df.columns, "ids", "decoded"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 4
    for r in rows:
        text = r.text or ""
        assert r.ids == own_encoding.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert [bytes(r.decoded).decode() for r in byte_bpe.decode(byte_bpe.encode(df.where("doc_id = 8"))).collect()] == [TEXTS[8]]
    assert byte_bpe.digests(none).count() == 0
    assert {r.ids_sha256 for r in byte_bpe.digests(docs.where("doc_id < 2")).collect()} == {hashlib.sha256(b"").hexdigest()}


# LM scoring


def test_lm_counts_equal_brute_force_and_scores_are_better(docs, none):
    fold = F.pmod(F.col("n"), F.lit(10))
    df = docs.withColumn("n", F.coalesce("doc_id", F.lit(3)))
    got = lm_scoring.score_texts(df, F.when(fold == 0, 0).when(fold == 1, 1).otherwise(2), parts=5).collect()
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    ids = [*range(len(TEXTS)), 8]
    ids[len(TEXTS) - 3] = None
    rows = [(i, token(TEXTS[8] if n == len(TEXTS) else TEXTS[n])) for n, i in enumerate(ids)]
    c = Counter(w for i, t in rows if (3 if i is None else i) % 10 for w in t)
    n, v = sum(c.values()), len(c)
    base = lambda t: sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
    want = Counter((i, (3 if i is None else i) % 10 == 0, len(t), sum(c[w] > 0 for w in t), n, round(base(t), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got) and sum(r.score for r in got) > sum(r.base_score for r in got)
    assert lm_scoring.score_texts(none, F.lit(2), parts=2).count() == 0
    untrained = lm_scoring.score_texts(df, F.lit(0), parts=3).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in untrained)


def test_probabilities_sum_to_one_over_seen_and_unseen_words(spark):
    train = ["a b a b c", "a c a b", "b a a"]
    df = spark.createDataFrame(make([*train, "a", "b", "c", "", "zzz"]), DOCS)
    kind = F.when(F.col("doc_id") < 2, 2).when(F.col("doc_id") == 2, 1).otherwise(0)
    got = {r.doc_id: r for r in lm_scoring.score_texts(df, kind, parts=3).collect()}
    assert got[0].train_tokens == 15 and got[7].n_known == 1 and got[6].score < 0
    assert got[3].score > got[7].score


# Sharding


def test_shards_are_even_and_keep_the_mixture(docs, none, spark):
    got = sharding.interleaved_shards(docs, n_shards=7, buckets=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and all(sorted(s) == list(range(len(s))) for s in by.values())
    text = dict(enumerate(TEXTS))
    assert all(r.size == len((text[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) for r in got if r.doc_id is not None)
    mixed = spark.createDataFrame([(i, "t", "en", "hot" if i % 3 else f"s{i % 4}", 1) for i in range(2400)], "doc_id long, text string, lang string, source string, n_chars long")
    share = Counter((r.shard, r.source) for r in sharding.interleaved_shards(mixed).collect())
    # Below a cut a source has its share of the ranks to half a row, and a cut is off by half a row a source at most.
    for source, n in Counter(r.source for r in sharding.interleaved_shards(mixed).collect()).items():
        assert all(abs(share[s, source] - n / 24) <= 1 + 5 * n / 2400 for s in range(24))
    assert sharding.interleaved_shards(none).count() == 0


# License scan


def brute_align(a, b):
    """Longest common subsequence, an upper bound of any alignment."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def test_patience_alignment_is_increasing_and_finds_unique_words():
    for _ in range(200):
        a, b = [[rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2)]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[k] for i, k in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= brute_align(a, b)
    assert len(licenses.align(list("xaybzc"), list("abc"))) == 3


def test_licenses_are_found_whole_or_edited(docs, none, spark):
    mit = licenses.TEMPLATES["MIT-text"].split()
    texts = ["x Released under the MIT License. y", "licensed UNDER cc by-nc 4.0", " ".join(mit[:20] + ["odd"] + mit[21:]), "License of nothing", None, "", "released " + sentence(50) + " under the mit license"]
    got = {r.doc_id: [x.name for x in r.licenses] for r in licenses.find_licenses(spark.createDataFrame(make(texts), DOCS)).collect()}
    assert got == {0: ["MIT"], 1: ["CC-BY-NC-4.0"], 2: ["MIT-text"], 3: [], 4: [], 5: [], 6: []}
    assert licenses.find_licenses(docs).count() == docs.count() and licenses.find_licenses(none).count() == 0


def test_every_covered_text_holds_a_needed_word():
    for t in licenses.TEMPLATES.values():
        words = licenses.words_of(t)
        need = licenses.needed_words(words, licenses.COVERAGE)
        assert sum(w not in need for w in words) < licenses.COVERAGE * len(words)


def test_licenses_stand_twice_cut_up_and_side_by_side(spark):
    prose = "the use of software in the language is a matter of taste and you may think of it "
    mit, apache = licenses.TEMPLATES["MIT-text"], licenses.TEMPLATES["Apache-2.0-notice"]
    words = mit.split()
    texts = {
        prose + mit + " " + prose + mit + " " + prose: ["MIT-text", "MIT-text"],
        prose + " ".join([*words[:25], *["zork"] * 12, *words[25:]]) + " " + prose: ["MIT-text"],
        apache + " " + apache + " " + apache: ["Apache-2.0-notice"] * 3,
        prose + licenses.TEMPLATES["MIT-full"].upper() + " " + prose: ["MIT-full"],
        licenses.TEMPLATES["BSD-3-Clause-full"] + prose + licenses.TEMPLATES["ISC-full"]: ["BSD-3-Clause-full", "ISC-full"],
        " ".join(words[: len(words) // 2]): [],
        "Released under the MIT License. " * 4: ["MIT"] * 4,
        prose * 5000 + mit + prose * 5000: ["MIT-text"],
    }
    df = spark.createDataFrame(make([*texts, next(iter(texts))]), DOCS)
    got = {r.doc_id: r.licenses for r in licenses.find_licenses(df).collect()}
    for n, (text, want) in enumerate(texts.items()):
        assert sorted(x.name for x in got[n]) == want
        for x in got[n]:
            found, own = licenses.words_of(text[x.begin : x.end]), licenses.words_of(licenses.TEMPLATES[x.name])
            assert round(x.coverage * len(own)) <= brute_align(found, own) and x.coverage >= licenses.COVERAGE
    assert got[len(texts)] == got[0]


def test_licenses_stand_in_pieces_however_far_apart(spark):
    """Copies cut into pieces, with foreign text of up to 30,000 words between them and words missing, against the words that are there."""
    own = {name: licenses.words_of(t) for name, t in licenses.TEMPLATES.items()}
    foreign = lambda n: [f"q{rng.randint(0, 400)}" for _ in range(n)]
    texts, want = [], []
    for name in ("MIT-full", "BSD-3-Clause-full", "ISC-full", "Unlicense-full", "MIT-text", "GPL-3.0-notice") * 4:
        n = len(own[name])
        edge = max(licenses.PIECE + 5, n // 6 + 1)  # without a piece at an end, the rest isn't covered
        may = range(edge, n - edge + 1, licenses.PIECE + 5)
        cuts = sorted(rng.sample(may, rng.randint(1, min(3, len(may)))))
        lost = set(rng.sample(range(n), n // 20))
        words = foreign(rng.randint(0, 50))
        for begin, end in zip([0, *cuts], [*cuts, n], strict=True):
            words += [own[name][k] for k in range(begin, end) if k not in lost] + foreign(rng.choice([300, 3000, 30_000]))
        texts.append(" ".join(words))
        want.append([(name, n - len(lost), n)])
    mit = own["MIT-text"]
    texts += [
        " ".join([*mit[:24], *mit, *mit[24:]]),  # a copy within another
        " ".join(w for k in range(0, len(mit), 5) for w in [*mit[k : k + 5], *foreign(20)]),  # crumbs
        " ".join([*own["MIT-full"][:90], *foreign(300), *own["ISC-full"], *foreign(300), *own["MIT-full"][90:]]),
        "released " + " ".join(foreign(9)) + " under the " + " ".join(foreign(9)) + " mit license",
    ]
    want += [[("MIT-text", len(mit), len(mit))] * 2, [], [(t, len(own[t]), len(own[t])) for t in ("ISC-full", "MIT-full")], []]
    df = spark.createDataFrame(make([*texts, texts[0]]), DOCS)
    got = {r.doc_id: r.licenses for r in licenses.find_licenses(df).collect()}
    for n, places in enumerate(want):
        assert sorted(x.name for x in got[n]) == [p[0] for p in places]
        for x, (_, there, of) in zip(sorted(got[n], key=lambda x: x.name), places, strict=True):
            assert there / of - 0.03 <= x.coverage <= there / of + 1e-9
    assert got[len(texts)] == got[0]
    same = {"B": licenses.TEMPLATES["MIT-text"], "A": licenses.TEMPLATES["MIT-text"]}  # a tie: the smaller name stays
    assert [[x.name for x in r.licenses] for r in licenses.find_licenses(df.where(f"doc_id = {len(texts) - 4}"), same).collect()] == [["A", "A"]]


def test_very_long_texts(spark):
    """One text of more than half a megabyte among short ones, and a copy of it with a word less."""
    g = np.random.default_rng(6)
    words = [f"w{n}" for n in g.integers(0, 40_000, 100_000)]
    long = " ".join(words)
    df = spark.createDataFrame(make([long, " ".join(words[:-1]), "short", None, "x" * 200_000, "Released under the MIT License."]), DOCS)
    near = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df).collect()}
    assert near[0][1] == near[1][1] == 0 and near[2] == (1, 2) and near[0][0] >= 99_000
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(df).collect()}
    assert cut[0] == (len(long), len(long) - len(words[-1]) - 1) or cut[0][1] >= len(long) - 10
    assert cut[2] == (5, 0) and cut[4] == (200_000, 200_000)
    coded = byte_bpe.round_trip(df.where("doc_id <> 1")).select("doc_id", "text", "decoded").collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded)
    lm = {r.doc_id: r.n_tokens for r in lm_scoring.score_texts(df, F.when(F.col("doc_id") == 1, 1).otherwise(2)).collect()}
    assert lm == {0: 100_001, 1: 100_000, 2: 2, 3: 1, 4: 2, 5: 6}
    found = {r.doc_id: [x.name for x in r.licenses] for r in licenses.find_licenses(df).collect()}
    assert found == {0: [], 1: [], 2: [], 3: [], 4: [], 5: ["MIT"]}
    bench = spark.createDataFrame([(1, " ".join(words[1000:1010]))], "item_id long, text string")
    hit = {r.doc_id: (r.n_words, r.n_hit) for r in decontamination.decontaminate(df, bench).collect()}
    assert hit[0] == (100_000, 10) and hit[1] == (99_999, 10) and hit[2] == (1, 0)
    assert {r.doc_id for r in quality.vectors(df).collect()} == set(range(6))
    assert {r.doc_id: r.size for r in sharding.interleaved_shards(df).collect()}[0] == len(long) + 8


def test_rows_without_ids_spread_over_shards(spark):
    df = spark.createDataFrame([(None, f"t{n}", "en", "s", 1) for n in range(240)], "doc_id long, text string, lang string, source string, n_chars long")
    assert Counter(r.shard for r in sharding.interleaved_shards(df).collect()) == {s: 10 for s in range(24)}


def test_heavy_names_are_counted_like_sorted_ones(spark):
    """A passage shorter than the length in many surroundings, some of which repeat."""
    own = random.Random(5)
    noise = lambda n: "".join(own.choice("abcdefghij ") for _ in range(n))
    middle, pairs = noise(60), [noise(80) for _ in range(12)]
    texts = [noise(70) + pairs[n % 12][:40] + middle + pairs[n % 12][40:] + noise(70) for n in range(60)]
    df = spark.createDataFrame(make(texts), DOCS)
    few = {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 100, 16, shard_bytes=500).collect()}
    assert few == {r.doc_id: (r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, 100, 16, shard_bytes=1 << 30).collect()}
    assert all(v[0] >= 140 for v in few.values())
