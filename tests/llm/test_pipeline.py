"""The corpus pipeline, stage by stage, against brute force, and on odd rows."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from tidewatch.llm import byte_bpe, quality

CLASH = "doc_id long, text string, lang string, source string, n_chars long, score string, n_bytes string, n_removed string, n_spans string, kept string, node string, ids string, component_id string, decoded string"


def odd_docs(spark):
    words = [f"w{i}" for i in range(80)]
    texts = [
        None, "", "a b", " ".join(words), " ".join([*words[:40], "odd", *words[41:]]), " ".join(words).upper(), " ".join(f"v{i}" for i in range(60)), "x " * 3000 + "ü" * 150_000,
        "first " + " ".join(f"p{i}" for i in range(70)) + " end", "second " + " ".join(f"p{i}" for i in range(70)) + " stop " + " ".join(f"q{i}" for i in range(90)),
    ]
    rows = [(i, t, "en", "s", 7, *(f"{c}{i}" for c in "abcdefghi")) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[3], *rows[3][2:])]
    return spark.createDataFrame(rows, CLASH), texts


def carried(df):
    return Counter((r.doc_id, r.lang, *tuple(r)[5:]) for r in df.collect())


def test_stages_keep_odd_rows_and_clashing_columns(spark, data):
    docs, texts = odd_docs(spark)
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, data)
        assert got.columns == docs.columns, name
        assert carried(got) <= carried(docs), name
        assert stage(spark, docs.limit(0), data).count() == 0, name
    near = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, data)
    assert {r.doc_id for r in near.collect()} == ids - {4, 5} and near.count() == docs.count() - 2
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs.where("doc_id > 5"), data).collect()}
    assert cut[6].text == texts[6] and cut[6].n_chars == 7
    assert cut[8].text.startswith("first") and cut[8].text.endswith("end") and len(cut[8].text) < 40 and cut[8].n_chars == len(cut[8].text)
    assert len(cut[7].text) < 500
    clean = corpus_pipeline.drop_contaminated(spark, docs, data)
    assert clean.count() == docs.count()
    last = corpus_pipeline.encode(spark, docs, data)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == docs.count()


def brute_near(rows):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    of = {}
    for i, s in sets.items():
        for x in s:
            of.setdefault(x, []).append(i)
    both = Counter((a, b) for own in of.values() for n, a in enumerate(own) for b in own[n + 1 :])
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), n in both.items():
        if 100 * n >= 80 * len(sets[a] | sets[b]):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {i for i in sets if top(i) == i}


@pytest.fixture(scope="module")
def stages(spark, data):
    """What each stage got and what it gave."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, data).checkpoint()
        out.append((docs.collect(), found.collect()))
        docs = found
    return out


def test_every_stage_equals_brute_force(spark, data, stages):
    (before, good), (_, single), (_, cut), (_, clean), (_, coded) = stages
    labels = spark.read.parquet(f"{data}/labels.parquet")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    score = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert {r.doc_id for r in good} == {r.doc_id for r in before if score[r.doc_id] >= 0.7}
    assert {r.doc_id for r in single} == brute_near(good)

    width = corpus_pipeline.PASSAGE_BYTES
    raw = {r.doc_id: (r.text or "").encode() for r in single}
    count = Counter(b[k : k + width] for b in raw.values() for k in range(len(b) - width + 1))
    for r in cut:
        b = raw[r.doc_id]
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if count[b[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        assert (r.text or "") == kept.decode(errors="ignore") and (not any(gone) or r.n_chars == len(r.text))
    assert len(cut) == len(single)

    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    wins = set()
    for (t,) in spark.read.parquet(f"{data}/benchmark.parquet").select("text").collect():
        w = split(t)
        wins |= {tuple(w[k : k + min(10, len(w))]) for k in range(max(0, len(w) - 10) + 1)} if w else set()
    sizes = {len(x) for x in wins}
    dirty = {r.doc_id for r in cut for w in [split(r.text)] for n in sizes for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in wins}
    assert {r.doc_id for r in clean} == {r.doc_id for r in cut} - dirty

    enc = byte_bpe.Encoder(byte_bpe.VOCABULARY)
    text = {r.doc_id: r.text or "" for r in clean}
    assert len(coded) == len(clean)
    for r in coded:
        ids = list(enc.encode(text[r.doc_id]))
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()


def test_run_chains_the_stages(spark, data, stages):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, data).collect()}
    assert got == {r.doc_id: r.ids_sha256 for r in stages[-1][1]}
