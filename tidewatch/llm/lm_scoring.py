"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

P(w | h) = b2 c(h, w) / c(h) + b1 c(w) / N + b0 / (V + 1), where the weights b depend on the bucket of
the context's frequency c(h). They are learned by expectation-maximisation on held-out counts: one
fold of the training texts is held out, the estimates come from the others, and the weights are
those under which the held-out bigrams are likeliest. Scores then use the counts of all training
texts. A text's first word and its end have the end token for context and token, so c(h) is the
unigram count of h for every h.

Nothing is broadcast but the weights, whose number is fixed, and the keys of hot words and bigrams,
a few for each part. The counts live in the shuffle: tokens are hashed to 64 bits and packed per
task into arrays, dealt out by their word, those of hot words also by their context, and those of
hot bigrams by their text, so that no key fills a part. A part holds all occurrences of its other
bigrams. It gives the counts of its words and hot bigrams as rows, which are added up by key and
joined back; from the totals come first the held-out histogram for the weights, in bins whose
number is fixed, then the sums per text. numpy works on arrays inside the tasks; Spark partitions,
shuffles and adds up.

Words count as equal if their 64-bit hashes are.

Defined cases: null and empty texts are one end token; rows that repeat id and text count as so
many texts and get the same score; null ids are folded as the empty id; an empty table gives an
empty result; without training texts every token has probability 1 / (V + 1) = 1; without
held-out counts in a bucket its weights are equal shares of the estimates that exist; extra
columns don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import id_fold, small_batches, tidy, tidy_group
from tidewatch.llm.hashing import END, mix, token_hashes
from tidewatch.session import table

#: Tokens that a task packs at a time, bytes of text in a part, and tokens that are scored at a time.
PACK, PART_BYTES, SLICE = 2_000_000, 20_000_000, 500_000
#: Context frequencies from 0, 1, 2, 4, ... on; the last bucket is open.
BUCKETS = 16
#: Bins per power of ten of the held-out histogram.
FINE = 10
EM_ROUNDS = 50
#: A word or bigram is hot if its share of the tokens is over one in so many times the parts.
HOT = 4

_U, _STEP = np.uint64, np.uint64(0x9E3779B97F4A7C15)
def _contexts(w: np.ndarray) -> np.ndarray:
    return np.r_[END, w[:-1]]  # the token before a text's first is the END of the text before, or this one


def _pair(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A key of the bigram, which isn't a word's."""
    with np.errstate(over="ignore"):
        return mix(w ^ mix(h * _STEP + _U(1)))


def _part(h: np.ndarray, w: np.ndarray, key: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """key: of the token's text."""
    with np.errstate(over="ignore"):
        by = mix(w ^ np.where(np.isin(w, hot), h * _STEP, _U(0)))
        return (np.where(np.isin(_pair(h, w), hot), mix(key.astype(np.uint64)), by) % _U(parts)).astype(np.int32)


def _small(x: np.ndarray) -> bytes:
    """Non-negative numbers in as few bytes as the largest needs, deflated, after one that says how many."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if not len(x) or int(x.max()) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(x.astype(kind).tobytes(), 1)


def _large(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}")


PACKED = "part int, key binary, kind binary, context binary, context_at binary, word binary, word_n binary, doc_at binary"


def _pack(hot: np.ndarray, parts: int):
    """Rows of (key, kind, text) to blobs of tokens for each part."""

    def blobs(keys: np.ndarray, kinds: np.ndarray, w: np.ndarray, d: np.ndarray) -> Iterator[pa.RecordBatch]:
        h = _contexts(w)
        part = _part(h, w, keys[d], hot, parts)
        order = np.lexsort((h, w, part))
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        for p in range(parts):
            own = order[cut[p] : cut[p + 1]]
            if not len(own):
                continue
            context, context_at = np.unique(h[own], return_inverse=True)
            word, word_n = np.unique(w[own], return_counts=True)
            docs, doc_at = np.unique(d[own], return_inverse=True)
            row = [keys[docs].tobytes(), kinds[docs].tobytes(), context.tobytes(), _small(context_at), word.tobytes(), _small(word_n), _small(doc_at)]
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *(pa.array([x], pa.binary()) for x in row)], [f.split()[0] for f in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = docs = 0
        for batch in batches:
            w, d = token_hashes(batch.column("text").to_pylist())
            held.append((batch.column("key").to_numpy(), batch.column("kind").to_numpy().astype(np.uint8), w, d + docs))
            count, docs = count + len(w), docs + batch.num_rows
            if count >= PACK:
                yield from blobs(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held, count, docs = [], 0, 0
        if held:
            yield from blobs(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


class Part:
    """All tokens of a part: context h, word w, text (key and kind)."""

    def __init__(self, blobs: pd.DataFrame, hot: np.ndarray):
        # Tokens are numbers of words from the start; their hashes are looked at a blob at a time.
        each = [(np.frombuffer(b.context, np.uint64), np.frombuffer(b.word, np.uint64)) for b in blobs.itertuples(index=False)]
        self.words = np.unique(np.concatenate([x for both in each for x in both]))
        keys, kinds, hs, ws, ds, hot_at, hot_pairs, base, size = [], [], [], [], [], [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0, 0
        for b, (context, word) in zip(blobs.itertuples(index=False), each, strict=True):
            key = np.frombuffer(b.key, np.int64)
            keys.append(key)
            kinds.append(np.frombuffer(b.kind, np.uint8))
            hs.append(np.searchsorted(self.words, context).astype(np.int32)[_large(b.context_at)])
            ws.append(np.repeat(np.searchsorted(self.words, word).astype(np.int32), _large(b.word_n)))
            ds.append(_large(b.doc_at).astype(np.int32) + base)
            pair = _pair(self.words[hs[-1]], self.words[ws[-1]])
            own = np.flatnonzero(np.isin(pair, hot))
            hot_at.append(own + size)
            hot_pairs.append(pair[own])
            base, size = base + len(key), size + len(pair)
        self.key, kind = np.concatenate(keys), np.concatenate(kinds)
        self.h, self.w, self.d = np.concatenate(hs), np.concatenate(ws), np.concatenate(ds)
        self.kind = kind[self.d]
        self.hot = np.concatenate(hot_at)
        self.pairs, self.pair_at = np.unique(np.concatenate(hot_pairs), return_inverse=True)

    def asked(self) -> pd.DataFrame:
        """Words, and then hot bigrams, with their training and retained counts in this part."""
        both = [np.r_[np.bincount(self.w, weights=self.kind >= k, minlength=len(self.words)), np.bincount(self.pair_at, weights=self.kind[self.hot] >= k, minlength=len(self.pairs))] for k in (1, 2)]
        word = np.r_[self.words, self.pairs].astype(np.int64)
        return pd.DataFrame({"word": word, "is_pair": np.arange(len(word)) >= len(self.words), "train": both[0].astype(np.int64), "kept": both[1].astype(np.int64)})

    def pair_counts(self, least: int, of_hot: np.ndarray) -> np.ndarray:
        """For each token how often its bigram stands in texts of at least this kind; of_hot: totals of self.pairs."""
        pair = self.h.astype(np.int64) * len(self.words) + self.w
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        n = np.cumsum(np.r_[False, pair[1:] != pair[:-1]], dtype=np.int32)
        del pair
        per = np.bincount(n, weights=self.kind[order] >= least).astype(np.float32 if len(n) < 1 << 24 else np.float64)
        back = np.empty(len(n), per.dtype)
        back[order] = per[n]
        if len(self.hot):
            back = back.astype(np.float64)
            back[self.hot] = of_hot[self.pair_at]
        return back

    def totals(self, answers: pd.DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
        """Totals of self.words and of self.pairs."""
        of_pair = answers["is_pair"].to_numpy(bool)
        out = []
        for keys, own in ((self.words, ~of_pair), (self.pairs, of_pair)):
            known, n = answers["word"].to_numpy(np.int64)[own].astype(np.uint64), answers[column].to_numpy(np.float64)[own]
            order = np.argsort(known)
            out.append(n[order][np.searchsorted(known[order], keys)] if len(keys) else np.empty(0))
        return out[0], out[1]


def _ask(hot: np.ndarray):
    def run(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        found = Part(blobs, hot).asked()
        found.insert(0, "part", np.int32(key[0]))
        return found

    return run


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(n + 1)), BUCKETS - 1).astype(np.int64)


def _histogram(hot: np.ndarray):
    """Held-out tokens by the context's bucket and by bins of both estimates, with sums of their logarithms."""

    def run(blobs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        p = Part(blobs, hot)
        kept, of_hot = p.totals(answers, "all_kept")
        pair = p.pair_counts(2, of_hot)
        own = p.kind == 1
        h, w, hw = kept[p.h[own]], kept[p.w[own]], pair[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            log2 = np.where(hw > 0, np.log10(hw / np.maximum(h, 1)), 99.0)
            log1 = np.where(w > 0, np.log10(w), -99.0)
        frame = pd.DataFrame({"bucket": _bucket(h), "bin2": np.floor(log2 * FINE).astype(np.int64), "bin1": np.floor(log1 * FINE).astype(np.int64), "n": 1, "sum2": log2, "sum1": log1})
        return frame.groupby(["bucket", "bin2", "bin1"], as_index=False).sum()

    return run


def _weights(frame: pd.DataFrame) -> pd.DataFrame:
    """EM over the histogram, whose number of bins is fixed."""
    n_kept, n_words = float(frame["n_kept"].iloc[0]), float(frame["n_words"].iloc[0])
    weights = np.zeros((BUCKETS, 3))
    for b in range(BUCKETS):
        own = frame[frame["bucket"] == b]
        n = own["n"].to_numpy(float)
        mean2, mean1 = own["sum2"] / own["n"], own["sum1"] / own["n"]
        p = np.stack([
            np.where(mean2 > 50, 0.0, 10.0 ** np.minimum(mean2, 0)),
            np.where(mean1 < -50, 0.0, 10.0 ** np.maximum(mean1, -50) / max(n_kept, 1)),
            np.full(len(own), 1 / (n_words + 1)),
        ], axis=1)
        has = np.array([b > 0, n_kept > 0, True])
        x = has / has.sum()
        for _ in range(EM_ROUNDS if n.sum() else 0):
            share = p * x
            share /= share.sum(axis=1, keepdims=True)
            x = (n[:, None] * share).sum(axis=0) / n.sum()
        if has[1] and n.sum():  # every estimate that exists keeps a share, so nothing has probability 0
            x = np.maximum(x, 1e-6 * has)
            x /= x.sum()
        weights[b] = x
    return pd.DataFrame({"weights": [weights.tobytes()], "total": frame["total"].iloc[:1].to_numpy(), "vocabulary": frame["n_words"].iloc[:1].to_numpy()})


def _sums(hot: np.ndarray, homes: int):
    def run(blobs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        p = Part(blobs, hot)
        train, of_hot = p.totals(answers, "all_train")
        pair = p.pair_counts(1, of_hot)
        n, v = float(blobs["total"].iloc[0]), float(blobs["vocabulary"].iloc[0])
        weights = np.frombuffer(blobs["weights"].iloc[0]).reshape(BUCKETS, 3)
        key, at = np.unique(p.key, return_inverse=True)
        sums = [np.zeros(len(key)) for _ in SUMMED]
        for begin in range(0, len(p.d), SLICE):
            own = slice(begin, begin + SLICE)
            h, w, text = train[p.h[own]], train[p.w[own]], at[p.d[own]]
            by = weights[_bucket(h)]
            prob = by[:, 0] * pair[own] / np.maximum(h, 1) + by[:, 1] * w / max(n, 1) + by[:, 2] / (v + 1)
            base = np.log10((w + 0.1) / (n + 0.1 * (v + 1)))
            for total, x in zip(sums, (np.ones(len(h)), w > 0, base, np.log10(prob)), strict=True):
                total += np.bincount(text, weights=x, minlength=len(key))
        home = (mix(key.astype(np.uint64)) % _U(homes)).astype(np.int32)
        rows = [(int(t), key[o].tobytes(), _small(sums[0][o].astype(np.int64)), _small(sums[1][o].astype(np.int64)), sums[2][o].tobytes(), sums[3][o].tobytes()) for t in np.unique(home) for o in [home == t]]
        return pd.DataFrame(rows, columns=["home", "keys", *SUMMED])

    return run


SUMMED = ["n_tokens", "n_known", "base_score", "score"]


def _add_up(key: tuple, packed: pd.DataFrame) -> pd.DataFrame:
    """A row per text from the sums that the parts sent to the text's home."""
    keys, at = np.unique(np.concatenate([np.frombuffer(k, np.int64) for k in packed["keys"]]), return_inverse=True)
    of = {c: np.concatenate([_large(x) if c.startswith("n_") else np.frombuffer(x) for x in packed[c]]) for c in SUMMED}
    total = {c: np.bincount(at, weights=v, minlength=len(keys)) for c, v in of.items()}
    return pd.DataFrame({"key": keys, **{c: v.astype(np.int64) if c.startswith("n_") else v for c, v in total.items()}})


def hot_keys(texts: DataFrame, share: float) -> np.ndarray:
    """Words, and bigrams of these, with at least ``share`` of a sample's tokens, 2 / share at most. They only decide how tokens are dealt out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, _ = token_hashes(batch.column("text").to_pylist())
            for keys in (w, _pair(_contexts(w), w)):
                key, n = np.unique(keys, return_counts=True)
                top = n >= share * len(w) / 4
                yield pa.RecordBatch.from_arrays([pa.array(key[top].astype(np.int64)), pa.array(n[top])], ["key", "n"])

    seen = texts.where(F.pmod(F.col("key"), F.lit(50)) == 0).select("text")
    # Tokens are counted as blanks, near enough for a share.
    tokens = seen.agg(F.sum(F.length("text") - F.length(F.translate("text", " ", ""))).alias("n")).first()["n"] or 0
    often = seen.mapInArrow(tidy(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= max(1, share * tokens)).orderBy(F.desc("n"), "key").limit(int(2 / share))
    return np.sort(np.array([r["key"] for r in often.collect()], np.int64).astype(np.uint64))


def score_texts(docs: DataFrame, kind: F.Column, parts: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    kind: 2 for training texts that give counts, 1 for the fold held out for the weights, 0 for the rest.
    """
    rows = docs.select("doc_id", kind.cast("int").alias("kind"), F.xxhash64("doc_id", "text").alias("key"), "text")
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = max(12, -(-size // PART_BYTES))
    hot = hot_keys(rows, 1 / max(1000, HOT * parts))
    packed = rows.select("key", "kind", "text").mapInArrow(tidy(_pack(hot, parts)), PACKED)
    packed = packed.repartition("part")  # one exchange, for all three passes
    asked = packed.groupBy("part").applyInPandas(tidy_group(_ask(hot)), "part int, word long, is_pair boolean, train long, kept long")
    of_word = Window.partitionBy("word", "is_pair")
    answers = asked.select("part", "word", "is_pair", F.sum("train").over(of_word).alias("all_train"), F.sum("kept").over(of_word).alias("all_kept"), (F.row_number().over(of_word.orderBy("part")) == 1).alias("first"))
    own = F.col("first") & ~F.col("is_pair")
    number = lambda c: F.coalesce(F.sum(F.when(own, c)), F.lit(0))
    sums = answers.agg(number(F.col("all_train")).alias("total"), number(F.col("all_kept")).alias("n_kept"), number((F.col("all_train") > 0).cast("long")).alias("vocabulary"))
    dealt = answers.drop("first").repartition("part")  # one exchange, for the histogram and for the scores
    bins = (
        packed.groupBy("part").cogroup(dealt.groupBy("part"))
        .applyInPandas(tidy_group(_histogram(hot)), "bucket long, bin2 long, bin1 long, n long, sum2 double, sum1 double")
        .groupBy("bucket", "bin2", "bin1").agg(F.sum("n").alias("n"), F.sum("sum2").alias("sum2"), F.sum("sum1").alias("sum1"))
    )
    one = F.lit(1).alias("one")
    facts = sums.select(one, "total", "n_kept", F.col("vocabulary").alias("n_words"))
    # Without held-out tokens one empty bin stands for them, so the weights are there in any case.
    learned = (
        facts.join(bins.withColumn("one", F.lit(1)), "one", "left").na.fill(0)
        .groupBy("one").applyInPandas(tidy_group(_weights), "weights binary, total long, vocabulary long").withColumn("one", F.lit(1))
    )
    weighed = packed.withColumn("one", one).join(F.broadcast(learned), "one").drop("one")
    scored = weighed.groupBy("part").cogroup(dealt.groupBy("part")).applyInPandas(tidy_group(_sums(hot, max(12, parts // 8))), "home int, keys binary, n_tokens binary, n_known binary, base_score binary, score binary")
    by_key = scored.groupBy("home").applyInPandas(tidy_group(_add_up), "key long, n_tokens long, n_known long, base_score double, score double")
    copies = rows.groupBy("key", "doc_id", "kind").agg(F.count("*").alias("copies"))
    each = copies.withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).join(by_key, "key").withColumn("one", F.lit(1))
    return each.join(F.broadcast(learned.select("one", "total")), "one").select(
        "doc_id", (F.col("kind") == 0).alias("held_out"),
        F.expr("n_tokens div copies").alias("n_tokens"), F.expr("n_known div copies").alias("n_known"), F.col("total").alias("train_tokens"),
        (F.col("base_score") / F.col("copies")).alias("base_score"), (F.col("score") / F.col("copies")).alias("score"),
    )


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    fold = id_fold(F.col("doc_id"), 10)
    return score_texts(table(spark, sf_dir, "documents"), F.when(fold == 0, 0).when(fold == 1, 1).otherwise(2))
