"""Byte-level BPE encoding by overlapping chunks, and decoding.

Texts of up to ``chunk`` characters are one chunk. Longer ones are cut into chunks that overlap,
which are dealt out and pre-tokenised in parallel. No alternative of the pattern looks behind, so
two scans that share one pre-token start share all that follow: the first start that both a chunk
and its successor have in their overlap is where the two are stitched. Neighbours without a common
start (a run longer than the overlap) are put together again as one piece. Pieces are encoded in
parallel, and their ids are put together per document. A piece that was put together also tells
whether its own scan passes through its last stitch; where it doesn't (two scans may agree and yet
be out of step with the text's), the document is encoded as one piece. So ids never depend on
where the cuts fell.

A pre-token is encoded by merging the neighbours of the least rank until none has one, each distinct
one once in a while: a task keeps what it has encoded. Decoding concatenates the ids' raw bytes.

Vocabularies are read on the executors from a path; nothing of the corpus is broadcast.

Defined cases: null and empty texts have no ids and decode to no bytes; repeated rows give a row
each; other columns stay; an empty table gives an empty result. Text that looks like a special
token is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import small_batches, tidy
from tidewatch.session import ensure_checkpoint_dir, table

VOCABULARY = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 32_768, 1_024
#: Characters before a chunk's end within which a match might still change.
UNSURE = 8


#: Distinct pre-tokens that a task keeps in each of two generations, some 200 bytes each, and bytes of the longest; the rank of a pair that is no token.
KEPT, KEPT_BYTES, NEVER = 200_000, 64, 1 << 62


def merged(raw: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: of all neighbours the leftmost of least rank are merged, again and again."""
    if (whole := ranks.get(raw)) is not None:
        return (whole,)
    if len(raw) > KEPT_BYTES:
        return _merged_long(raw, ranks)
    cut, get = list(range(len(raw) + 1)), ranks.get
    pairs = [get(raw[at : at + 2], NEVER) for at in range(len(raw) - 1)]
    while pairs and (least := min(pairs)) != NEVER:
        at = pairs.index(least)
        del cut[at + 1], pairs[at]
        if at < len(pairs):
            pairs[at] = get(raw[cut[at] : cut[at + 2]], NEVER)
        if at:
            pairs[at - 1] = get(raw[cut[at - 1] : cut[at + 1]], NEVER)
    return tuple([ranks[raw[a:b]] for a, b in itertools.pairwise(cut)])


def _merged_long(raw: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same by a heap of pairs over a chain of parts, so that a pre-token of any length takes n log n steps."""
    end = list(range(1, len(raw) + 1))  # of the part that begins here
    before = list(range(-1, len(raw) - 1))
    pairs: list[tuple[int, int, int, int]] = []

    def offer(at: int) -> None:
        middle = end[at]
        if middle < len(raw) and (rank := ranks.get(raw[at : end[middle]])) is not None:
            heapq.heappush(pairs, (rank, at, middle, end[middle]))

    for at in range(len(raw) - 1):
        offer(at)
    while pairs:
        _, at, middle, stop = heapq.heappop(pairs)
        if end[at] != middle or end[middle] != stop:  # one of the two has been merged since
            continue
        end[at], end[middle] = stop, -1
        if stop < len(raw):
            before[stop] = at
        offer(at)
        if at:
            offer(before[at])
    out, at = [], 0
    while at < len(raw):
        out.append(ranks[raw[at : end[at]]])
        at = end[at]
    return tuple(out)


class Encoder(dict):
    """Pre-tokens and their ids (as the bytes of 32-bit numbers), those seen lately: when there are too many they become the old ones, and come back as they are met."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.words = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.words[rank] = token
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.old: dict[str, bytes] = {}

    def __missing__(self, pre_token: str) -> bytes:
        ids = self.old.get(pre_token)
        if ids is None:
            raw = pre_token.encode()
            ids = array("i", merged(raw, self.ranks)).tobytes()
            if len(raw) > KEPT_BYTES:
                return ids
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()
        self[pre_token] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.pattern.findall(text))), np.int32)

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


@lru_cache(maxsize=2)
def _encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def _ids(vocabulary: str, texts: Iterable[str | None]) -> pa.ListArray:
    """Ids of each text as an Arrow column."""
    enc = _encoder(vocabulary)
    each = [enc.encode(t or "") for t in texts]
    ends = np.cumsum([0, *map(len, each)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *each])))


def _bytes(vocabulary: str, ids: pa.ListArray) -> pa.Array:
    enc = _encoder(vocabulary)
    flat, ends = ids.flatten().to_numpy(), np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]
    return pa.array([enc.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def _encode_whole(vocabulary: str, decoded: bool):
    """Adds ids and, if asked, what they decode to, in one process."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(vocabulary, batch.column("text").to_pylist())
            more = {"ids": ids} | ({"decoded": _bytes(vocabulary, ids)} if decoded else {})
            yield pa.RecordBatch.from_arrays([*batch.columns, *more.values()], [*batch.schema.names, *more])

    return run


def _cut(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for n, at in enumerate(range(0, len(text), chunk)):
                    yield pa.RecordBatch.from_pydict({"row": [row], "n": [n], "last": [at + chunk >= len(text)], "chunk": [text[at : at + chunk + overlap]]}, CUT)

    return run


CUT = pa.schema([("row", pa.int64()), ("n", pa.int32()), ("last", pa.bool_()), ("chunk", pa.string())])


def _starts(vocabulary: str, chunk: int, overlap: int):
    """head: pre-token starts in the part shared with the chunk before; tail: in that shared with the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _encoder(vocabulary).pattern.finditer
        for batch in batches:
            heads, tails = [], []
            for n, text in zip(batch.column("n").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                head, tail, sure = [], [], len(text) - UNSURE
                for m in match(text):
                    at = m.start()
                    if at > sure:
                        break
                    if at < overlap:
                        head.append(n * chunk + at)
                    if at >= chunk:
                        tail.append(n * chunk + at)
                heads.append(head)
                tails.append(tail)
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, kind), pa.array(tails, kind)], [*batch.schema.names, "head", "tail"])

    return run


def _encode_pieces(vocabulary: str, chunk: int):
    """Ids of each piece, and whether a scan of all its chunks passes through its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = _encoder(vocabulary).pattern.finditer
        for batch in batches:
            texts, passes = [], []
            for parts, begin, end in zip(*(batch.column(c).to_pylist() for c in ("parts", "begin", "end")), strict=True):
                text = "".join(p["chunk"][:chunk] for p in parts[:-1]) + parts[-1]["chunk"]
                base = parts[0]["n"] * chunk
                passes.append(end is None or len(parts) == 1 or end - base in (m.start() for m in match(text, begin - base)))
                texts.append(text[begin - base : None if end is None else end - base])
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("begin"), _ids(vocabulary, texts), pa.array(passes)], ["row", "begin", "ids", "passes"])

    return run


def _decode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, _bytes(vocabulary, batch.column("ids"))], [*batch.schema.names, "decoded"])

    return run


def _with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])


IDS, DECODED = ("ids", T.ArrayType(T.IntegerType())), ("decoded", T.BinaryType())


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with a column ids: array<int>. An input column of that name is replaced."""
    short, long = _encoded(docs.drop("ids"), vocabulary, chunk, overlap, decoded=False)
    return short.unionByName(long)


def decode(df: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """df with a column decoded: the raw bytes of its column ids."""
    df = df.drop("decoded")
    return df.mapInArrow(tidy(_decode(vocabulary)), _with(df, DECODED))


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with ids and decoded; texts of one chunk go through both in one process."""
    short, long = _encoded(docs.drop("ids", "decoded"), vocabulary, chunk, overlap, decoded=True)
    return short.unionByName(decode(long, vocabulary))


def _encoded(docs: DataFrame, vocabulary: str, chunk: int, overlap: int, decoded: bool) -> tuple[DataFrame, DataFrame]:
    ensure_checkpoint_dir(docs.sparkSession)
    is_long = F.coalesce(F.char_length("text") > chunk, F.lit(False))
    short = docs.where(~is_long)
    short = short.mapInArrow(tidy(_encode_whole(vocabulary, decoded)), _with(short, IDS, *[DECODED] * decoded))

    # A row's number follows from the input's splits, so a lost task finds the same numbers again.
    rows = docs.where(is_long).withColumn("__tw_row", F.monotonically_increasing_id())
    chunks = (
        rows.select(F.col("__tw_row").alias("row"), "text")
        .mapInArrow(tidy(_cut(chunk, overlap)), "row long, n int, last boolean, chunk string")
        .repartition("row", "n")
    )
    marked = chunks.mapInArrow(tidy(_starts(vocabulary, chunk, overlap)), _with(chunks, ("head", T.ArrayType(T.LongType())), ("tail", T.ArrayType(T.LongType()))))
    in_row = Window.partitionBy("row").orderBy("n")
    stitched = (
        marked.withColumn("end", F.array_min(F.array_intersect("tail", F.lead("head").over(in_row))))
        .withColumn("begin", F.lag("end").over(in_row))
        .withColumn("piece", F.sum(F.col("begin").isNotNull().cast("int")).over(in_row))
        .select("row", "n", "last", "chunk", "begin", "end", "piece")
    )

    def encoded(cut: DataFrame) -> DataFrame:
        pieces = cut.groupBy("row", "piece").agg(
            F.sort_array(F.collect_list(F.struct("n", "chunk"))).alias("parts"), F.coalesce(F.min_by("begin", "n"), F.lit(0).cast("long")).alias("begin"), F.max_by("end", "n").alias("end")
        )
        return pieces.mapInArrow(tidy(_encode_pieces(vocabulary, chunk)), "row long, begin long, ids array<int>, passes boolean")

    first = encoded(stitched).checkpoint()
    astray = first.where("not passes").select("row").distinct()
    whole = stitched.join(astray, "row").select("row", "n", "last", "chunk", F.lit(None).cast("long").alias("begin"), F.lit(None).cast("long").alias("end"), F.lit(0).cast("long").alias("piece"))
    found = first.join(astray, "row", "left_anti").unionByName(encoded(whole)).groupBy("row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("begin", "ids"))), lambda p: p["ids"])).alias("ids"))
    long = rows.join(found.toDF("__tw_row", "__tw_ids"), "__tw_row").select(*docs.columns, F.col("__tw_ids").alias("ids"))
    return short, long


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row."""
    coded = round_trip(docs.select("doc_id", "text")).drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(table(spark, sf_dir, "documents"))
