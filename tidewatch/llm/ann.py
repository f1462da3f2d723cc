"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash is a pseudo-random rotation (three rounds of random signs and a fast Hadamard
transform) of the unit vector, followed by its nearest signed axis; ``axes`` such axes make a
bucket. Queries look into the buckets of their ``probes`` nearest axes in every table. A bucket's
candidates are ranked by their exact distance on the original vectors where the bucket is, so
only each query's k best of a bucket travel on, which loses none of the k best found.

Buckets of more than ``bucket_rows`` vectors are salted over several tasks, to all of which their
queries go; that bounds every task without a cap. All vectors are indexed; queries meet buckets in
a co-grouped shuffle, and nothing is broadcast. The number of axes doesn't depend on the rows: a second
axis makes buckets finer, and would need more tables or probes for the same recall.

Defined cases: ids or vectors that are null, vectors of zero length or with null or non-finite
components take no part; vectors meet those of their own dimension only; rows that repeat a
vec_id count once, at the smallest distance; ties go to the smaller vec_id; fewer candidates than
k give fewer rows; extra columns don't matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import table

TABLES, PROBES, K = 8, 16, 10


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each column."""
    d, n = x.shape
    half = 1
    while half < d:
        x = x.reshape(d // (2 * half), 2, half, n)
        x = np.stack([x[:, 0] + x[:, 1], x[:, 0] - x[:, 1]], axis=1).reshape(d, n)
        half *= 2
    return x


def signed_axes(x: np.ndarray, at: int, first: int, seed: int) -> np.ndarray:
    """For each row the numbers of its ``first`` nearest signed axes after rotation number ``at``, nearest first."""
    d = x.shape[1]
    wide = 1 << max(0, d - 1).bit_length()
    y = np.zeros((wide, len(x)), np.float32)
    y[:d] = x.T
    signs = np.random.default_rng([seed, at, wide]).choice(np.array([-1, 1], np.float32), (3, wide))
    for s in signs:
        y = _hadamard(y * s[:, None])
    # An axis of negative value is nearest at its negative end; both ends of it are never among the first.
    far = np.abs(y)
    order = far.argmax(axis=0)[None] if first == 1 else np.argsort(-far, axis=0, kind="stable")[: min(first, wide)]
    return (2 * order + (np.take_along_axis(y, order, 0) > 0)).T


def _buckets(first: int, tables: int, axes: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("embedding")
            ends = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
            flat, dims = lists.flatten().to_numpy(), np.diff(ends)
            for d in np.unique(dims):
                own = np.flatnonzero(dims == d)
                x = flat[ends[own][:, None] + np.arange(d)]
                raw = pa.array([v.tobytes() for v in x], pa.binary())
                unit = x.astype(np.float64)
                unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
                for t in range(tables):
                    near = [signed_axes(unit, t * axes + a, first, seed) for a in range(axes)]
                    for picks in itertools.product(*(range(n.shape[1]) for n in near)):
                        code = np.zeros(len(own), np.int64)
                        for n, p in zip(near, picks, strict=True):
                            code = code * 4 * d + n[:, p]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), d, np.int32)), pa.array(np.full(len(own), t, np.int32)), pa.array(code), pa.array(ids[own]), raw], ["dim", "tab", "code", "vec_id", "vector"])

    return run


BUCKET = ["dim", "tab", "code"]
SCHEMA = "dim int, tab int, code long, vec_id long, vector binary"


def _nearest(k: int, kind: str):
    """Each query's k nearest of a bucket: all distances by one product, then the exact ones of whatever rounding leaves in question."""
    none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    def run(index: pd.DataFrame, probes: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(probes):
            return none
        unpack = lambda rows: np.frombuffer(b"".join(rows["vector"]), kind).reshape(len(rows), -1).astype(np.float64)
        x, y = unpack(index), unpack(probes)
        ids, queries = index["vec_id"].to_numpy(), probes["vec_id"].to_numpy()
        x2, out, repeated = (x * x).sum(axis=1), [[], [], []], len(np.unique(ids)) < len(ids)
        for begin in range(0, len(y), 256):
            part = y[begin : begin + 256]
            y2 = (part * part).sum(axis=1)
            near = x2[None] - 2 * (part @ x.T) + y2[:, None]
            near[queries[begin : begin + 256, None] == ids[None]] = np.inf
            kth = np.partition(near, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
            for n, query in enumerate(queries[begin : begin + 256]):
                slack = 1e-9 * (x2.max() + y2[n])
                some = np.flatnonzero(near[n] <= (np.finfo(float).max if repeated else kth[n] + slack))
                some = some[np.isfinite(near[n][some])]
                score = np.sqrt(((x[some] - part[n]) ** 2).sum(axis=1))
                order = np.lexsort((ids[some], score))
                if repeated:  # a repeated id counts once
                    order = order[np.sort(np.unique(ids[some][order], return_index=True)[1])]
                order = order[:k]
                out[0].append(np.full(len(order), query))
                out[1].append(ids[some][order])
                out[2].append(score[order])
        return pd.DataFrame(dict(zip(none.columns, map(np.concatenate, out), strict=True)))

    return run


def usable(embedding: Column) -> Column:
    """Not null, not zero, and all components finite."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(embedding, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = K, tables: int = TABLES, probes: int = PROBES, axes: int = 1,
    bucket_rows: int = 20_000, seed: int = 20_11,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k nearest found; vectors: vec_id, embedding."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"
    exact = F.col("embedding") if kind == "<f4" else F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", exact.alias("embedding"), is_query.alias("is_query")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).dropDuplicates(["vec_id", "embedding"])
    pair = rows.select("vec_id", "embedding")
    index = pair.mapInArrow(_buckets(1, tables, axes, seed), SCHEMA)
    asked = pair.where(rows["is_query"]).mapInArrow(_buckets(probes, tables, axes, seed), SCHEMA)
    salts = index.groupBy(*BUCKET).agg(F.ceil(F.count("*") / bucket_rows).cast("int").alias("salts"))
    dealt = index.join(salts, BUCKET).select(*BUCKET, F.pmod(F.xxhash64("vec_id", "vector"), "salts").cast("int").alias("salt"), "vec_id", "vector")
    spread = salts.toDF(*BUCKET, "spread")
    asked = asked.join(spread, BUCKET).select(*(F.col(c).alias(f"q_{c}") for c in BUCKET), F.explode(F.sequence(F.lit(0), F.col("spread") - 1)).alias("q_salt"), "vec_id", "vector")
    key = [*BUCKET, "salt"]
    found = dealt.groupBy(*key).cogroup(asked.groupBy(*(f"q_{c}" for c in key))).applyInPandas(_nearest(k, kind), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
