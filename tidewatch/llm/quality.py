"""Quality classifier: regularised quadratic discriminant analysis over text statistics.

Each text becomes a short vector of statistics of its form (shares of character classes, word
and line shape, repetition), transformed to be closer to normal. Class means and covariances come
from sums over all labelled training rows, taken per partition and added up, so what reaches the
driver are a few small matrices whatever the corpus' size. Each class covariance is shrunk towards
the pooled one and that towards its diagonal; its Cholesky factor is computed once and sent with
the task. A score is the logistic of the Mahalanobis log-density difference plus the log prior.

Labels, languages, sources and ids are never part of a score.

Defined cases: null text counts as empty; empty texts get a score from the same statistics, all of
them zero; labels other than 0 and 1 are left out; with several labels of one id every one counts;
without labels of both classes every score is the share of label 1 (one half without any);
repeated rows and other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import id_fold, small_batches, tidy
from tidewatch.session import ensure_checkpoint_dir, table

NAMES = ("length", "letters", "upper", "digits", "marks", "odd_marks", "pipes", "high", "lines", "word_length", "word_spread", "distinct_words", "distinct_lines", "short_words", "end_marks")
D = len(NAMES)
THRESHOLD = 0.7

_CLASS = np.zeros(256, np.int64)
_CLASS[np.r_[65:91, 97:123]] = 1
_CLASS[48:58] = 2
_CLASS[[33, 44, 46, 63, 39, 34, 58, 59, 40, 41, 45]] = 3  # usual marks
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 5
_CLASS[[*range(35, 39), 42, 43, 47, *range(60, 63), 64, *range(91, 97), 123, 125, 126]] = 6  # odd marks
_CLASS[124] = 7


def statistics(text: str | None) -> np.ndarray:
    """The transformed statistics of one text."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    if not len(raw):
        return np.zeros(D)
    by_byte = np.bincount(raw, minlength=256)
    by = np.bincount(_CLASS, weights=by_byte, minlength=8)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    sizes = np.fromiter(map(len, words), np.float64, len(words))
    n, k, m = len(raw), max(len(words), 1), max(len(lines), 1)
    share = lambda x, of: np.log1p(100 * x / of)
    return np.array([
        np.log1p(n), share(by[1], n), share(by_byte[65:91].sum(), n), share(by[2], n), share(by[3], n), share(by[6], n), share(by[7], n), share(by[5], n),
        share(m, k), np.log1p(sizes.mean() if len(words) else 0), np.log1p(sizes.std() if len(words) else 0),
        len(set(words)) / k, len(set(lines)) / m, share((sizes <= 3).sum(), k), share(by_byte[[33, 46, 63]].sum(), k),
    ])


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, D)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = _matrix(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([v.tobytes() for v in x], pa.binary())], ["doc_id", "x"])


def _unpacked(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(-1, D)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = {c: np.zeros((D + 1, D + 1)) for c in (0, 1)}
    for batch in batches:
        x = np.c_[np.ones(batch.num_rows), _unpacked(batch)]
        y = batch.column("label").to_numpy(zero_copy_only=False)
        for c in sums:
            own = x[y == c]
            sums[c] += own.T @ own
    where = [(c, i, j) for c in sums for i in range(D + 1) for j in range(D + 1)]
    yield pa.RecordBatch.from_pydict({"label": [w[0] for w in where], "i": [w[1] for w in where], "j": [w[2] for w in where], "total": np.concatenate([sums[c].ravel() for c in sums])}, SUMS)


SUMS = pa.schema([("label", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("total", pa.float64())])


class Discriminant:
    """Class priors, means and Cholesky factors; small, and sent with each task."""

    def __init__(self, sums: dict[int, np.ndarray], towards_pooled: float, towards_diagonal: float):
        n = {c: s[0, 0] for c, s in sums.items()}
        self.share = n[1] / (n[0] + n[1]) if n[0] + n[1] else 0.5
        self.fitted = min(n.values()) >= 2
        if not self.fitted:
            return
        self.mean = {c: s[0, 1:] / n[c] for c, s in sums.items()}
        scatter = {c: sums[c][1:, 1:] - n[c] * np.outer(self.mean[c], self.mean[c]) for c in sums}
        pooled = (scatter[0] + scatter[1]) / (n[0] + n[1])
        self.factor = {}
        for c in sums:
            cov = (1 - towards_pooled) * scatter[c] / n[c] + towards_pooled * pooled
            cov = (1 - towards_diagonal) * cov + towards_diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(D)
            self.factor[c] = np.linalg.inv(np.linalg.cholesky(cov))
        self.log_prior = np.log(n[1] / n[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), self.share)
        log_density = {}
        for c, factor in self.factor.items():
            z = (x - self.mean[c]) @ factor.T
            log_density[c] = np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(log_density[1] - log_density[0] + self.log_prior, -500, 500)))


def fit(labelled: DataFrame, towards_pooled: float = 0.3, towards_diagonal: float = 0.01) -> Discriminant:
    """labelled: x, label. Fitted on all rows whose label is 0 or 1."""
    rows = labelled.where("label in (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    parts = rows.mapInArrow(tidy(_sums), "label int, i int, j int, total double")
    sums = {c: np.zeros((D + 1, D + 1)) for c in (0, 1)}
    for r in parts.groupBy("label", "i", "j").agg(F.sum("total").alias("total")).collect():  # 2 (D + 1)^2 rows
        sums[r["label"]][r["i"], r["j"]] = r["total"]
    return Discriminant(sums, towards_pooled, towards_diagonal)


def vectors(docs: DataFrame) -> DataFrame:
    """doc_id and x, the packed statistics of each row; joins with these move no texts."""
    return docs.select("doc_id", "text").mapInArrow(tidy(_vectors), "doc_id long, x binary")


def training_rows(of_docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled vectors whose id is not in the held-out fold."""
    marked = labels.select("doc_id", F.col("quality").alias("label")).where(id_fold(F.col("doc_id"), 4) != 2)
    return of_docs.join(marked, "doc_id").select("x", "label")


def score(docs: DataFrame, model: Discriminant, name: str = "score") -> DataFrame:
    """docs with the score in a column of that name, which replaces one of the input."""
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.score(_matrix(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row. Texts are read once; their vectors are kept between fitting and scoring."""
    ensure_checkpoint_dir(docs.sparkSession)
    of_docs = vectors(docs).checkpoint()
    model = fit(training_rows(of_docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_unpacked(batch)), pa.float64())], ["doc_id", "score"])

    return of_docs.mapInArrow(tidy(run), "doc_id long, score double").select(
        "doc_id",
        (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
