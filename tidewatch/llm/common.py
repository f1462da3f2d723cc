"""Column helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: White space that separates words: blank and 0x09 to 0x0D.
SPACE_WORD = r"[^\x20\x09-\x0D]+"


#: Bytes, and rows, of an Arrow batch.
BATCH_BYTES, BATCH_ROWS = 2_000_000, 1000


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a batch of long texts, too, fits an executor's memory. A batch has one row at least."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system. Workers outlive their tasks, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function of batches that gives memory back when its task ends."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def tidy_group(run: Callable) -> Callable:
    """A function of a group, or of two, that gives memory back after each."""

    def alone(left):
        out = run(left)
        give_back()
        return out

    def both(left, right):
        out = run(left, right)
        give_back()
        return out

    return alone if run.__code__.co_argcount == 1 else both


def compact(df: DataFrame, rows: int = 50_000) -> DataFrame:
    """A checkpoint of df in as few partitions as its rows ask for: small tables of many partitions would write as many files in every later shuffle."""
    whole = df.checkpoint()
    return whole.coalesce(max(1, -(-whole.count() // rows)))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. lower() does the same to text of ASCII alone, and is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def id_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null ids go by the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds
