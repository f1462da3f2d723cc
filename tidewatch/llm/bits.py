"""A bit table of fixed size that says which 64-bit numbers may be in a column: never wrong where it says no."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import tidy
from tidewatch.llm.hashing import mix

#: 8 MB on the driver and in a task, whatever the corpus' size.
BITS = 1 << 26


def places_of(numbers: np.ndarray) -> np.ndarray:
    return (mix(numbers.astype(np.uint64)) % np.uint64(BITS)).astype(np.int64)


def table_of(df: DataFrame, column: str) -> np.ndarray:
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places_of(batch.column(0).to_numpy()) + 1)], ["place"])

    found = df.select(column).where(F.col(column).isNotNull()).mapInArrow(tidy(places), "place long")
    pages = found.groupBy(F.bitmap_bucket_number("place").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    bits = np.zeros(BITS // 8, np.uint8)
    for r in pages.collect():  # BITS in all; pages and the places in them count from 1
        raw = np.frombuffer(bytes(r["bits"]), np.uint8)
        bits[(r["page"] - 1) * len(raw) : r["page"] * len(raw)] = raw
    return bits


def in_table(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    place = places_of(numbers)
    return (bits[place >> 3] >> (place & 7) & 1).astype(bool)


def marked(df: DataFrame, column: str, bits: np.ndarray, name: str) -> DataFrame:
    """df with a boolean column that says whether a number of ``column`` may be in the table; nulls aren't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(column)
            may = in_table(bits, numbers.fill_null(0).to_numpy()) & numbers.is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(may)], [*batch.schema.names, name])

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields, T.StructField(name, T.BooleanType())]))
