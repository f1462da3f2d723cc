"""Ordered folds over keys for operators that read their own earlier results, and what they carry from batch to batch."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of stored states besides the key: which fold a state belongs to, and the pickled state itself, written and read by this engine alone.
STATE = "metric_name string, kind string, state binary"


#: Rows of a series that one task takes at least, where a series is dealt out in pieces.
PIECE = 50_000


@dataclass
class Carry:
    """States of earlier batches (STATE), and those that this batch's folds have left by their kind."""

    states: DataFrame | None = None
    left: dict[str, DataFrame] = field(default_factory=dict)


def _empty(kind: T.DataType):
    """A value that isn't null for columns of rows that only carry a state."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, T.NumericType):
        return F.lit(0).cast(kind)
    return F.lit(None).cast(kind)


def dealt_out(df: DataFrame, *keys: str) -> DataFrame:
    """df with all rows of a key in one partition.

    By a hash of the keys: a repartition by the bare keys falls away where a join before it has dealt out the rows by
    the same, and adaptive execution may then read that join's rows where they lie, a key's in several partitions.
    """
    return df.repartition(F.xxhash64(*keys))


def fold_by_key(
    df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable | None, added: str, carry: Carry | None = None, kind: str = "", prepare: Callable | None = None
) -> DataFrame:
    """df with the columns of ``added`` that step(state, row) gives for each row, in order within a key.

    Rows are dealt out and sorted by key, and read batch by batch with the state of the current key,
    so a key may have more rows than fit in memory. step returns a tuple, or None for no row. What
    doesn't need earlier results goes into prepare(state, rows), which gets a key's rows of a batch at
    once and gives columns, as arrays, for step's rows; without a step they are the result. With a
    carry, keys of one name begin with the states of that kind, and their last states are left in it.
    """
    extra, carries = T.StructType.fromDDL(added), carry is not None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, last = None, None, None
        for batch in batches:
            if not len(batch):
                continue
            out, kept, ended, arrays = [], [], [], []
            of = list(zip(*(batch[k] for k in keys), strict=True))
            held = batch["_state"].tolist() if carries else None
            cuts = [0, *(n for n in range(1, len(of)) if of[n] != of[n - 1]), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if of[a] != current:
                    if last is not None:
                        ended.append(last.assign(_state=pickle.dumps(state)))
                    current, state, last = of[a], start(), None
                if held and held[a] is not None:
                    state = pickle.loads(held[a])
                    a += 1
                if a == b:
                    continue
                rows = batch.iloc[a:b]
                if prepare is not None:
                    found = prepare(state, rows)
                    if step is None:
                        arrays.append(np.column_stack([found[c] for c in extra.names]))
                        kept.extend(range(a, b))
                    else:
                        rows = rows.assign(**found)
                if step is not None:
                    for n, row in enumerate(rows.itertuples(index=False), a):
                        if (got := step(state, row)) is not None:
                            kept.append(n)
                            out.append(got)
                last = batch.iloc[[b - 1]].reset_index(drop=True) if carries else None
            more = pd.DataFrame(np.concatenate(arrays) if arrays else out, columns=extra.names, index=batch.index[kept])
            yield pd.concat([batch.iloc[kept], more], axis=1)
            for row in ended:
                yield row.assign(**{c: pd.Series([None], dtype=object) for c in extra.names})
        if last is not None:
            yield last.assign(_state=pickle.dumps(state), **{c: pd.Series([None], dtype=object) for c in extra.names})

    if carry is None:
        return dealt_out(df, *keys).sortWithinPartitions(*keys, *order).mapInPandas(run, T.StructType([*df.schema.fields, *extra.fields]))
    rows = df.withColumns({"_given": F.lit(1), "_state": F.lit(None).cast("binary")})
    if carry.states is not None:
        known = carry.states.where(F.col("kind") == kind).select(*keys, *(_empty(f.dataType).alias(f.name) for f in df.schema.fields if f.name not in keys), F.lit(0).alias("_given"), F.col("state").alias("_state"))
        rows = rows.unionByName(known)
    fields = [T.StructField(f.name, f.dataType) for f in rows.schema.fields]
    found = dealt_out(rows, *keys).sortWithinPartitions(*keys, "_given", *order).mapInPandas(run, T.StructType([*fields, *extra.fields])).checkpoint()
    carry.left[kind] = found.where("_state is not null").select("metric_name", F.lit(kind).alias("kind"), F.col("_state").alias("state"))
    return found.where("_state is null").drop("_given", "_state")


def moving(df: DataFrame, keys: list[str], order: list[str], before: int, reads: list[str], compute: Callable, added: str, size: int = PIECE) -> DataFrame:
    """df with the columns of ``added``, which depend on a row and on at most ``before`` rows before it.

    Each key's rows are dealt out in pieces of ``size`` rows, a piece with copies of the rows before it,
    so the tasks of one long series share the work. compute(columns, first) gets the ``reads`` columns of
    rows in order as arrays and gives the added ones, as arrays, of the rows from first on; there are
    ``before`` rows before those, or as many as the series has.
    """
    size = max(size, before)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    own = F.floor(F.col("_at") / size).cast("int")
    pieces = F.when(F.col("_at") % size >= size - before, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = df.withColumn("_at", place).withColumn("_piece", F.explode(pieces)).withColumn("_lead", F.col("_piece") != own)
    extra, names = T.StructType.fromDDL(added), df.columns
    schema = T.StructType([*df.schema.fields, *extra.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tail = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            of = [batch.column(k).to_numpy(zero_copy_only=False) for k in (*keys, "_piece")]
            lead = batch.column("_lead").to_numpy(zero_copy_only=False)
            new = np.zeros(len(lead), bool)
            for x in of:
                new[1:] |= x[1:] != x[:-1]
            cuts, columns, found = [0, *np.flatnonzero(new), len(lead)], {c: batch.column(c).to_numpy(zero_copy_only=False) for c in reads}, []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                key = tuple(x[a] for x in of)
                if key != current:
                    current, tail = key, {c: columns[c][:0] for c in reads}
                rows = {c: np.concatenate([tail[c], columns[c][a:b]]) for c in reads}
                first = len(tail[reads[0]]) + int(lead[a:b].sum())
                if first < len(rows[reads[0]]):
                    found.append(compute(rows, first))
                tail = {c: x[max(len(x) - before, 0) :] for c, x in rows.items()}
            if found:
                kept = batch.select(names).filter(pa.array(~lead))
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(np.concatenate([f[c] for f in found])) for c in extra.names)], names=schema.names)

    return dealt_out(dealt, *keys, "_piece").sortWithinPartitions(*keys, "_piece", "_at").mapInArrow(run, schema)
