"""What the text operators share: Arrow text as byte arrays, folds, ragged helpers."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step handles; a longer single text is a step of its own.
STEP_BYTES = 4 << 20


def fold(column: str, mod: int) -> Column:
    """crc32 of the value as text, modulo ``mod``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % mod


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(data, offsets)`` of a string or binary Arrow array; nulls are empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with about ``most`` bytes of text each: ``(slice, data, offsets)``."""
    for batch in batches:
        data, offsets = as_bytes(batch.column(text))
        a, n = 0, batch.num_rows
        while a < n:
            b = int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1
            b = min(n, max(b, a + 1))
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            a = b


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(starts, ends, at)`` of the runs of ``inside``, cut between texts; text ``i`` has the runs ``at[i]`` to ``at[i + 1] - 1``."""
    if not len(inside):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    before, after = np.ones(len(inside), bool), np.ones(len(inside), bool)
    before[1:] = ~inside[:-1]
    after[:-1] = ~inside[1:]
    before[offsets[:-1][offsets[:-1] < len(inside)]] = True
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & before), np.flatnonzero(inside & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_rows: int) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys`` in tables of about ``most_rows`` rows that never part a group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size < most_rows:
            continue
        table = pa.Table.from_batches(held)
        other = np.flatnonzero(np.any([table.column(c).to_numpy() != table.column(c)[-1].as_py() for c in keys], axis=0))
        if len(other):
            yield table.slice(0, int(other[-1]) + 1).combine_chunks()
            held = table.slice(int(other[-1]) + 1).combine_chunks().to_batches()
            size = sum(x.num_rows for x in held)
    if size:
        yield pa.Table.from_batches(held).combine_chunks()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``starts[i] .. starts[i] + lengths[i] - 1``."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def by_group(ufunc: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty) -> np.ndarray:
    """``ufunc.reduce`` of ``values[offsets[i]:offsets[i+1]]`` along the first axis; ``empty`` where there is none."""
    n = len(offsets) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = ufunc.reduceat(values, offsets[:-1][full], axis=0)
    return out


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in that order; other columns never reach an operator."""
    return df.select(*names)


def bounded(column: str, scale: float, kind: T.DataType) -> Column:
    """The vector, or an error if inner products of vectors as long as ``scale`` times it could pass 64 bits."""
    square = F.aggregate(F.transform(column, lambda x: F.pow(F.abs(x.cast("double") * scale) + 1, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    return F.when(square < float(1 << 62), F.col(column)).otherwise(F.raise_error(F.lit("scores of a vector this long could pass 64 bits")).cast(kind))


def partitions(df: DataFrame, at_least: int = 8) -> int:
    """Shuffle partitions of the session, for repartition() by a key."""
    return max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def trained(sample: DataFrame, train: Callable[[pd.DataFrame], object]) -> object:
    """What ``train`` makes of a bounded sample, in one task on an executor; the driver gets the model and never the texts."""
    names = sample.columns

    def run(batches):
        found = list(batches)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(pa.Table.from_batches(found).to_pandas()))], pa.binary())], ["model"])

    rows = sample.repartition(1).mapInArrow(run, "model binary").collect()  # one row
    return pickle.loads(rows[0].model) if rows else train(pd.DataFrame(columns=names))


@contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Jobs that run inside hand Python at most about ``most`` bytes at once (Spark's own bound is 64 MB for each task, held
    on both sides); a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    given = int(before.removesuffix("b")) if before.removesuffix("b").isdigit() else None
    if given is not None and 0 < given <= most:
        yield
        return
    spark.conf.set(name, f"{most}b")
    try:
        yield
    finally:
        spark.conf.set(name, before)
