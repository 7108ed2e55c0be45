"""Recordings of any length as rows of bounded blocks ``(path, block, samples)``: clips, frames and speech chunks.

A block has ``size`` samples, the last one of a recording may have fewer. What spans block edges is met by an equi-join on
the path and the block, so no row ever holds a recording, and a long recording is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark import constants as C


def to_blocks(pieces: DataFrame, size: int, *, key: str = "path") -> DataFrame:
    """``(key, block, samples)`` from ``(key, offset, samples)``: pieces of any length that follow each other without gaps."""
    n, offset = F.size("samples"), F.col("offset")
    parts = pieces.where(n > 0).withColumn("block", F.explode(F.sequence(F.floor(offset / size), F.floor((offset + n - 1) / size))))
    low, high = F.greatest(F.col("block") * size - offset, F.lit(0)), F.least((F.col("block") + 1) * size - offset, n)
    own = F.slice("samples", (low + 1).cast("int"), (high - low).cast("int"))
    parts = parts.select(key, "block", F.struct((offset + low).alias("at"), own.alias("samples")).alias("part"))
    return parts.groupBy(key, "block").agg(F.array_sort(F.collect_list("part")).alias("parts")).select(key, "block", F.flatten("parts.samples").alias("samples"))


def parts_of(spans: DataFrame, blocks: DataFrame, size: int, *, key: str = "path", a: str = "a", b: str = "b") -> DataFrame:
    """The samples ``a`` to ``b - 1`` of each span, a row for each block it touches: its columns, ``at`` and ``samples``."""
    met = spans.where(F.col(b) > F.col(a)).withColumn("block", F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size))))
    begin = F.col("block") * size
    low, high = F.greatest(F.col(a) - begin, F.lit(0)), F.least(F.col(b) - begin, F.size("samples"))
    found = met.join(blocks.select(key, "block", "samples"), [key, "block"]).where(high > low)
    return found.select(*spans.columns, (begin + low).alias("at"), F.slice("samples", (low + 1).cast("int"), (high - low).cast("int")).alias("samples"))


def clips(segments: DataFrame, blocks: DataFrame, recordings: DataFrame, size: int, *, key: str = "path", segment: str = "segment_id") -> DataFrame:
    """``(segment, sample_rate, status, samples)`` of ``(segment, key, start, end)``; bounds are rounded half to even.

    ``recordings`` is ``(key, sample_rate, n_frames)``. A clip no longer than a block meets two blocks at most.
    """
    own = segments.select(segment, key, "start", "end").join(recordings.select(key, "sample_rate", "n_frames"), key, "left")
    own = own.withColumns({"a": F.rint(F.col("start") * F.col("sample_rate")).cast("long"), "b": F.rint(F.col("end") * F.col("sample_rate")).cast("long")})
    bad = (F.col("a") < 0) | (F.col("b") <= F.col("a")) | (F.col("b") > F.col("n_frames"))
    own = own.withColumn("status", F.when(F.coalesce("n_frames", F.lit(0)) == 0, "EMPTY_AUDIO").when(F.coalesce(bad, F.lit(True)), "AUDIO_SEGMENT_INVALID").otherwise("OK"))
    parts = parts_of(own.where("status = 'OK'").select(segment, key, "a", "b"), blocks, size, key=key)
    whole = parts.groupBy(segment).agg(F.array_sort(F.collect_list(F.struct("at", "samples"))).alias("parts")).select(segment, F.flatten("parts.samples").alias("samples"))
    return own.select(segment, "sample_rate", "status").join(whole, segment, "left")


def frame_rms(blocks: DataFrame, recordings: DataFrame, size: int, *, key: str = "path", frame: float = C.FRAME, hop: float = C.HOP, eps: float = C.EPS) -> DataFrame:
    """``(key, frame_idx, center, rms, length)``, as :func:`tempo.frame_rms` gives for whole arrays.

    A frame belongs to the block it begins in; the samples it needs from the next block (its halo) come by a join.
    Frames must not be longer than a block.
    """
    rates = recordings.select(key, "sample_rate", "n_frames").where("n_frames > 0 AND sample_rate IS NOT NULL")
    width = F.greatest(F.rint(frame * F.col("sample_rate")).cast("int"), F.lit(1))
    own = blocks.join(rates, key).withColumn("width", width)
    own = own.withColumn("samples", F.when(F.col("width") <= size, F.col("samples")).otherwise(F.raise_error(F.lit("frames are longer than a block")).cast(blocks.schema["samples"].dataType)))
    halo = own.select(key, (F.col("block") - 1).alias("block"), F.slice("samples", 1, F.greatest(F.col("width") - 1, F.lit(1))).alias("halo"))
    own = own.join(halo, [key, "block"], "left")
    kind = blocks.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                name, n, begin, rate, w = getattr(row, key), int(row.n_frames), int(row.block) * size, float(row.sample_rate), int(row.width)
                step = max(1, int(np.rint(hop * rate)))
                y = np.asarray(row.samples, np.float64)
                if row.halo is not None:
                    y = np.concatenate([y, np.asarray(row.halo, np.float64)])
                first = -(-begin // step)
                if n < w:
                    at, w, first = np.zeros(int(begin == 0), np.int64), n, 0
                else:
                    at = np.arange(first * step - begin, len(row.samples), step)
                    at = at[at + w <= n - begin]
                power = np.array([np.mean(np.square(y[i : i + w])) for i in at])
                if len(at):
                    out.append(pd.DataFrame({key: name, "frame_idx": (first + np.arange(len(at))).astype(np.int32), "center": (begin + at + w / 2) / rate, "rms": np.sqrt(power + eps), "length": n / rate}))
            if out:
                yield pd.concat(out)

    return own.select(key, "block", "samples", "halo", "sample_rate", "n_frames", "width").mapInPandas(run, f"{key} {kind}, frame_idx int, center double, rms double, length double")


def chunk_samples(pieces: DataFrame, blocks: DataFrame, size: int, keys: Sequence[str] = ("path",), *, key: str = "path", start: str = "start", end: str = "end") -> DataFrame:
    """``(keys, chunk_idx, samples)`` of the pieces that :func:`intervals.chunk_pieces` gives in sample numbers."""
    spans = pieces.select(*keys, "chunk_idx", F.col(start).alias("a"), F.col(end).alias("b"))
    parts = parts_of(spans, blocks, size, key=key)
    whole = parts.groupBy(*keys, "chunk_idx").agg(F.array_sort(F.collect_list(F.struct("at", "samples"))).alias("parts"))
    return whole.select(*keys, "chunk_idx", F.flatten("parts.samples").alias("samples"))
