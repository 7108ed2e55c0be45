"""Embeddings of segments: status, atomic pairs, batched encoding, pooling, manifest, alignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark.functions.audio import slice_samples


def segment_status(segments: DataFrame, *, samples: str = "samples", rate: str = "sample_rate", start: str = "start", end: str = "end", wanted_rate: int | None = None) -> DataFrame:
    """Samples cut to their bounds with ``status``: OK, EMPTY_AUDIO, AUDIO_SEGMENT_INVALID, AUDIO_LOAD_FAILED or AUDIO_DECODE_FAILED."""
    cut = slice_samples(F.col(samples), F.col(rate), F.col(start), F.col(end))
    out = segments.withColumn("_cut", cut)
    status = F.when(F.col(samples).isNull(), "AUDIO_LOAD_FAILED").when(F.col(rate).isNull() | (F.col(rate) <= 0), "AUDIO_DECODE_FAILED")
    if wanted_rate is not None:
        status = status.when(F.col(rate) != wanted_rate, "AUDIO_RATE_MISMATCH")
    return out.withColumn("status", status.otherwise(F.col("_cut.status"))).withColumn(samples, F.when(F.col("status") == "OK", F.col("_cut.samples"))).drop("_cut")


def atomic_pairs(segments: DataFrame, key: str = "merge_key", status: str = "status") -> DataFrame:
    """Both roles of a pair or none: the sound side of a pair with a failure reads SKIPPED_PAIR_FAILURE."""
    failed = F.max(F.when(F.col(status) != "OK", 1).otherwise(0)).over(W.partitionBy(key)) == 1
    return segments.withColumn(status, F.when((F.col(status) == "OK") & failed, "SKIPPED_PAIR_FAILURE").otherwise(F.col(status)))


def select_output(outputs: dict | np.ndarray, names: Sequence[str] = ("embedding", "output", "embeddings", "default")) -> np.ndarray:
    """The first named output of rank two, else the only one of that rank; a bare array is itself."""
    if not isinstance(outputs, dict):
        return np.asarray(outputs)
    for name in names:
        if name in outputs and np.ndim(outputs[name]) == 2:
            return np.asarray(outputs[name])
    flat = [np.asarray(x) for x in outputs.values() if np.ndim(x) == 2]
    if len(flat) != 1:
        raise ValueError(f"no output of rank 2 can be told among {sorted(outputs)}")
    return flat[0]


def embed_segments(segments: DataFrame, encoder: Callable[[], Callable], *, keys: Sequence[str] = ("merge_key", "role"), samples: str = "samples", batch: int = 16, pool: str = "mean", keep_sequence: bool = False) -> DataFrame:
    """Rows with status OK as ``(keys, embedding[, sequence])``.

    ``encoder()`` is called once in each task and returns a function from a zero-padded ``[B, T]`` array to ``[B, D]``
    or ``[B, T', D]`` (or a dict of outputs, see :func:`select_output`). Rows are sorted by length inside a
    partition, which keeps padding small.
    """
    kinds = ", ".join(f"{k} {segments.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{kinds}, embedding array<float>" + (", sequence array<array<float>>" if keep_sequence else "")
    given = segments.where("status = 'OK'").select(*keys, F.col(samples).alias("samples")).sortWithinPartitions(F.size("samples"))

    def run(frames):
        encode = encoder()
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                rows = [np.asarray(x, np.float32) for x in part["samples"]]
                padded = np.zeros((len(rows), max(map(len, rows))), np.float32)
                for i, x in enumerate(rows):
                    padded[i, : len(x)] = x
                found = select_output(encode(padded))
                if found.ndim not in (2, 3) or len(found) != len(rows):
                    raise ValueError(f"encoder returned shape {found.shape} for {len(rows)} segments")
                vectors = found if found.ndim == 2 else getattr(found, pool)(axis=1)
                out = part[list(keys)].copy()
                out["embedding"] = [v.astype(np.float32) for v in vectors]
                if keep_sequence:
                    out["sequence"] = [[r.astype(np.float32) for r in (s if s.ndim == 2 else s[None])] for s in found]
                yield out

    return given.mapInPandas(run, schema)


def pool_sequence(rows: DataFrame, keys: Sequence[str], vector: str = "vec", *, how: str = "mean") -> DataFrame:
    """Mean or maximum of the vectors of a key, place by place; partial aggregates, so long sequences stay spread."""
    agg = F.avg if how == "mean" else F.max
    each = rows.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(agg("x").alias("x"))
    whole = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return whole.select(*keys, F.transform("p", lambda s: s["x"]).alias("embedding"))


def pool_wide(sequences: DataFrame, keys: Sequence[str], sequence: str = "sequence", *, how: str = "mean") -> DataFrame:
    """The same for whole ``[T, D]`` arrays in a row: vectorised, for wide vectors."""
    kinds = ", ".join(f"{k} {sequences.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        for frame in frames:
            out = frame[list(keys)].copy()
            out["embedding"] = [getattr(np.stack([np.asarray(r, np.float64) for r in s]), how)(axis=0) if s is not None and len(s) else None for s in frame[sequence]]
            yield pd.DataFrame(out)

    return sequences.select(*keys, sequence).mapInPandas(run, f"{kinds}, embedding array<double>")


def manifest(pairs: DataFrame, results: DataFrame, key: str = "merge_key", roles: Sequence[str] = ("prompt", "response"), values: Sequence[str] = ("vec_path", "vec_shape", "status"), **descriptors: str) -> DataFrame:
    """One row for each pair with the results of both roles and the model's descriptors."""
    sides = results.groupBy(key).pivot("role", list(roles)).agg(*[F.first(v).alias(v) for v in values])
    if len(values) == 1:
        sides = sides.select(key, *[F.col(r).alias(f"{r}_{values[0]}") for r in roles])
    return pairs.join(sides, key, "left").withColumns({k: F.lit(v) for k, v in descriptors.items()})


def align(pairs: DataFrame, embeddings: DataFrame, key: str = "merge_key", roles: Sequence[str] = ("prompt", "response")) -> DataFrame:
    """Pairs whose two roles both have an embedding with status OK."""
    for role in roles:
        own = embeddings.where((F.col("role") == role) & (F.col("status") == "OK")).select(key, F.col("embedding").alias(f"{role}_embedding"))
        pairs = pairs.join(own, key)
    return pairs
