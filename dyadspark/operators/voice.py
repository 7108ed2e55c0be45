"""Affect and speaker aggregates over chunk predictions, and the predictions themselves."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark import constants as C


def affect_means(chunks: DataFrame, key: str = "segment_id", values: Sequence[str] = ("arousal", "valence", "dominance"), *, speech: DataFrame | None = None) -> DataFrame:
    """Unweighted mean of the chunk predictions of each segment, and how many there are.

    ``speech`` is ``(key, speech)`` (see :func:`intervals.total_length`): it adds ``vox_support_speech_sec`` and the
    segments whose speech gives no chunk.
    """
    means = chunks.groupBy(key).agg(*[F.avg(v).alias(v) for v in values], F.count("*").alias("vox_num_chunks"))
    if speech is None:
        return means
    out = means.join(speech.select(key, F.col("speech").alias("vox_support_speech_sec")), key, "full")
    return out.withColumns({"vox_num_chunks": F.coalesce("vox_num_chunks", F.lit(0)), "vox_support_speech_sec": F.coalesce("vox_support_speech_sec", F.lit(0).cast(speech.schema["speech"].dataType))})


def with_vox_status(segments: DataFrame, affect: DataFrame, key: str = "segment_id", *, duration: str = "duration", shortest: float = C.MIN_SEGMENT) -> DataFrame:
    """Segments with their affect; those too short, or without chunks, keep nulls and say why."""
    out = segments.join(affect, key, "left")
    short = F.col(duration) < shortest - 1e-6
    values = [c for c in affect.columns if c != key]
    status = F.when(short, "TOO_SHORT_FOR_VOX").when(F.coalesce("vox_num_chunks", F.lit(0)) == 0, "NO_VALID_CHUNKS").otherwise("OK")
    return out.select(*segments.columns, *[F.when(~short, F.col(c)).alias(c) for c in values], status.alias("status_vox"))


def speaker_profiles(chunks: DataFrame, key: str | Sequence[str] = "wav_key", age: str = "age_raw", probabilities: str = "class_probs", *, female: int = 0) -> DataFrame:
    """Mean age (model output times 100), and gender by the class with the highest mean probability."""
    keys = [key] if isinstance(key, str) else list(key)
    ages = chunks.groupBy(*keys).agg((F.avg(age) * 100).alias("age"))
    each = chunks.select(*keys, F.posexplode(probabilities).alias("pos", "p")).groupBy(*keys, "pos").agg(F.avg("p").alias("p"))
    best = each.groupBy(*keys).agg(F.max_by("pos", F.struct("p", (-F.col("pos")).alias("first"))).alias("pos"), F.max("p").alias("gender_confidence"))
    return ages.join(best, keys).select(*keys, "age", F.when(F.col("pos") == female, "female").otherwise("male").alias("gender"), "gender_confidence")


def attach_profiles(pairs: DataFrame, profiles: DataFrame, key: str | Sequence[str] = "wav_key", roles: Sequence[str] = ("prompt", "response"), *, status: str = "speaker") -> DataFrame:
    """Profiles computed once for each recording (or clip: several key columns), looked up for both roles.

    ``status`` names the status columns.
    """
    keys = [key] if isinstance(key, str) else list(key)
    for role in roles:
        values = [c for c in profiles.columns if c not in keys]
        own = profiles.select(*[F.col(k).alias(f"{role}_{k}") for k in keys], *[F.col(c).alias(f"{role}_{c}") for c in values], F.lit("OK").alias("_ok"))
        pairs = pairs.join(own, [f"{role}_{k}" for k in keys], "left").withColumn(f"status_{role}_{status}", F.coalesce("_ok", F.lit("MISSING_SPEAKER_PROFILE"))).drop("_ok")
    return pairs


def distinct_keys(pairs: DataFrame, keys: Sequence[str], roles: Sequence[str] = ("prompt", "response")) -> DataFrame:
    """Recordings (or clips) to run a model on: each once, however many pairs use it."""
    parts = [pairs.select(*[F.col(f"{role}_{k}").alias(k) for k in keys]) for role in roles]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def predict_chunks(chunks: DataFrame, model: Callable[[], Callable], schema: T.StructType | str, *, batch: int = 16, samples: str = "samples") -> DataFrame:
    """Chunk rows with what a user's model says about their samples.

    ``model()`` is called once in each task and returns a function from a list of arrays to a list of dicts (the
    columns of ``schema``). The other columns are kept.
    """
    added = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    keep = [f for f in chunks.schema.fields if f.name != samples]

    def run(frames):
        predict = model()
        for frame in frames:
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                found = list(predict(list(part[samples])))
                if len(found) != len(part):
                    raise ValueError(f"the model returned {len(found)} rows for {len(part)} chunks")
                new = pd.DataFrame(found, columns=added.names, index=part.index)
                yield pd.concat([part[[f.name for f in keep]], new], axis=1)

    return chunks.mapInPandas(run, T.StructType([*keep, *added.fields]))


def vox_compatible(start: Column, end: Column, shortest: float = C.MIN_SEGMENT) -> Column:
    return (end - start) >= shortest
