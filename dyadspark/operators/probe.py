"""Probe items: complete folders, voices of their speakers, flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete_items(files: DataFrame, required: Sequence[str], item: str = "row_dir", name: str = "file_name") -> DataFrame:
    """``(item, missing, complete)``: the required files that an item lacks."""
    have = files.groupBy(item).agg(F.collect_set(F.when(F.col(name).isin(*required), F.col(name))).alias("have"))
    return have.select(item, F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("have"))).alias("missing")).withColumn("complete", F.size("missing") == 0)


def majority_model(metadata: DataFrame, keys: Sequence[str], speaker: str = "spk", model: str = "tts_model", order: str = "row_order") -> DataFrame:
    """Most frequent voice of each speaker: blank speakers are skipped, a blank voice reads ``orig``, ties go to the first seen."""
    named = metadata.where(F.trim(F.coalesce(speaker, F.lit(""))) != "").withColumn(model, F.coalesce(F.nullif(F.trim(F.col(model)), F.lit("")), F.lit("orig")))
    votes = named.groupBy(*keys, speaker, model).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = votes.groupBy(*keys, speaker).agg(F.max_by(model, F.struct("n", (-F.col("first")).alias("early"))).alias(model), F.max("n").alias("votes"))
    return best


def attach_models(pairs: DataFrame, models: DataFrame, keys: Sequence[str], speaker: str = "spk", model: str = "tts_model") -> DataFrame:
    """``prompt_tts_model`` and ``response_tts_model`` of ``{role}_{speaker}``; a miss reads UNKNOWN."""
    for role in ("prompt", "response"):
        own = models.select(*keys, F.col(speaker).alias(f"{role}_{speaker}"), F.col(model).alias(f"{role}_{model}"))
        pairs = pairs.join(own, [*keys, f"{role}_{speaker}"], "left").withColumn(f"{role}_{model}", F.coalesce(f"{role}_{model}", F.lit("UNKNOWN")))
    return pairs


def voice_flags(prompt: Column, response: Column, synthetic: str) -> list[Column]:
    p, r = prompt == synthetic, response == synthetic
    return [p.alias("prompt_is_synthetic"), r.alias("response_is_synthetic"), (~p & r).alias("is_human_prompt_synthetic_response")]
