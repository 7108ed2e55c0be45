"""Tempo and pauses, from timed words and from signal energy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dyadspark import constants as C
from dyadspark.operators.intervals import merge_intervals


def word_tempo(words: Column, start: Column, end: Column, *, pause: float = C.PAUSE, per: float = 60.0) -> Column:
    """Struct of rates and pauses of one segment from its words, in order of their starts.

    ``per`` is a minute in the unit of the times. Under two words everything is null.
    """
    gaps = F.zip_with(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda b, a: b["start"] - a["end"])
    pauses = F.filter(gaps, lambda g: g >= pause)
    total = F.aggregate(pauses, F.lit(0.0), lambda s, g: s + g)
    span = (end - start).cast("double")
    spoken = F.greatest(span - total, F.lit(0.0))
    n = F.size(words)
    ok = n >= 2
    return F.struct(
        F.when(ok, per * n / span).alias("speech_rate_local"),
        F.when(ok & (spoken > 0), per * n / spoken).alias("articulation_rate_local"),
        F.when(ok, total / span).alias("pause_ratio_local"),
        F.when(ok, F.when(F.size(pauses) > 0, total / F.size(pauses)).otherwise(0.0)).alias("mean_pause_duration_local"),
        F.when(ok, "OK").otherwise("TOO_FEW_WORDS_FOR_TEMPORAL").alias("status_temporal"),
    )


def frame_rms(signals: DataFrame, key: str = "segment_id", *, frame: float = C.FRAME, hop: float = C.HOP, eps: float = C.EPS) -> DataFrame:
    """``(key, frame_idx, center, rms, length)`` of ``(key, sample_rate, samples)``; a signal shorter than a frame is one frame."""
    kind = signals.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lengths = np.array([0 if s is None else len(s) for s in batch["samples"]], np.int64)
            own = np.flatnonzero((lengths > 0) & batch["sample_rate"].notna().to_numpy())
            if not len(own):
                continue
            y = np.concatenate([batch["samples"].iloc[i] for i in own]).astype(np.float64)
            n, rate = lengths[own], batch["sample_rate"].to_numpy()[own].astype(np.float64)
            size = np.maximum(1, np.rint(frame * rate)).astype(np.int64)
            step = np.maximum(1, np.rint(hop * rate)).astype(np.int64)
            short = n < size
            width, many = np.minimum(size, n), np.where(short, 1, (n - size) // step + 1)
            who = np.repeat(np.arange(len(own)), many)
            index = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
            begin = (np.cumsum(n) - n)[who] + index * step[who]
            ends = np.cumsum(width[who])  # every frame's samples, one after another
            at = np.arange(ends[-1]) - np.repeat(ends - width[who], width[who]) + np.repeat(begin, width[who])
            power = np.add.reduceat(y[at] ** 2, ends - width[who]) / width[who]
            center = np.where(short[who], n[who] / 2, index * step[who] + size[who] / 2) / rate[who]
            yield pd.DataFrame({key: batch[key].to_numpy()[own][who], "frame_idx": index.astype(np.int32), "center": center, "rms": np.sqrt(power + eps), "length": (n / rate)[who]})

    return signals.select(key, "sample_rate", "samples").mapInPandas(run, f"{key} {kind}, frame_idx int, center double, rms double, length double")


def energy_speech(frames: DataFrame, key: str = "segment_id", *, frame: float = C.FRAME, gap: float = C.PAUSE) -> DataFrame:
    """``(key, start, end)`` of speech: runs of frames at or over ``max(.35 p65, .05 max, 1e-4)``, short gaps joined.

    A run ends half a frame after the centre of the first silent frame, or with the signal. A signal of one
    frame is speech as a whole if it is louder than the floor.
    """
    cut = frames.groupBy(key).agg(F.greatest(F.expr("percentile(rms, 0.65)") * 0.35, F.max("rms") * 0.05, F.lit(1e-4)).alias("threshold"), F.count("*").alias("n"))
    by = W.partitionBy(key).orderBy("frame_idx")
    loud = frames.join(cut, key).withColumn("loud", F.col("rms") >= F.col("threshold"))
    loud = loud.withColumn("_new", (F.col("loud") & ~F.coalesce(F.lag("loud").over(by), F.lit(False))).cast("int")).withColumn("_next", F.lead("center").over(by))
    loud = loud.withColumn("run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0))).where("loud")
    runs = loud.groupBy(key, "run").agg(F.min("center").alias("first"), F.max_by("_next", "frame_idx").alias("close"), F.first("length").alias("length"), F.first("n").alias("n"), F.max("rms").alias("loudest"))
    one = (F.col("n") == 1) & (F.col("length") < frame)
    runs = runs.where(~one | (F.col("loudest") > C.EPS))
    start = F.when(one, 0.0).otherwise(F.greatest(F.lit(0.0), F.col("first") - frame / 2))
    end = F.when(one | F.col("close").isNull(), F.col("length")).otherwise(F.least(F.col("length"), F.col("close") + frame / 2))
    return merge_intervals(runs.select(key, start.alias("start"), end.alias("end")), [key], "start", "end", gap, inclusive=False).select(key, "start", "end")


def energy_tempo(segments: DataFrame, speech: DataFrame, key: str = "segment_id", *, pause: float = C.PAUSE, per: float = 60.0) -> DataFrame:
    """Rates and pauses of ``(key, duration, word_count)`` from merged speech intervals."""
    by = W.partitionBy(key).orderBy("start")
    gaps = speech.withColumn("gap", F.col("start") - F.lag("end").over(by))
    is_pause = F.col("gap") >= pause
    own = gaps.groupBy(key).agg(F.sum(F.col("end") - F.col("start")).alias("vad_speech_sec"), F.coalesce(F.sum(F.when(is_pause, F.col("gap"))), F.lit(0.0)).alias("vad_pause_sec"), F.coalesce(F.avg(F.when(is_pause, F.col("gap"))), F.lit(0.0)).alias("mean_pause_duration_local"))
    out = segments.join(own, key, "left")
    some, wc = F.col("vad_speech_sec").isNotNull(), F.col("word_count")
    return out.select(
        *segments.columns,
        F.when(wc > 0, per * wc / F.col("duration")).alias("speech_rate_local"),
        F.when(some & (wc > 0) & (F.col("vad_speech_sec") > 0), per * wc / F.col("vad_speech_sec")).alias("articulation_rate_local"),
        F.when(some, F.col("vad_pause_sec") / F.col("duration")).alias("pause_ratio_local"),
        "mean_pause_duration_local",
        F.coalesce("vad_speech_sec", F.lit(0.0)).alias("vad_speech_sec"),
        "vad_pause_sec",
        F.when(~some, "NO_SPEECH_FRAMES").when(wc < 2, "TOO_FEW_WORDS_FOR_TEMPORAL").otherwise("OK").alias("status_temporal"),
    )


def word_tempo_rows(words: DataFrame, keys: Sequence[str], *, pause: float = C.PAUSE) -> DataFrame:
    """Gaps between words as rows: ``(keys, n_words, pause_total, n_pauses)``, for words that are not in arrays."""
    by = W.partitionBy(*keys).orderBy("start", "word_idx")
    gaps = words.withColumn("gap", F.col("start") - F.lag("end").over(by))
    is_pause = F.col("gap") >= pause
    return gaps.groupBy(*keys).agg(F.count("*").alias("n_words"), F.coalesce(F.sum(F.when(is_pause, F.col("gap"))), F.lit(0)).alias("pause_total"), F.count(F.when(is_pause, 1)).alias("n_pauses"))
