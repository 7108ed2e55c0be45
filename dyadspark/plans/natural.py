"""The natural turn-pair table, from dyads and recordings to one measured row for each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark import constants as C
from dyadspark.functions import text
from dyadspark.operators import pairs, pitch, quality, tempo
from dyadspark.operators.checkpoints import stored


def sides(dyads: DataFrame, root: str = "") -> DataFrame:
    """One row for each participant of a dyad with the paths of the recording."""
    one = lambda n: dyads.select("interaction_id", "session_id", F.col("p1_vendor").alias("vendor_id"), "p1_source_split", "split", F.col(f"participant{n}_id").alias("participant"), F.concat(F.lit(root), F.col(f"participant{n}_relpath")).alias("wav_path"))
    return one(1).unionByName(one(2)).withColumn("path", F.regexp_replace("wav_path", r"\.wav$", ".json"))


TEMPO = ("speech_rate_local", "articulation_rate_local", "pause_ratio_local", "mean_pause_duration_local")


def measured_side(out: DataFrame, role: str, pause: float, per: float) -> DataFrame:
    """Tempo, bounds and duration of one side of the pairs, under the table's names."""
    t = tempo.word_tempo(F.col(f"{role}_words"), F.col(f"{role}_start"), F.col(f"{role}_end"), pause=pause, per=per)
    out = out.withColumn("_t", t).withColumns({f"{role}_{c}": F.col(f"_t.{c}") for c in TEMPO}).withColumn(f"status_{role}_temporal", F.col("_t.status_temporal")).drop("_t")
    return out.withColumnsRenamed({f"{role}_start": f"{role}_start_s", f"{role}_end": f"{role}_end_s"}).withColumn(f"{role}_duration_s", F.col(f"{role}_end_s") - F.col(f"{role}_start_s"))


def natural_pairs(dyads: DataFrame, words: DataFrame, segments: DataFrame, vad: DataFrame, relationships: DataFrame, *, frames: DataFrame | None = None, root: str = "", pause: float = C.PAUSE, per: float = 60.0, strict: bool = False, **thresholds) -> DataFrame:
    """The shared pair columns, tempo of both sides and (with ``frames``) their pitch statistics.

    ``words``, ``segments`` and ``vad`` are the rows of ``read_recordings``; ``frames`` is ``(path, time, f0)``.
    Times carry any unit: ``pause`` and the thresholds are in it, and ``per`` is a minute. Rows that cannot take part are
    left out; :func:`natural_violations` lists them, and with ``strict`` any of them is an error.
    Recordings are joined with their dyad once; everything up to the pair table then stays on the interaction.
    """
    if strict:
        quality.fail_on_violation(natural_violations(dyads, words, vad, root=root))
    side = sides(dyads, root)
    key = side.select("path", F.col("interaction_id").alias("interaction"), "participant")
    own = words.join(key, "path").withColumn("turn", F.lit(0))
    said = segments.join(key, "path").withColumn("turn", F.lit(0))
    active = vad.where("end > start").join(key, "path")
    found = pairs.build_pairs(own, active, said, **thresholds)

    facts = side.groupBy("interaction_id").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("session_id", "vendor_id", "split")], F.first("p1_source_split", ignorenulls=True).alias("source_dataset_split"))
    out = found.withColumnRenamed("interaction", "interaction_id").join(facts, "interaction_id")
    for role in ("prompt", "response"):
        paths = side.select("interaction_id", F.col("participant").alias(f"{role}_participant_id"), F.col("wav_path").alias(f"source_wav_path_{role}"), F.col("path").alias(f"source_json_path_{role}"))
        out = out.join(paths, ["interaction_id", f"{role}_participant_id"])
        out = measured_side(out, role, pause, per)
    out = pairs.attach_relationships(out, relationships)
    out = out.withColumnsRenamed({"latency": "latency_s", "overlap": "overlap_s"}).withColumns({"status_pair": F.lit("OK"), "split_seed": F.lit(None).cast("string"), "split_unit": F.lit("source_split")})
    extra = []
    if frames is not None:
        out = _with_pitch(out, frames, thresholds.get("longest", C.MAX_SEGMENT))
    for role in ("prompt", "response"):
        if frames is not None:
            extra += [f"{role}_{c}" for c in _PITCH]
        extra += [f"{role}_{c}" for c in TEMPO]
        extra += [f"status_{role}_prosody"] * (frames is not None) + [f"status_{role}_temporal"]
    return out.select(*C.PAIR_COLUMNS, *extra).withColumn("merge_key", text.merge_key(C.MERGE_KEY_COLUMNS))


_PITCH = ("f0_mean", "f0_sd", "f0_range", "voiced_ratio")


def _with_pitch(out: DataFrame, frames: DataFrame, longest: float) -> DataFrame:
    """Pitch of both sides, from one join of frames with the segments of all pairs. Pairs and met frames are stored, as
    each is read more than once."""
    out = stored(out)
    roles = ("prompt", "response")
    side = lambda role: out.select("pair_id", F.lit(role).alias("role"), F.col(f"source_wav_path_{role}").alias("path"), F.col(f"{role}_start_s").alias("start"), F.col(f"{role}_end_s").alias("end"))
    segments = side("prompt").unionByName(side("response"))
    met = stored(pitch.frames_in_segments(frames, segments, bucket=longest).select("pair_id", "role", "f0"))
    stats = pitch.pitch_stats(met, ["pair_id", "role"], segments=segments)
    of = lambda role, c: F.first(F.when(F.col("role") == role, F.col(c)), ignorenulls=True)
    both = stats.groupBy("pair_id").agg(*[of(role, c).alias(f"{role}_{c}") for role in roles for c in _PITCH], *[of(role, "status_prosody").alias(f"status_{role}_prosody") for role in roles])
    return out.join(both, "pair_id", "left")


def natural_violations(dyads: DataFrame, words: DataFrame, vad: DataFrame, *, root: str = "") -> DataFrame:
    """What :func:`natural_pairs` leaves out, as rows ``(check, key, detail)``: interactions that are there twice, sides
    without a recording, dyads that disagree with themselves, and intervals with a null or inverted bound."""
    side = sides(dyads, root)
    lost = side.join(words.select("path").unionByName(vad.select("path")).distinct(), "path", "left_anti")
    found = quality.unique_key(dyads, ["interaction_id"])
    found = found.unionByName(lost.select(F.lit("recording").alias("check"), F.col("path").alias("key"), F.lit("missing").alias("detail")))
    if {f"p{n}_{c}" for n in (1, 2) for c in ("vendor", "session", "interaction", "source_split")} <= set(dyads.columns):
        found = found.unionByName(quality.dyads_consistent(dyads))
    return found.unionByName(quality.intervals_sane(vad, [c for c in ("path", "vad_idx") if c in vad.columns]))
