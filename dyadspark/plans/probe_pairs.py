"""The probe's pair table, from folders of two tracks each to one measured row for each pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dyadspark import constants as C
from dyadspark.functions import text
from dyadspark.operators import pairs, probe
from dyadspark.plans.natural import TEMPO, measured_side


def item_tracks(files: DataFrame, root: str = "") -> DataFrame:
    """One row for each complete and well-named folder of ``(row_dir, file_name)``, with both of its tracks:
    ``row_dir``, ``p1``, ``p2`` and an array of ``{track, speaker, participant, wav, json}``."""
    whole = probe.complete_items(files, C.PROBE_FILES).where("complete").select("row_dir")
    named = whole.withColumn("n", text.parse_row_dir(F.col("row_dir"))).where("n IS NOT NULL")
    named = named.select("row_dir", *[text.canonical_participant_id(F.col(f"n.{p}")).alias(p) for p in ("p1", "p2")])
    path = lambda track, kind: F.concat(F.lit(f"{root}/" if root else ""), "row_dir", F.lit(f"/{track}_track.{kind}"))
    tracks = [F.struct(F.lit(t).alias("track"), F.lit(s).alias("speaker"), F.col(p).alias("participant"), path(t, "wav").alias("wav"), path(t, "json").alias("json")) for (t, s), p in zip(C.PROBE_TRACKS.items(), ("p1", "p2"), strict=True)]
    return named.withColumn("tracks", F.array(*tracks))


def item_violations(files: DataFrame) -> DataFrame:
    """``(check, key, detail)`` of the folders that :func:`item_tracks` leaves out; empty folders lack every file."""
    lacking = probe.complete_items(files, C.PROBE_FILES).where("NOT complete").select(F.lit("item_files").alias("check"), F.col("row_dir").alias("key"), F.concat_ws(",", "missing").alias("detail"))
    named = files.select("row_dir").distinct().where(text.parse_row_dir(F.col("row_dir")).isNull())
    return lacking.unionByName(named.select(F.lit("item_name").alias("check"), F.col("row_dir").alias("key"), F.lit("unexpected name").alias("detail")))


def probe_pairs(files: DataFrame, metadata: DataFrame, words: DataFrame, segments: DataFrame, vad: DataFrame, *, synthetic: str, dataset: str, root: str = "", split: str = "external", pause: float = C.PAUSE, per: float = 60.0, **thresholds) -> DataFrame:
    """The probe's pair columns, with voices and tracks of both sides, tempo, and the merge key.

    ``files`` is :func:`tables.item_files`, ``metadata`` is :func:`tables.read_item_metadata`, the others are the rows of
    ``recordings``. Tracks meet their folder once; everything up to the pair table then stays on the folder.
    """
    items = item_tracks(files, root)
    track = items.select(F.col("row_dir").alias("interaction"), F.explode("tracks").alias("t")).select("interaction", "t.*")
    key = track.select("interaction", "participant", F.col("json").alias("path"))
    own = lambda df: df.join(key, "path")
    turn = F.lit(0)
    found = pairs.build_pairs(own(words).withColumn("turn", turn), own(vad.where("end > start")), own(segments).withColumn("turn", turn), **thresholds)
    voices = probe.majority_model(metadata, ["row_dir"]).select(F.col("row_dir").alias("interaction"), F.col("spk").alias("speaker"), "tts_model")
    sides = track.join(voices, ["interaction", "speaker"], "left").withColumn("tts_model", F.coalesce("tts_model", F.lit("UNKNOWN")))
    for role in ("prompt", "response"):
        side = sides.select("interaction", F.col("participant").alias(f"{role}_participant_id"), F.col("track").alias(f"{role}_track"), F.col("tts_model").alias(f"{role}_tts_model"), F.col("wav").alias(f"source_wav_path_{role}"), F.col("json").alias(f"source_json_path_{role}"))
        found = measured_side(found.join(side, ["interaction", f"{role}_participant_id"]), role, pause, per)
    flags = probe.voice_flags(F.col("prompt_tts_model"), F.col("response_tts_model"), synthetic)
    fixed = {"session_id": dataset, "source_dataset_split": dataset, "split": split, "split_unit": "row_dir", "status_pair": "OK", "relationship": "UNKNOWN", "relationship_detail": "UNKNOWN", "status_relationship": "MISSING_RELATIONSHIP_METADATA"}
    found = found.select("*", *flags).withColumns({c: F.lit(v) for c, v in fixed.items()}).withColumn("split_seed", F.lit(None).cast("string"))
    found = found.withColumn("row_dir", F.col("interaction")).withColumnsRenamed({"interaction": "interaction_id", "latency": "latency_s", "overlap": "overlap_s"})
    tempo = [f"{role}_{c}" for role in ("prompt", "response") for c in TEMPO]
    return found.select(*C.PROBE_COLUMNS, *tempo, "status_prompt_temporal", "status_response_temporal").withColumn("merge_key", text.merge_key(C.MERGE_KEY_COLUMNS))
