import json

import pytest
from pyspark.sql import functions as F

from dyadspark import constants as C
from dyadspark.operators import pitch
from dyadspark.plans import natural
from dyadspark.plans.probe_pairs import item_violations, probe_pairs
from dyadspark.sources import tables


def track(*turns):
    out = {"metadata:transcript": [], "metadata:vad": []}
    for start, end, said in turns:
        words = said.split()
        step = (end - start) / len(words)
        out["metadata:transcript"].append({"transcript": said, "words": [{"word": w, "start": start + i * step, "end": start + (i + 1) * step} for i, w in enumerate(words)]})
        out["metadata:vad"].append({"start": start, "end": end})
    return json.dumps(out)


def item(root, name, files):
    folder = root / name
    folder.mkdir(parents=True)
    for file, content in files.items():
        (folder / file).write_text(content)


def test_from_folders_to_pairs(spark, tmp_path):
    whole = {"metadata.csv": "spk,tts_model\nA,\nA,x\nA,\nB,synth\n,x\n", "speaker1_track.wav": "", "speaker2_track.wav": "", "speaker1_track.json": track((0, 4, "one two three four five"), (9, 13, "nine ten eleven twelve")), "speaker2_track.json": track((4.5, 8.5, "what is it then"))}
    item(tmp_path, "row_3_p1_P07_p2_P08", whole)
    item(tmp_path, "row_4_p1_P1_p2_P2", {k: v for k, v in whole.items() if k != "metadata.csv"})
    item(tmp_path, "row_5_p1_P1_p2_P2", {})
    item(tmp_path, "odd", whole)
    files = tables.item_files(spark, str(tmp_path))
    assert {(r.key, r.detail) for r in item_violations(files).collect()} == {("row_4_p1_P1_p2_P2", "metadata.csv"), ("row_5_p1_P1_p2_P2", ",".join(sorted(C.PROBE_FILES))), ("odd", "unexpected name")}
    found = tables.recordings(spark, f"{tmp_path}/*/*_track.json")
    out = probe_pairs(files, tables.read_item_metadata(spark, str(tmp_path)), found.words, found.segments, found.vad, synthetic="synth", dataset="probe", root=str(tmp_path))
    assert out.columns[: len(C.PROBE_COLUMNS)] == C.PROBE_COLUMNS
    one, two = out.orderBy("turn_index").collect()
    assert (one.pair_id, one.prompt_tts_model, one.response_tts_model, one.is_human_prompt_synthetic_response) == ("row_3_p1_P07_p2_P08|P07|P08|0001", "orig", "synth", True)
    assert (two.prompt_track, two.response_track, two.is_human_prompt_synthetic_response, two.latency_s) == ("speaker2", "speaker1", False, 0.5)
    assert one.source_wav_path_prompt == f"{tmp_path}/row_3_p1_P07_p2_P08/speaker1_track.wav" and one.prompt_speech_rate_local == 75
    assert one.merge_key == "probe|row_3_p1_P07_p2_P08|P07|P08|P07|P08|1|0.0|4.0|4.5|8.5"


def test_natural_pairs_can_fail_on_what_they_leave_out(spark):
    dyads = spark.createDataFrame([("1", "s", "V", "train", "train", "P1", "a/x.wav", "P2", "a/y.wav")], "interaction_id string, session_id string, p1_vendor string, p1_source_split string, split string, participant1_id string, participant1_relpath string, participant2_id string, participant2_relpath string")
    words = spark.createDataFrame([("a/x.json", 0, 0, "hi", 0.0, 1.0)], "path string, seg_idx int, word_idx int, word string, start double, end double")
    segments = spark.createDataFrame([("a/x.json", 0, "hi")], "path string, seg_idx int, transcript string")
    vad = spark.createDataFrame([("a/x.json", 0, 2.0, 1.0), ("a/x.json", 1, None, 1.0)], "path string, vad_idx int, start double, end double")
    rel = spark.createDataFrame([], "vendor_id string, session_id string, relationship string, relationship_detail string")
    assert {(r.check, r.key, r.detail) for r in natural.natural_violations(dyads, words, vad).collect()} == {("recording", "a/y.json", "missing"), ("interval", "a/x.json|0", "inverted"), ("interval", "a/x.json|1", "null bound")}
    assert natural.natural_pairs(dyads, words, segments, vad, rel).count() == 0
    with pytest.raises(ValueError, match="a/y.json"):
        natural.natural_pairs(dyads, words, segments, vad, rel, strict=True)


def test_frames_of_overlapping_segments(spark):
    frames = spark.createDataFrame([(p, t / 4, float(t)) for p in "ab" for t in range(400)], "path string, time double, f0 double")
    rows = [(i, "ab"[i % 2], i * 1.7, i * 1.7 + (i % 16)) for i in range(60)]
    segments = spark.createDataFrame(rows, "segment_id int, path string, start double, end double")
    got = {(r.segment_id, r.time) for r in pitch.frames_in_segments(frames, segments).collect()}
    assert got == {(i, t / 4) for i, _, a, b in rows for t in range(400) if a <= t / 4 < b}
    met = pitch.frames_in_segments(frames, segments, bucket=3.0)
    assert met.columns == ["path", "time", "f0", "segment_id", "start", "end"] and {(r.segment_id, r.time) for r in met.select("segment_id", F.col("time")).collect()} == got
