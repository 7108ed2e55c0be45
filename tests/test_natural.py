import json

from dyadspark import constants as C
from dyadspark.plans.natural import natural_pairs
from dyadspark.sources import tables


def recording(segments):
    out = {"metadata:transcript": [], "metadata:vad": []}
    for start, end, said in segments:
        words = said.split()
        step = (end - start) / len(words)
        out["metadata:transcript"].append({"transcript": said, "words": [{"word": w, "start": start + i * step, "end": start + (i + 1) * step} for i, w in enumerate(words)]})
        out["metadata:vad"].append({"start": start, "end": end})
    return json.dumps(out)


def test_from_files_to_pairs(spark, tmp_path):
    base = tmp_path / "train"
    base.mkdir()
    (base / "V1_S0002_I3_P7.json").write_text(recording([(0, 4, "one two three four five"), (9, 13, "nine ten eleven twelve")]))
    (base / "V1_S0002_I3_P8.json").write_text(recording([(4.5, 8.5, "what is it then")]))
    (tmp_path / "d.csv").write_text("participant1_id,participant1_relpath,participant2_id,participant2_relpath\n7,train/V1_S0002_I3_P7.wav,8,train/V1_S0002_I3_P8.wav\n")
    (tmp_path / "r.csv").write_text("vendor_id,session_id,relationship,relationship_detail\nV1,0002,friends,\n")
    dyads = tables.read_dyads(spark, str(tmp_path / "d.csv"))
    words, segments, vad = tables.read_recordings(spark, str(base / "*.json"))
    root = f"{tmp_path}/"
    frames = spark.createDataFrame([(f"{root}train/V1_S0002_I3_P7.wav", t / 2, 100.0 + t) for t in range(8)], "path string, time double, f0 double")
    out = natural_pairs(dyads, words, segments, vad, tables.read_relationships(spark, str(tmp_path / "r.csv")), frames=frames, root=root)
    assert out.columns[: len(C.PAIR_COLUMNS)] == C.PAIR_COLUMNS
    rows = out.orderBy("turn_index").collect()
    assert [(r.pair_id, r.latency_s, r.prompt_word_count) for r in rows] == [("3|P7|P8|0001", 0.5, 5), ("3|P8|P7|0002", 0.5, 4)]
    one, two = rows
    assert (one.session_id, one.dyad_id, one.relationship, one.relationship_detail, one.split) == ("0002", "P7|P8", "friends", "UNKNOWN", "train")
    assert one.prompt_speech_rate_local == 75 and one.status_prompt_prosody == "OK" and one.status_response_prosody == "NO_PITCH_FRAMES"
    assert two.status_prompt_prosody == "NO_PITCH_FRAMES" and one.source_json_path_prompt.endswith("P7.json")
    assert one.merge_key == "0002|3|P7|P8|P7|P8|1|0.0|4.0|4.5|8.5"


def test_pitch_of_pairs_does_not_compute_the_pairs_again(spark):
    from dyadspark.plans import files

    plan = files.natural_pairs_pitch(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "conversations" not in plan  # pairs and met frames come from stored tables
