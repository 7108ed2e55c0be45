import json
import struct
import wave

import pytest
from pyspark.sql import functions as F

from dyadspark.operators import quality
from dyadspark.sources import tables


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_dyads_and_relationships(spark, tmp_path):
    put(tmp_path / "d.csv", "participant1_id,participant1_relpath,participant2_id,participant2_relpath\nP7,x/train/V1_S0002_I3_P7.wav,8,x/train/V1_S0002_I3_P8.wav\n9,x/dev/test/V1_S1_I4_P9.wav,10,x/test/V2_S1_I4_P10.wav\n")
    rows = {r.participant1_id: r for r in tables.read_dyads(spark, str(tmp_path / "d.csv")).collect()}
    assert (rows["P7"].dyad_id, rows["P7"].session_id, rows["P7"].split, rows["P7"].p2_participant) == ("P7|P8", "0002", "train", "8")
    assert rows["P9"].p1_source_split is None and rows["P9"].split is None
    bad = quality.dyads_consistent(tables.read_dyads(spark, str(tmp_path / "d.csv"))).collect()
    assert [(r.key, r.detail) for r in bad] == [("4", "vendor,source_split")]
    put(tmp_path / "r.csv", "relationship,vendor_id,session_id,relationship_detail\na,v,1,x\nb,v,2,y\n c ,v,1, z \n")
    got = {r.session_id: (r.relationship, r.relationship_detail) for r in tables.read_relationships(spark, str(tmp_path / "r.csv")).collect()}
    assert got == {"1": ("c", "z"), "2": ("b", "y")}


def test_recordings(spark, tmp_path):
    doc = {"metadata:transcript": [{"transcript": "hi you", "words": [{"word": "hi", "start": 0.5, "end": 1}, {"word": "you", "start": None, "end": 2}]}, {"transcript": "", "words": []}], "metadata:vad": [{"start": 0.4, "end": 1.1}]}
    put(tmp_path / "a.json", json.dumps(doc, indent=1))
    put(tmp_path / "b.json", "{}")
    words, segments, vad = tables.read_recordings(spark, str(tmp_path / "*.json"))
    assert [(r.seg_idx, r.word_idx, r.word, r.start) for r in words.orderBy("word_idx").collect()] == [(0, 0, "hi", 0.5), (0, 1, "you", None)]
    assert segments.count() == 2 and vad.count() == 1


def test_recordings_say_what_is_wrong(spark, tmp_path):
    words = [{"word": "hi", "start": 0.5, "end": 1}, {"word": "you", "start": "soon", "end": 2}, {"word": "all", "start": None, "end": 2}, {"word": "two", "start": [1], "end": {"x": 1}}]
    good = {"metadata:transcript": [{"transcript": "hi you", "words": words[:1]}], "metadata:vad": [{"start": 0.4, "end": 1.1}]}
    put(tmp_path / "good.json", json.dumps(good))
    put(tmp_path / "cut.json", json.dumps(good)[:-20])
    put(tmp_path / "empty.json", "")
    put(tmp_path / "list.json", json.dumps(good | {"metadata:transcript": "none"}))
    put(tmp_path / "types.json", json.dumps(good | {"metadata:transcript": [{"words": words[:1]}, {"transcript": "", "words": words}]}))
    put(tmp_path / "bare.json", "{}")
    put(tmp_path / "vad.json", json.dumps(good | {"metadata:vad": [{"start": 2, "end": 1}, {"start": None, "end": 1}, {"start": "x", "end": 1}, {"start": 1, "end": 1}]}))
    found = tables.recordings(spark, str(tmp_path / "*.json"))
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    got = {(r.file, r.reason, r.place) for r in found.violations.select(name, "reason", "place").collect()}
    assert got == {
        ("cut.json", "BROKEN_DOCUMENT", None), ("empty.json", "BROKEN_DOCUMENT", None), ("list.json", "BROKEN_DOCUMENT", None),
        ("types.json", "WRONG_TYPE", "segment 1 word 1: start"), ("types.json", "WRONG_TYPE", "segment 1 word 3: start, end"),
        ("bare.json", "MISSING_FIELD", "metadata:transcript"), ("bare.json", "MISSING_FIELD", "metadata:vad"),
        ("vad.json", "INVERTED_BOUND", "vad 0"), ("vad.json", "NULL_BOUND", "vad 1"), ("vad.json", "WRONG_TYPE", "vad 2"),
    }
    assert {r.file: r["count"] for r in found.words.groupBy(name).count().collect()} == {"good.json": 1, "types.json": 5, "vad.json": 1}
    assert found.vad.where(F.col("start").isNotNull()).count() == 4
    # the documents are read once, however many of the four are used
    plan = found.words.unionByName(found.vad, allowMissingColumns=True)._jdf.queryExecution().toString()
    assert "json" not in plan.lower().replace(".json", "")
    put(tmp_path / "l/all.jsonl", "\n".join([json.dumps(good | {"path": "a"}), json.dumps(good | {"path": "b"})[:-9], json.dumps({"path": "c", "metadata:vad": []})]))
    lines = tables.recordings(spark, str(tmp_path / "l"), lines=True)
    assert {(r.path[-9:], r.reason) for r in lines.violations.collect()} == {("all.jsonl", "BROKEN_DOCUMENT"), ("c", "MISSING_FIELD")}
    assert [r.path for r in lines.words.collect()] == ["a"]


def test_partitioned_metadata_and_transcripts(spark, tmp_path):
    put(tmp_path / "inputs/test/calm/metadata.csv", "audio_path,transcript_question\nq/a_1.wav,Hello\n")
    put(tmp_path / "outputs/m1/test/calm/metadata.csv", 'audio_path,answer_audio_path,transcript_answer\nq/a_1.wav,r/a.wav,"two\nlines"\n')
    one = tables.read_partitioned_metadata(spark, str(tmp_path), "inputs").first()
    assert (one.split, one.source_style, one.transcript_question, one.speakers) == ("test", "calm", "Hello", None)
    two = tables.read_partitioned_metadata(spark, str(tmp_path), "outputs").first()
    assert (two.model_name, two.split, two.transcript_answer) == ("m1", "test", "two\nlines")
    assert tables.read_asr_transcripts(spark, str(tmp_path)).count() == 0
    put(tmp_path / "outputs/m1/test/calm/large_transcripts.csv", "answer_audio_path,ASR_transcript_answer\nr/a.wav,heard\n")
    assert tables.read_asr_transcripts(spark, str(tmp_path)).first().ASR_transcript_answer == "heard"


@pytest.mark.parametrize(("width", "pack", "low", "high"), [(1, "B", 0, 255), (2, "h", -32768, 32767), (4, "i", -(1 << 31), (1 << 31) - 1)])
def test_audio(spark, tmp_path, width, pack, low, high):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(width)
        w.setframerate(8)
        w.writeframes(struct.pack(f"<4{pack}", low, low, high, low))
    (tmp_path / "b.wav").write_bytes(b"RIFFnot really")
    rows = {r.path[-5:]: r for r in tables.audio_catalog(spark, str(tmp_path / "*.wav"), samples=True).collect()}
    a = rows["a.wav"]
    assert (a.sample_rate, a.n_frames, a.duration_s, a.status) == (8, 2, 0.25, "OK")
    assert a.samples[0] == -1.0 and abs(a.samples[1]) < 0.01
    assert rows["b.wav"].status == "AUDIO_DECODE_FAILED" and rows["b.wav"].duration_s is None
    assert tables.audio_catalog(spark, str(tmp_path / "a.wav")).columns == ["path", "sample_rate", "n_frames", "duration_s", "status"]


def test_shards(spark, tmp_path):
    for name in ("x_shard_0", "x_shard_2", "y_shard_2", "x_shard_9", "notes"):
        put(tmp_path / f"{name}.csv", f"a,b\n{name},1\n")
    rows, files = tables.read_shards(spark, str(tmp_path / "*.csv"), ["a", "b"])
    assert rows.count() == 5 and {r.shard for r in rows.collect()} == {0, 2, 9, None}
    found = {(r.key, r.detail) for r in quality.shards_complete(files, 4).collect()}
    assert found == {("", "unindexed"), ("2", "duplicate"), ("1", "missing"), ("3", "missing"), ("9", "extra")}
    assert quality.shards_complete(files, 0).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        quality.fail_on_violation(quality.shards_complete(files, 4).where("detail = 'duplicate'"))
    put(tmp_path / "z_shard_5.csv", "b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_shards(spark, str(tmp_path / "*.csv"), ["a", "b"])[0].collect()


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("k1", "prompt", 1), ("k2", "prompt", 2)], "merge_key string, role string, v int")
    where = str(tmp_path / "e")
    tables.write_embeddings(df, where)
    tables.write_embeddings(df.withColumn("v", F.lit(9)).unionByName(spark.createDataFrame([("k3", "prompt", 3)], df.schema)), where)
    assert {(r.merge_key, r.v) for r in spark.read.parquet(where).collect()} == {("k1", 1), ("k2", 2), ("k3", 3)}
    tables.write_pairs(df.withColumn("split", F.lit("test")), str(tmp_path / "p"), ["v", "merge_key", "split"])
    assert spark.read.parquet(str(tmp_path / "p" / "split=test")).columns == ["v", "merge_key"]


def test_schema_checks(spark):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert {(r.key, r.detail) for r in quality.schema(df, ["x", "z"], exact=True).collect()} == {("z", "missing"), ("y", "unexpected")}
    assert quality.not_empty(df, "t").count() == 0 and quality.not_empty(df.limit(0), "t").count() == 1
