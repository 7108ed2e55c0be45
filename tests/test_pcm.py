import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadspark.operators import blocks
from dyadspark.sources import pcm, tables


def put(path, samples, rate=8000, channels=1, width=2, junk=0):
    """A PCM file, with a chunk of ``junk`` bytes before its format."""
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).tobytes())
    if junk:
        raw = path.read_bytes()
        path.write_bytes(raw[:12] + b"LIST" + struct.pack("<I", junk) + b"x" * (junk + junk % 2) + raw[12:])


def test_headers_read_no_samples_and_no_prefix(spark, tmp_path):
    put(tmp_path / "a/long.wav", np.zeros(2_000_000), junk=3 << 20)
    put(tmp_path / "a/short.wav", [1, 2, 3, 4], channels=2, rate=16000)
    put(tmp_path / "a/none.wav", [])
    (tmp_path / "a/bad.wav").write_bytes(b"RIFFnot really")
    (tmp_path / "a/float.wav").write_bytes((tmp_path / "a/short.wav").read_bytes().replace(b"fmt \x10\0\0\0\x01\0", b"fmt \x10\0\0\0\x03\0"))
    (tmp_path / "a/_hidden.wav").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[-1]: (r.sample_rate, r.channels, r.n_frames, r.status, r.bytes_read) for r in pcm.headers(spark, f"{tmp_path}/a").collect()}
    assert got == {"long.wav": (8000, 1, 2_000_000, "OK", 52), "short.wav": (16000, 2, 2, "OK", 44), "none.wav": (8000, 1, 0, "OK", 44), "bad.wav": (None, None, None, "AUDIO_DECODE_FAILED", None), "float.wav": (None, None, None, "AUDIO_DECODE_FAILED", None)}
    catalog = tables.audio_catalog(spark, f"{tmp_path}/*/long.wav").collect()
    assert [(r.n_frames, r.duration_s) for r in catalog] == [(2_000_000, 250.0)]


def test_blocks_of_large_files_in_several_tasks(spark, tmp_path):
    rng = np.random.default_rng(0)
    given = {f"r{i}.wav": rng.integers(-30000, 30000, n) for i, n in enumerate((0, 1, 999, 1000, 1001, 54_321))}
    for name, x in given.items():
        put(tmp_path / name, x, junk=777)
    own, known = pcm.audio_blocks(spark, f"file://{tmp_path}/*.wav", 1000, partBytes=10_007)
    assert own.rdd.getNumPartitions() > 8
    found = {}
    for r in own.orderBy("path", "block").collect():
        name = r.path.rsplit("/", 1)[-1]
        assert len(found.get(name, [])) == r.block * 1000 and len(r.samples) <= 1000
        found.setdefault(name, []).extend(r.samples)
    assert {k: (np.array(v) * 32768).round().astype(int).tolist() for k, v in found.items()} == {k: x.tolist() for k, x in given.items() if len(x)}
    # clips of a file by its blocks alone
    segments = own.select("path").distinct().where(F.col("path").endswith("r5.wav")).select(F.lit(1).alias("segment_id"), "path", F.lit(0.1).alias("start"), F.lit(5.0).alias("end"))
    clip = blocks.clips(segments, own, known, 1000).first()
    assert clip.status == "OK" and (np.array(clip.samples) * 32768).round().astype(int).tolist() == given["r5.wav"][800:40_000].tolist()


def test_columns_asked_for_and_lost_files(spark, tmp_path):
    put(tmp_path / "a.wav", [100, -100, 300, -300], channels=2)
    put(tmp_path / "b.wav", [0, 255, 128], width=1)
    spark.dataSource.register(pcm.PcmSource)
    own = spark.read.format("pcm").load(str(tmp_path)).orderBy("path").collect()
    assert [(r.block, [round(x, 3) for x in r.samples]) for r in own] == [(0, [0.0, 0.0]), (0, [-1.0, 0.992, 0.0])]
    one = spark.read.format("pcm").schema("n_frames long, path string").load(str(tmp_path))
    assert one.columns == ["n_frames", "path"] and {r.n_frames for r in one.collect()} == {2, 3}
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("pcm").schema("volume double").load(str(tmp_path)).collect()
    reader = pcm.PcmReader(spark.read.format("pcm").load(str(tmp_path)).schema, {"path": str(tmp_path)})
    assert [b.column("status")[0].as_py() for b in reader.read(pcm.Part([(f"{tmp_path}/gone.wav", 0, 9), (f"{tmp_path}/gone.wav", 9, 99)]))] == ["AUDIO_LOAD_FAILED"]
