"""Many small files: the driver lists what the first wildcard names, tasks read the rest, and none of them many at once."""

import json

from pyspark.sql import functions as F

from dyadspark.plans import files
from dyadspark.sources import pcm, tables


def _doc(n):
    return {"metadata:transcript": [{"transcript": "", "words": [{"word": f"w{i}", "start": i, "end": i + 1} for i in range(n)]}], "metadata:vad": [{"start": 0, "end": n}]}


def test_recordings_are_read_below_what_the_driver_lists(spark, tmp_path):
    for i in range(60):
        folder = tmp_path / f"interaction={i % 3}" / f"participant=P{i}"
        folder.mkdir(parents=True)
        (folder / "r.json").write_bytes(json.dumps(_doc(i)).encode("utf-16" if i == 1 else "utf-8-sig" if i == 2 else "utf-8"))
    odd = {"list": b"[" + json.dumps(_doc(2)).encode() + b"," + json.dumps(_doc(3)).encode() + b"]", "empty": b"", "bytes": b'{"metadata:vad": [], "x": "\xff\xfe"}', "cut": json.dumps(_doc(4)).encode()[:-9]}
    for name, content in odd.items():
        (tmp_path / "odd" / name).mkdir(parents=True)
        (tmp_path / "odd" / name / "r.json").write_bytes(content)
    glob = f"{tmp_path}/*/*/*.json"
    top, below = pcm.tops(glob)
    assert len(top) == 4 and below == "*/*.json"
    found = tables.recordings(spark, glob)
    assert found.words.count() == sum(range(60)) + 5
    got = {r.k: r.n for r in found.words.groupBy(F.regexp_extract("path", "participant=P([0-9]+)/", 1).alias("k")).agg(F.count("*").alias("n")).collect()}
    assert got == {str(i): i for i in range(1, 60)} | {"": 5}
    bad = sorted((r.path.split("/")[-2], r.reason) for r in found.violations.collect())
    assert bad == [("bytes", "BROKEN_DOCUMENT"), ("cut", "BROKEN_DOCUMENT"), ("empty", "BROKEN_DOCUMENT")]


def test_item_metadata_by_its_own_header(spark, tmp_path):
    for name, text in {"a": "spk,tts_model\nA,x\n\n\"B\nC\",\n", "b": "﻿tts_model,other,spk\ny,1,A\nz\n", "c": ""}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "metadata.csv").write_text(text)
    got = sorted(map(tuple, tables.read_item_metadata(spark, str(tmp_path)).collect()), key=lambda r: (r[0], r[3]))
    assert got == [("a", "A", "x", 0), ("a", "B\nC", None, 1), ("b", "A", "y", 0), ("b", None, "z", 1)]


def test_tasks_that_write_folders_grow_with_the_conversations(spark, tmp_path):
    spark.range(6000).select((F.col("id") % 3000).alias("conv_id")).write.parquet(f"{tmp_path}/conversations.parquet")
    assert 20 <= files._parts(spark, str(tmp_path)) <= 40
