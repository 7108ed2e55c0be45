"""Readers and writers. Every reader states its schema; nothing is inferred."""

from __future__ import annotations

import csv
import io
import json
import re
import uuid
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dyadspark.functions import text
from dyadspark.operators.checkpoints import stored
from dyadspark.operators.pairs import last_wins
from dyadspark.sources import commits
from dyadspark.sources.pcm import Counting, NotPcm, contents, decoded, header_of, headers, names_below, subfolders, tops, whole_files

_strings = lambda *names: T.StructType([T.StructField(n, T.StringType()) for n in names])
DYADS = _strings("participant1_id", "participant1_relpath", "participant2_id", "participant2_relpath")
RELATIONSHIPS = _strings("vendor_id", "session_id", "relationship", "relationship_detail")
INPUTS = _strings("audio_path", "transcript_question", "speakers", "conversation_id")
OUTPUTS = _strings("audio_path", "answer_audio_path", "transcript_question", "transcript_answer", "speakers", "conversation_id", "finish_reason", "answer_start_time")
ASR = _strings("answer_audio_path", "ASR_transcript_answer")
#: Times are read as text, so that a value of a wrong type is seen and not lost.
RECORDING = (
    "`metadata:transcript` array<struct<transcript: string, words: array<struct<word: string, start: string, end: string>>>>, "
    "`metadata:vad` array<struct<start: string, end: string>>, _broken string"
)


class Recordings(NamedTuple):
    """Rows of recording documents, keyed by ``path``, and what is wrong with them: ``(path, reason, place)``."""

    words: DataFrame
    segments: DataFrame
    vad: DataFrame
    violations: DataFrame


def _headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files under each header. One row for each file reaches the driver, as its list of input files does anyway."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("at"))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in lines.groupBy("file").agg(F.min_by("value", "at").alias("header")).orderBy("file").collect():
        found.setdefault(tuple(next(csv.reader([r.header.removeprefix("\ufeff")]))), []).append(re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(r.file)))
    return found


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header-driven CSV: every file's columns are found by the names in its own header, absent ones are null.

    Files with equal headers are read together. A header is one line; files without a line have no rows.
    """
    parts = []
    for names, files in _headers(spark, path).items():
        # equal names in one header: the last one counts
        place = {name: f"_c{i}" for i, name in enumerate(names)}
        raw = spark.read.schema(_strings(*[f"_c{i}" for i in range(len(names))])).option("header", True).option("multiLine", True).option("escape", '"').csv(files)
        parts.append(raw.select(*[(F.col(place[f.name]) if f.name in place else F.lit(None).cast("string")).alias(f.name) for f in schema], F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_row")))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("_file", T.StringType()), T.StructField("_row", T.LongType())]))
    return reduce(DataFrame.unionByName, parts)


def plain_path(path: Column) -> Column:
    """Local paths without their scheme, which readers write in different ways; others as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def read_dyads(spark: SparkSession, path: str) -> DataFrame:
    """Participants with canonical ids, parsed names and source split; one row for each interaction."""
    out = _csv(spark, path, DYADS).drop("_file", "_row")
    for n in (1, 2):
        where = F.col(f"participant{n}_relpath")
        name = text.parse_stem(text.stem_of(where))
        out = out.withColumn(f"participant{n}_id", text.canonical_participant_id(F.col(f"participant{n}_id")))
        out = out.withColumn(f"_n{n}", name).withColumns({f"p{n}_{c}": F.col(f"_n{n}.{c}") for c in ("vendor", "session", "interaction", "participant")}).withColumn(f"p{n}_source_split", text.source_dataset_split(where)).drop(f"_n{n}")
    return out.withColumn("dyad_id", text.dyad_id(F.col("participant1_id"), F.col("participant2_id"))).withColumn("split", text.split_of(F.col("p1_source_split"))).withColumn("interaction_id", F.col("p1_interaction")).withColumn("session_id", F.col("p1_session"))


def read_relationships(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ``(vendor_id, session_id)``; the last one of a key wins."""
    rows = _csv(spark, path, RELATIONSHIPS)
    trimmed = rows.select(*[F.trim(c).alias(c) for c in ("vendor_id", "session_id", "relationship")], F.trim("relationship_detail").alias("relationship_detail"), "_file", "_row")
    return last_wins(trimmed, ["vendor_id", "session_id"], ["_file", "_row"]).drop("_file", "_row")


def _problem(reason: str, place: Column) -> Column:
    return F.struct(F.lit(reason).alias("reason"), place.alias("place"))


def _not_number(value: Column) -> Column:
    return value.isNotNull() & value.try_cast("double").isNull()


def _word_problems(segments: Column) -> Column:
    """One entry for each word whose start or end is there but no number."""

    def word(i):
        def of(w, j):
            bad = F.concat_ws(", ", *[F.when(_not_number(w[c]), F.lit(c)) for c in ("start", "end")])
            return F.when(bad != "", _problem("WRONG_TYPE", F.format_string("segment %d word %d: %s", i, j, bad)))

        return of

    each = F.transform(segments, lambda s, i: F.filter(F.transform(F.coalesce(s["words"], F.array()), word(i)), lambda x: x.isNotNull()))
    return F.flatten(each)


def _vad_problems(vad: Column) -> Column:
    """One entry for each interval with a bound that is null or no number, or with its end before its start."""

    def of(v, i):
        a, b = v["start"], v["end"]
        reason = F.when(a.isNull() | b.isNull(), "NULL_BOUND").when(_not_number(a) | _not_number(b), "WRONG_TYPE").when(b.try_cast("double") < a.try_cast("double"), "INVERTED_BOUND")
        return F.struct(reason.alias("reason"), F.format_string("vad %d", i).alias("place"))

    return F.filter(F.transform(vad, of), lambda x: x["reason"].isNotNull())


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(path, value)``: every file that a glob names, as one text; null where it cannot be decoded.

    The driver lists what the first wildcard names, tasks list and read what is below, so its work does not grow with
    the files in these folders. Batches have a few MB.
    """
    found, below = tops(path)
    if not found:
        raise FileNotFoundError(path)

    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for top in batch.column("top").to_pylist():
                for where, content in contents(top, below):
                    try:
                        rows.append((re.sub("^file:/+", "/", where), content.decode(json.detect_encoding(content))))
                    except UnicodeDecodeError:
                        rows.append((re.sub("^file:/+", "/", where), None))
                    held += len(content)
                    if held > 4 << 20:
                        yield _texts(rows)
                        rows, held = [], 0
            yield _texts(rows)

    return spark.createDataFrame(pa.table({"top": pa.array(found, pa.string())})).repartition(max(1, len(found) // 128)).mapInArrow(run, "path string, value string")


def _texts(rows: list[tuple[str, str | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["path", "value"])


def parse_recordings(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """One row for each document: ``path``, ``segments``, ``vad`` and ``problems``, parsed once and stored.

    A document that is broken, or whose parts have a wrong shape, is rejected whole: it keeps a row with its problem and
    nothing else. An empty file counts as broken. Missing fields are problems too, the others stay. With ``lines`` every line
    is a document, and its field ``path`` names it (its file, where that cannot be read).
    """
    if lines:
        raw = spark.read.schema(RECORDING + ", path string").option("columnNameOfCorruptRecord", "_broken").json(path)
        raw = raw.withColumn("path", F.coalesce("path", plain_path(F.col("_metadata.file_path")))).withColumn("_broken", F.col("_broken").isNotNull())
    else:
        # a document may stand in an array, as Spark's reader allows too
        listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", "array<string>"))
        docs = whole_texts(spark, path).select("path", F.explode_outer(F.coalesce(listed, F.array("value"))).alias("value"))
        raw = docs.select("path", F.from_json("value", RECORDING, {"columnNameOfCorruptRecord": "_broken"}).alias("d"))
        raw = raw.select("path", "d.*", (F.col("d").isNull() | F.col("d._broken").isNotNull()).alias("_bad")).drop("_broken").withColumnRenamed("_bad", "_broken")
    raw = raw.withColumnsRenamed({"metadata:transcript": "t", "metadata:vad": "v"})
    broken = F.col("_broken")
    number = lambda x, *names: [x[c].try_cast("double").alias(c) for c in names]
    segments = F.transform("t", lambda s: F.struct(s["transcript"].alias("transcript"), F.transform(s["words"], lambda w: F.struct(w["word"].alias("word"), *number(w, "start", "end"))).alias("words")))
    vad = F.transform("v", lambda x: F.struct(*number(x, "start", "end")))
    none = F.array().cast("array<struct<reason: string, place: string>>")
    problems = F.when(broken, F.array(_problem("BROKEN_DOCUMENT", F.lit(None).cast("string")))).otherwise(
        F.concat(
            F.when(F.col("t").isNull(), F.array(_problem("MISSING_FIELD", F.lit("metadata:transcript")))).otherwise(_word_problems(F.col("t"))),
            F.when(F.col("v").isNull(), F.array(_problem("MISSING_FIELD", F.lit("metadata:vad")))).otherwise(_vad_problems(F.col("v"))),
        )
    )
    parsed = raw.select("path", F.when(~broken, segments).alias("segments"), F.when(~broken, vad).alias("vad"), F.coalesce(problems, none).alias("problems"))
    return stored(parsed)


def recordings(spark: SparkSession, path: str, *, lines: bool = False) -> Recordings:
    """Words, segments, voice activity and violations of recording documents, all from one parse.

    Words whose time is no number, and every interval, stay as rows with nulls there; the violations say which.
    """
    parsed = parse_recordings(spark, path, lines=lines)
    segments = parsed.select("path", F.posexplode("segments").alias("seg_idx", "s")).select("path", "seg_idx", F.col("s.transcript").alias("transcript"), F.col("s.words").alias("words"))
    words = segments.select("path", "seg_idx", F.posexplode("words").alias("word_idx", "w")).select("path", "seg_idx", "word_idx", "w.word", "w.start", "w.end")
    vad = parsed.select("path", F.posexplode("vad").alias("vad_idx", "v")).select("path", "vad_idx", "v.start", "v.end")
    violations = parsed.select("path", F.explode("problems").alias("p")).select("path", "p.reason", "p.place")
    return Recordings(words, segments.drop("words"), vad, violations)


def read_recordings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(words, segments, vad)`` of :func:`recordings`."""
    found = recordings(spark, path)
    return found.words, found.segments, found.vad


def read_partitioned_metadata(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """``inputs/<split>/<style>/metadata.csv`` or ``outputs/<model>/<split>/<style>/metadata.csv`` with columns from the path.

    ``metadata.csv`` may be a folder of part files, as Spark writes one.
    """
    if kind == "inputs":
        glob, pattern, names, schema = f"{root}/inputs/*/*/metadata.csv", r"/inputs/([^/]+)/([^/]+)/metadata\.csv(?:/[^/]+)?$", ("split", "source_style"), INPUTS
    else:
        glob, pattern, names, schema = f"{root}/outputs/*/*/*/metadata.csv", r"/outputs/([^/]+)/([^/]+)/([^/]+)/metadata\.csv(?:/[^/]+)?$", ("model_name", "split", "source_style"), OUTPUTS
    rows = _csv(spark, glob, schema)
    return rows.select(*[F.regexp_extract("_file", pattern, i + 1).alias(n) for i, n in enumerate(names)], *[f.name for f in schema], F.col("_file").alias("file"), F.col("_row").alias("row"))


def read_asr_transcripts(spark: SparkSession, root: str, name: str = "*_transcripts.csv") -> DataFrame:
    """Optional transcripts beside the outputs' metadata; no file means no rows."""
    pattern = r"/outputs/([^/]+)/([^/]+)/([^/]+)/[^/]+(?:/[^/]+)?$"
    names = ("model_name", "split", "source_style")
    try:
        rows = _csv(spark, f"{root}/outputs/*/*/*/{name}", ASR)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "model_name string, split string, source_style string, answer_audio_path string, ASR_transcript_answer string, file string, row long")
    return rows.select(*[F.regexp_extract("_file", pattern, i + 1).alias(n) for i, n in enumerate(names)], "answer_audio_path", "ASR_transcript_answer", F.col("_file").alias("file"), F.col("_row").alias("row"))


def _pcm(content: bytes, with_samples: bool):
    source = Counting(pa.BufferReader(content))
    h = header_of(source)
    raw = source.at(h.begin, h.n_frames * h.width * h.channels) if with_samples else None
    return h.rate, h.n_frames, None if raw is None else decoded(raw, h.width, h.channels)


def audio_catalog(spark: SparkSession, path: str, *, samples: bool = False) -> DataFrame:
    """:func:`decoded_audio` of the files under ``path``; without ``samples`` only their chunk headers are read."""
    names = ["path", "sample_rate", "n_frames", "duration_s", "status"]
    if not samples:
        return headers(spark, path).select(*names)
    none = F.when(F.col("status") == "OK", F.array().cast("array<float>"))
    return whole_files(spark, path).select(*names, F.coalesce("samples", none).alias("samples"))


def decoded_audio(files: DataFrame, *, samples: bool = False) -> DataFrame:
    """``(path, sample_rate, n_frames, duration_s, status[, samples])`` of PCM ``(path, content)``; mono is the mean of the channels."""
    schema = "path string, sample_rate int, n_frames long, duration_s double, status string" + (", samples array<float>" if samples else "")

    def run(frames):
        for frame in frames:
            rows = []
            for where, content in zip(frame["path"], frame["content"], strict=True):
                if content is None:
                    rows.append([where, None, None, None, "AUDIO_LOAD_FAILED", None][: 6 if samples else 5])
                    continue
                try:
                    rate, n, x = _pcm(content, samples)
                    rows.append([where, rate, n, n / rate, "OK", x][: 6 if samples else 5])
                except NotPcm:
                    rows.append([where, None, None, None, "AUDIO_DECODE_FAILED", None][: 6 if samples else 5])
            out = pd.DataFrame(rows, columns=["path", "sample_rate", "n_frames", "duration_s", "status", "samples"][: 6 if samples else 5])
            yield out.astype({"sample_rate": "Int32", "n_frames": "Int64"})

    return files.select("path", "content").mapInPandas(run, schema)


def item_files(spark: SparkSession, root: str) -> DataFrame:
    """``(row_dir, file_name)`` of every folder in ``root``, with a null name for the folder itself, so empty ones are seen.

    The driver lists the folders; what they hold is listed in tasks.
    """
    folders = spark.createDataFrame([(f,) for f in subfolders(root)], "row_dir string")

    def run(frames):
        for frame in frames:
            rows = [(d, name) for d in frame["row_dir"] for name in [None, *names_below(f"{root}/{d}")]]
            yield pd.DataFrame(rows, columns=["row_dir", "file_name"])

    return folders.repartition(max(1, min(200, folders.count() // 64)), "row_dir").mapInPandas(run, "row_dir string, file_name string")


def read_item_metadata(spark: SparkSession, root: str) -> DataFrame:
    """``(row_dir, spk, tts_model, row_order)`` of the metadata in every folder of ``root``."""
    schema = "row_dir string, spk string, tts_model string, row_order long"

    def run(batches):
        for batch in batches:
            rows = []
            for where, value in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if value is None:
                    raise ValueError(f"not a text: {where}")
                lines = csv.reader(io.StringIO(value, newline=""))
                place = {name: i for i, name in enumerate(next(lines, []))}  # equal names in one header: the last one counts
                for order, line in enumerate(line for line in lines if line):
                    at = [place.get(name, len(line)) for name in ("spk", "tts_model")]
                    rows.append((where.split("/")[-2], *[(line[i] or None) if i < len(line) else None for i in at], order))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["row_dir", "spk", "tts_model", "row_order"])

    return whole_texts(spark, f"{root}/*/metadata.csv").mapInArrow(run, schema)


def shard_index(file_name, prefix: str = ""):
    """The number in ``<prefix>_shard_<i>.csv``; null if the name has none."""
    pattern = rf"^{prefix}.*_shard_(\d+)\.[^.]+$"
    return F.when(file_name.rlike(pattern), F.regexp_extract(file_name, pattern, 1).cast("int"))


def read_shards(spark: SparkSession, path: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(rows, files)``: the union of shard files with their index, and one row for each file.

    ``columns`` is the header that every file must have: Spark raises at the first file whose header differs, and a
    file without one is refused here. ``rows`` in the order of the shards are ``rows.orderBy("shard", "at")``.
    """
    listed = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length")
    # Spark reads no row of an empty file, but lists it
    full = {r.file_name for r in listed.select("file_name").collect()}
    empty = sorted({unquote(f).rsplit("/", 1)[-1] for f in spark.read.format("binaryFile").load(path).inputFiles()} - full)
    if empty:
        raise ValueError(f"empty shard files: {', '.join(empty[:5])}")
    raw = spark.read.schema(_strings(*columns)).option("header", True).option("enforceSchema", False).csv(path)
    rows = raw.withColumn("shard", shard_index(F.col("_metadata.file_name"))).withColumn("at", F.monotonically_increasing_id())
    return rows, listed.withColumn("shard", shard_index(F.col("file_name")))


def write_pairs(df: DataFrame, path: str, columns: Sequence[str], *, split: str = "split") -> None:
    """Fixed column order, one folder for each split; the table has its name only when it is complete."""
    spark = df.sparkSession
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    try:
        df.select(*columns).write.partitionBy(split).parquet(staged)
        if not commits.rename_new(spark, staged, path):
            raise FileExistsError(path)
    finally:
        commits.delete(spark, staged)


def write_embeddings(df: DataFrame, path: str, keys: Sequence[str] = ("merge_key", "role")) -> None:
    """Append what is not there yet, as one commit (:mod:`commits`); rows that exist are not written again."""
    commits.append(df, path, keys)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all commits of :func:`write_embeddings`; an empty frame without columns where there are none."""
    found = commits.committed(spark, path)
    return spark.createDataFrame([], T.StructType([])) if found is None else found.drop("commit", "bucket")
