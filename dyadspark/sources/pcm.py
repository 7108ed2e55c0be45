"""PCM files as a Spark data source: headers alone, or blocks of samples.

``spark.read.format("pcm").load(path)`` gives one row for each block of each file. The columns asked for with ``schema``
decide what is read: without ``block`` and ``samples`` there is one row for each file, and only its chunk headers are
read, however long the file or the chunks before its samples are. With them, a large file is parted by bytes among tasks, and
each seeks to its own blocks.

Files are opened by URI through Arrow (local, HDFS, S3, GCS). A file that cannot be opened has the status
AUDIO_LOAD_FAILED, one that is not PCM has AUDIO_DECODE_FAILED, and both have one row.
"""

from __future__ import annotations

import fnmatch
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_KINDS = {
    "path": T.StringType(), "sample_rate": T.IntegerType(), "channels": T.IntegerType(), "n_frames": T.LongType(), "duration_s": T.DoubleType(),
    "status": T.StringType(), "bytes_read": T.LongType(), "block": T.LongType(), "samples": T.ArrayType(T.FloatType()),
}


def _schema(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, _KINDS[n]) for n in names])


HEADER = _schema("path", "sample_rate", "channels", "n_frames", "duration_s", "status", "bytes_read")
FULL = _schema(*_KINDS)
#: Format tags of plain and of extensible PCM.
_PLAIN, _EXTENSIBLE = 0x0001, 0xFFFE


class NotPcm(ValueError):
    pass


@dataclass
class Header:
    rate: int
    channels: int
    width: int
    begin: int
    n_frames: int


class Counting:
    """Reads of a file at given places, and how many bytes they took."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size, self.read = file, file.size(), 0

    def at(self, offset: int, n: int) -> bytes:
        got = self.file.read_at(max(0, min(n, self.size - offset)), offset) if offset < self.size else b""
        self.read += len(got)
        return got


def header_of(source: Counting) -> Header:
    """From chunk to chunk up to the samples; what other chunks hold is not read."""
    head = source.at(0, 12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise NotPcm
    offset, form = 12, None
    while True:
        chunk = source.at(offset, 8)
        if len(chunk) < 8:
            raise NotPcm
        name, size = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"fmt ":
            form = source.at(offset + 8, min(size, 40))
        if name == b"data":
            break
        offset += 8 + size + size % 2
    if form is None or len(form) < 16:
        raise NotPcm
    tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if tag == _EXTENSIBLE and len(form) >= 26:
        tag = struct.unpack("<H", form[24:26])[0]
    width = (bits + 7) // 8
    if tag != _PLAIN or not channels or not rate or width not in (1, 2, 3, 4):
        raise NotPcm
    begin = offset + 8
    return Header(rate, channels, width, begin, max(0, min(size, source.size - begin)) // (width * channels))


def decoded(raw: bytes, width: int, channels: int) -> np.ndarray:
    """Mono samples between -1 and 1: the mean of the channels."""
    if width == 1:  # unsigned: the middle is silence
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((b[:, 0] << 8) | (b[:, 1] << 16) | (b[:, 2] << 24)) >> 8).astype(np.float32) / (1 << 23)
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / float(1 << (8 * width - 1))
    return x.reshape(-1, channels).mean(axis=1)


@dataclass
class Part(InputPartition):
    """Byte ranges of files: ``(uri, first byte, end)``."""

    ranges: list[tuple[str, int, int]]


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> T.StructType:
        return FULL

    def reader(self, schema: T.StructType) -> PcmReader:
        return PcmReader(schema, self.options)


class PcmReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        wrong = [f.name for f in schema if f.name not in _KINDS or f.dataType != _KINDS[f.name]]
        if wrong:
            raise ValueError(f"no such columns in PCM files: {', '.join(wrong)}")
        self.names = schema.names
        self.path = options["path"]
        self.block = int(options.get("block", 1 << 18))
        self.part_bytes = int(options.get("partBytes", 64 << 20))
        self.blocks = bool({"block", "samples"} & set(self.names))

    def partitions(self) -> list[Part]:
        """Small files together, large ones in byte ranges; without samples a task has the headers of many files."""
        parts, held = [Part([])], 0
        for uri, size in listed(self.path):
            step = self.part_bytes if self.blocks else max(size, 1)
            for a in range(0, max(size, 1), step):
                cost = min(step, size - a) if self.blocks else 1 << 18
                if parts[-1].ranges and held + cost > self.part_bytes:
                    parts.append(Part([]))
                    held = 0
                parts[-1].ranges.append((uri, a, min(a + step, size) if a + step < size else 1 << 62))
                held += cost
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for uri, low, high in partition.ranges:
            first = low == 0
            facts: dict = {"path": uri}
            try:
                files, path = _opened(uri)
                with files.open_input_file(path) as file:
                    source = Counting(file)
                    h = header_of(source)
                    facts |= {"sample_rate": h.rate, "channels": h.channels, "n_frames": h.n_frames, "duration_s": h.n_frames / h.rate, "status": "OK"}
                    if not self.blocks:
                        yield self._row(facts | {"bytes_read": source.read})
                        continue
                    frame = h.width * h.channels
                    size = self.block * frame
                    if first and not h.n_frames:
                        yield self._row(facts | {"bytes_read": source.read, "block": 0, "samples": []})
                    # the blocks that begin in this range
                    for b in range(max(0, -(-(low - h.begin) // size)), -(-h.n_frames // self.block)):
                        begin = h.begin + b * size
                        if begin >= high:
                            break
                        x = decoded(source.at(begin, min(self.block, h.n_frames - b * self.block) * frame), h.width, h.channels) if "samples" in self.names else None
                        yield self._row(facts | {"bytes_read": source.read, "block": b, "samples": x})
            except (NotPcm, OSError) as error:
                if first:
                    yield self._row(facts | {"status": "AUDIO_DECODE_FAILED" if isinstance(error, NotPcm) else "AUDIO_LOAD_FAILED"})

    def _row(self, facts: dict) -> pa.RecordBatch:
        kinds = {"path": pa.string(), "status": pa.string(), "sample_rate": pa.int32(), "channels": pa.int32(), "duration_s": pa.float64(), "samples": pa.list_(pa.float32())}
        return pa.RecordBatch.from_arrays([pa.array([facts.get(n)], kinds.get(n, pa.int64())) for n in self.names], self.names)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    plain = re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "/", path))
    return fs.FileSystem.from_uri(plain if re.match(r"^\w[\w+.-]*:", plain) else f"file://{plain}")


def write_file(path: str, content: bytes) -> None:
    """A whole file at once: it has its name only when it is complete, so a task that runs twice leaves one."""
    files, to = _opened(path)
    folder, name = to.rsplit("/", 1)
    files.create_dir(folder, recursive=True)
    part = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as out:
        out.write(content)
    files.move(part, to)


def make_folder(path: str) -> None:
    files, to = _opened(path)
    files.create_dir(to, recursive=True)


def subfolders(root: str) -> list[str]:
    files, base = _opened(root)
    return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(base)) if i.type == fs.FileType.Directory)


def names_below(folder: str) -> list[str]:
    """The files under a folder, by their paths from it."""
    files, base = _opened(folder)
    return sorted(i.path[len(base.rstrip("/")) + 1 :] for i in files.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File)


def listed(path: str) -> list[tuple[str, int]]:
    """``(uri, bytes)`` of a file, of the files under a folder, or of those that a glob names; hidden names are left out."""
    files, base = _opened(path)
    scheme = path[: len(path) - len(base)] if re.match(r"^(?!file:)\w[\w+.-]*:", path) and path.endswith(base) else ""
    parts = base.split("/")
    wild = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), None)
    top = base if wild is None else "/".join(parts[:wild])
    one = files.get_file_info(top)
    if one.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [one] if one.type == fs.FileType.File else files.get_file_info(fs.FileSelector(top, recursive=True))
    out = []
    for info in found:
        names = info.path.split("/")
        below = names[len(top.rstrip("/").split("/")) :]
        hidden = any(n.startswith(("_", ".")) for n in below)
        fits = wild is None or (len(names) >= len(parts) and all(fnmatch.fnmatchcase(n, p) for n, p in zip(names, parts, strict=False)))
        if info.type == fs.FileType.File and not hidden and fits and (wild is None or len(names) == len(parts)):
            out.append((scheme + info.path, info.size))
    return sorted(out)


def tops(path: str) -> tuple[list[str], str]:
    """What the first wildcard of a glob names, and the rest of the glob below it, which tasks may follow."""
    files, base = _opened(path)
    parts = base.split("/")
    wild = next((i for i, p in enumerate(parts) if re.search(r"[*?\[]", p)), None)
    scheme = path[: len(path) - len(base)] if re.match(r"^(?!file:)\w[\w+.-]*:", path) and path.endswith(base) else ""
    if wild is None:
        return [path], ""
    kinds = (fs.FileType.Directory,) if wild + 1 < len(parts) else (fs.FileType.File,)
    found = files.get_file_info(fs.FileSelector("/".join(parts[:wild]) or "/"))
    return sorted(scheme + i.path for i in found if i.type in kinds and _fits(i.base_name, parts[wild])), "/".join(parts[wild + 1 :])


def _fits(name: str, pattern: str) -> bool:
    return not name.startswith(("_", ".")) and fnmatch.fnmatchcase(name, pattern)


def contents(top: str, below: str) -> Iterator[tuple[str, bytes]]:
    """``(path, bytes)`` of the files that a glob names below ``top``; of ``top`` itself, or of what it holds, without one."""
    files, base = _opened(top)
    scheme = top[: len(top) - len(base)] if re.match(r"^(?!file:)\w[\w+.-]*:", top) and top.endswith(base) else ""
    found = [files.get_file_info(base)]
    if not below and found[0].type == fs.FileType.Directory:
        below = "*"
    for depth, pattern in enumerate(below.split("/") if below else [], 1):
        kind = fs.FileType.File if depth == below.count("/") + 1 else fs.FileType.Directory
        found = [i for f in found for i in files.get_file_info(fs.FileSelector(f.path)) if i.type == kind and _fits(i.base_name, pattern)]
    for info in sorted(found, key=lambda i: i.path):
        with files.open_input_stream(info.path, compression=None) as file:
            yield scheme + info.path, file.read()


def _read(spark: SparkSession, path: str, schema: T.StructType, **options: int) -> DataFrame:
    spark.dataSource.register(PcmSource)
    return spark.read.format("pcm").schema(schema).options(**options).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file, from its chunk headers alone."""
    return _read(spark, path, HEADER)


def audio_blocks(spark: SparkSession, path: str, block: int = 1 << 18, **options: int) -> tuple[DataFrame, DataFrame]:
    """``(blocks, recordings)`` as :mod:`dyadspark.operators.blocks` takes them: samples of readable files, and all headers."""
    own = _read(spark, path, _schema("path", "status", "block", "samples"), block=block, **options)
    return own.where("status = 'OK' AND size(samples) > 0").select("path", "block", "samples"), headers(spark, path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """Headers with all samples of each file as one array, for files known to be short."""
    blocks, known = audio_blocks(spark, path)
    whole = blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "samples"))).alias("b")).select("path", F.flatten("b.samples").alias("samples"))
    return known.join(whole, "path", "left")
