"""Tables that grow by whole commits: rows are staged apart and count from the moment their manifest has its name.

A table is a folder with ``data/commit=<id>/bucket=<n>/`` and ``_commits/<number>``. A run that fails leaves no manifest, so
nothing it wrote is ever read; a run that is repeated, or that two drivers make at once, adds each key once. Keys are dealt
to buckets by their hash, and an append reads the keys of the buckets that its rows touch, not the table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    _files(spark, path).delete(_path(spark, path), True)


def rename_new(spark: SparkSession, old: str, new: str) -> bool:
    """Rename in one step; False, and nothing done, if the new name is taken."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(_path(spark, new).toUri(), spark._jsc.hadoopConfiguration()) if _path(spark, new).toUri().getScheme() else fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, old), _path(spark, new), none)
    except Exception as error:  # the Java error says which
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def _write_text(spark: SparkSession, path: str, content: str) -> None:
    out = _files(spark, path).create(_path(spark, path), False)
    out.write(bytearray(content.encode()))
    out.close()


def manifests(spark: SparkSession, path: str) -> list[dict]:
    """The commits of a table in their order: ``{"commit", "buckets"}``, one small file for each."""
    fs, at = _files(spark, path), _path(spark, f"{path}/_commits")
    if not fs.exists(at):
        return []
    names = sorted((s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().isdigit()), key=int)
    read = lambda name: spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(_path(spark, f"{path}/_commits/{name}")), "UTF-8")
    return [json.loads(read(n)) for n in names]


def committed(spark: SparkSession, path: str, *, since: int = 0) -> DataFrame | None:
    """The rows of the commits from number ``since`` on, with their ``commit`` and ``bucket``; None if there are none."""
    found = [f"{path}/data/commit={m['commit']}" for m in manifests(spark, path)[since:] if m["rows"]]
    return spark.read.option("basePath", f"{path}/data").parquet(*found) if found else None


def _lacking(rows: DataFrame, there: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not there; only the buckets that they touch are read."""
    if there is None:
        return rows
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # as many as the table has buckets at most
    return rows.join(there.where(F.col("bucket").isin(touched)).select("bucket", *keys), ["bucket", *keys], "left_anti")


def append(df: DataFrame, path: str, keys: Sequence[str], *, buckets: int = 64) -> bool:
    """Commit the rows whose key the table does not have; False if there are none. ``buckets`` holds for a new table."""
    spark = df.sparkSession
    before = manifests(spark, path)
    buckets = before[0]["buckets"] if before else buckets
    rows = df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    rows = _lacking(rows, committed(spark, path), keys)
    while True:
        name = uuid.uuid4().hex
        staged = f"{path}/data/commit={name}"
        try:
            rows.repartition("bucket").write.partitionBy("bucket").parquet(staged)
            stored = spark.read.schema(rows.schema).option("basePath", staged).parquet(staged)
            n = stored.count()
            note = f"{path}/_commits/_{name}"
            _write_text(spark, note, json.dumps({"commit": name, "buckets": buckets, "rows": n}))
            if n and rename_new(spark, note, f"{path}/_commits/{len(before) + 1:08d}"):
                return True
            delete(spark, note)
        except (PySparkException, OSError):
            delete(spark, staged)
            raise
        if not n:
            delete(spark, staged)
            return False
        # another commit took the number: its keys go, and the rest is staged again
        since, before = len(before), manifests(spark, path)
        rows = _lacking(stored, committed(spark, path, since=since), keys)


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete what no commit names (left by drivers that ended in the middle); not while others append."""
    fs, known = _files(spark, path), {m["commit"] for m in manifests(spark, path)}
    at = _path(spark, f"{path}/data")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    gone = [n for n in names if n.startswith("commit=") and n.removeprefix("commit=") not in known]
    for n in gone:
        delete(spark, f"{path}/data/{n}")
    return gone
