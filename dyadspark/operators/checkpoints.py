"""Cutting lineage in a folder that every executor can read."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the cluster names in ``spark.checkpoint.dir``; set one only where none is known (local tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
        named = tempfile.mkdtemp(prefix="spark-checkpoint-")
    sc.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: The scopes open in this thread or task of the driver, the innermost last.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that :func:`stored` writes inside are deleted at the end; what it yields stores a result that stays."""
    own: list[str] = []
    outer = _SCOPES.get()

    def keep(df: DataFrame) -> DataFrame:
        inside = _SCOPES.set(outer)
        try:
            return stored(df)
        finally:
            _SCOPES.reset(inside)

    place = _SCOPES.set((*outer, own))
    try:
        yield keep
    finally:
        _SCOPES.reset(place)
        for path in own:
            _delete(spark, path)


def stored(df: DataFrame, *, free: bool = False) -> DataFrame:
    """``df`` as a compressed table in the shared checkpoint folder, read back from there.

    For results too large for the plain rows of a checkpoint. The table goes with the session, or with the
    :func:`scratch` around it. ``free`` gives up the shuffle files that only ``df`` needed at once; use it where these
    are a good part of the disk.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if _SCOPES.get():
        _SCOPES.get()[-1].append(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    if free:
        release(spark)
    return spark.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's context cleaner see that finished stages are done with: it drops shuffle files on garbage collection.

    Listeners hold the plan of a query for a moment after its end, so a second look follows the first.
    """
    for _ in range(2):
        time.sleep(0.4)
        gc.collect()
        spark._jvm.System.gc()
