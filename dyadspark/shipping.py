"""Sending the library's code to the executors of a session that was started without it."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to the session's Python files, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    to = os.path.join(tempfile.mkdtemp(prefix="spark-code-"), "dyadspark.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(here)))
    spark.sparkContext.addPyFile(to)
    _SENT.add(app)
