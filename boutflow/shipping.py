"""Sends the package to the executors, whose Python workers import it."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip to the session's files, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    if not here.endswith(".zip") and os.path.isdir(here):
        base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "boutflow")
        context.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(here), os.path.basename(here)))
    _SENT.add(context.applicationId)
