"""Python workers need this package: where it is not installed on them, Spark carries it there."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ensure(spark: SparkSession | None = None) -> None:
    """Add the package to the application's Python files, once per context."""
    spark = spark or SparkSession.getActiveSession()
    context = getattr(spark, "sparkContext", None) if spark else None
    if context is None or getattr(context, "_sensorloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        shutil.copytree(here, f"{folder}/tree/{here.name}", ignore=shutil.ignore_patterns("__pycache__"))
        made = shutil.make_archive(f"{tempfile.mkdtemp()}/{here.name}", "zip", f"{folder}/tree")
    context.addPyFile(made)
    context._sensorloom_shipped = True
