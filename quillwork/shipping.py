"""Sends this package to the executors, so that functions run there can import it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once a Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_quillwork_shipped", False):
        return
    package = Path(__file__).resolve().parent
    at = tempfile.mkdtemp()  # the driver's file server reads it for as long as the application runs
    atexit.register(shutil.rmtree, at, ignore_errors=True)
    shutil.copytree(package, f"{at}/{package.name}/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{at}/{package.name}", "zip", f"{at}/{package.name}"))
    sc._quillwork_shipped = True
