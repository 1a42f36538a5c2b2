"""Sends the package to the executors, so that their Python workers can import it wherever it lies on the driver."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the session's files, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_setloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = os.path.realpath(tempfile.mkdtemp(prefix="setloom-"))
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    to = os.path.join(folder, "setloom.zip")
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    sc.addPyFile(to)
    sc._setloom_shipped = True
