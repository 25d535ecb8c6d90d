"""Bringing the package to Python workers that do not have it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package with the session's tasks, once, unless workers find it by PYTHONPATH or the working folder.

    Spark serves the archive to all executors; nothing reads its place on the driver from elsewhere.
    """
    at_hand = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    application = spark.sparkContext.applicationId
    if application in _shipped or any(p and Path(p).resolve() == _ROOT for p in at_hand):
        return
    archive = Path(tempfile.mkdtemp(prefix="symloom-")) / "symloom_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted((_ROOT / "symloom").rglob("*.py")):
            z.write(source, source.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(application)
