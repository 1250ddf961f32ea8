"""Hands the package to executors, wherever Spark was started."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_HERE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application, so that tasks can import the package; Spark serves the archive to
    the executors.  Cheap when called again."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    archive = os.path.join(tempfile.mkdtemp(prefix="gridloom-ship-"), "gridloom_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(_HERE):
            for name in (n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(_HERE)))
    sc.addPyFile(archive)
