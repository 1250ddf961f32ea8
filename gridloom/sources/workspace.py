"""Folders for intermediate files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from gridloom.shipping import ship

_local: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that all machines share, which ``spark.checkpoint.dir`` names.  Where it is
    unset, a temporary folder on a single machine, and an error on a cluster."""
    ship(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        root = _local.setdefault(sc.applicationId, "") or tempfile.mkdtemp(prefix="gridloom-")
        _local[sc.applicationId] = root
    return root.rstrip("/")


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A path for a new folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
