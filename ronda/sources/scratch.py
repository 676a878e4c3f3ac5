"""A folder for tables between two jobs, which all machines of a cluster share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one of this machine only where Spark runs on it alone."""
    chosen = spark.conf.get(CHECKPOINT_DIR, None)
    if chosen:
        return chosen.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{CHECKPOINT_DIR} names no folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="ronda-"))
    return _own[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
