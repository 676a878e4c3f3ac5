"""Appends that can be repeated, and tables replaced version by version.

A version may carry the name of the batch it was made from.  The name is part
of its directory, so a version and where it comes from are complete together.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_BATCH = re.compile(r"[A-Za-z0-9_.-]+")
_VERSION = re.compile(r"v(\d{8})(?:_(.+))?")


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def batch_path(path: str, batch_id: str) -> str:
    if not _BATCH.fullmatch(batch_id):
        raise ValueError(f"batch id not usable in a path: {batch_id!r}")
    return f"{path.rstrip('/')}/batch_id={batch_id}"


def append_batch(df: DataFrame, path: str, batch_id: str, replace: bool = False) -> None:
    """Adds a batch to ``path``.

    What a failed attempt left of the batch is replaced.  A complete batch is
    kept as it is, unless ``replace`` asks for another one in its place.
    """
    target = batch_path(path, batch_id)
    if replace or not _complete(df.sparkSession, target):
        df.write.mode("overwrite").parquet(target)


def _file_system(spark: SparkSession, path: str):
    """(file system, path) on the Java side."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _complete(spark: SparkSession, path: str) -> bool:
    fs, done = _file_system(spark, f"{path}/_SUCCESS")
    return fs.exists(done)


def _versions(spark: SparkSession, base: str) -> dict[int, str | None]:
    """Complete versions under ``base``, ascending, and the batch of each."""
    fs, root = _file_system(spark, base)
    if not fs.exists(root):
        return {}
    found = {}
    for status in fs.listStatus(root):
        name = _VERSION.fullmatch(status.getPath().getName())
        if name and _complete(spark, status.getPath().toString()):
            found[int(name[1])] = name[2]
    return dict(sorted(found.items()))


def version_path(base: str, version: int, batch_id: str | None = None) -> str:
    return f"{base.rstrip('/')}/v{version:08d}" + (f"_{batch_id}" if batch_id else "")


def version_of_batch(spark: SparkSession, base: str, batch_id: str) -> int | None:
    """The complete version made from a batch, if there is one."""
    return next((v for v, batch in _versions(spark, base).items() if batch == batch_id), None)


def read_version(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The given version, or the newest complete one."""
    known = _versions(spark, base)
    if version is None:
        version = max(known, default=0)
    if version not in known:
        raise FileNotFoundError(f"no complete version {version or ''} under {base}")
    return spark.read.parquet(version_path(base, version, known[version]))


def latest_version(spark: SparkSession, base: str) -> int:
    return max(_versions(spark, base), default=0)


def publish_version(df: DataFrame, base: str, version: int, batch_id: str | None = None) -> int:
    """Writes ``df`` as ``version``, made from a batch; it becomes the newest when complete.

    ``df`` may be computed from an earlier version, which stays untouched.  A
    complete version is not written again; what an unfinished attempt left of
    this one is replaced.
    """
    spark = df.sparkSession
    if version in _versions(spark, base):
        raise ValueError(f"version {version} exists under {base}")
    if batch_id is not None:
        batch_path(base, batch_id)
    df.write.mode("overwrite").parquet(version_path(base, version, batch_id))
    return version
