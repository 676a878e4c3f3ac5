"""Attendance history, stored by month.

A filter on the day alone prunes no directory, so reading a window names the
months it touches as well.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ronda.functions.time import MONTH, month_key, month_keys, within_days
from ronda.schemas import require_columns


def write_history(history: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Writes whole months; those written before are replaced and others stay,
    so a write can be repeated.  Mode "append" adds to months instead.  Rows of a month are brought together, and adaptive
    execution divides months that are too much for one task, so there are
    neither many small files nor a heavy month in a single one."""
    require_columns(history, "history")
    keyed = history.withColumn(MONTH, month_key(F.col("dia")))
    keyed.hint("rebalance", F.col(MONTH)).write.mode(mode).option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(MONTH).parquet(path)


def read_history(spark: SparkSession, path: str, as_of: dt.date, days: int) -> DataFrame:
    first, last = month_keys(as_of, days)
    stored = spark.read.parquet(path)
    in_months = stored.filter(F.col(MONTH).between(first, last))
    return in_months.filter(within_days(F.col("dia"), as_of, days)).drop(MONTH)
