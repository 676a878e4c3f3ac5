"""Reports as JSON text, for the place where they leave Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Moments in ISO form: instants with their offset, local times without one.
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "dateFormat": "yyyy-MM-dd",
    "ignoreNullFields": "false",
}


def json_rows(report: DataFrame, keys: Sequence[str] = ("email_login",)) -> DataFrame:
    """``keys`` as columns, and the other columns of each row as ``json``."""
    body = F.struct(*[c for c in report.columns if c not in keys])
    return report.select(*keys, F.to_json(body, JSON_OPTIONS).alias("json"))
