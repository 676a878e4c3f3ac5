"""Registry of the logical tables of a deployment."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ronda.schemas import SCHEMAS, require_columns
from ronda.session import prepare


class Tables:
    """Logical tables by name, each a catalog table, a path or a DataFrame.

    A location with a slash is read as a path of ``file_format``; any other
    text is the qualified name of a table or view.
    """

    def __init__(
        self,
        spark: SparkSession,
        locations: Mapping[str, str | DataFrame],
        file_format: str = "parquet",
    ):
        unknown = sorted(set(locations) - set(SCHEMAS))
        if unknown:
            raise ValueError(f"unknown tables: {', '.join(unknown)}")
        self.spark = prepare(spark)
        self._locations = dict(locations)
        self._format = file_format

    def __contains__(self, name: str) -> bool:
        return name in self._locations

    def __getitem__(self, name: str) -> DataFrame:
        location = self._locations[name]
        if isinstance(location, DataFrame):
            return require_columns(location, name)
        if "/" in location:
            df = self.spark.read.format(self._format).load(location)
        else:
            df = self.spark.table(location)
        return require_columns(df, name)

    def register_views(self) -> None:
        """Makes every table a temporary view of its logical name."""
        for name in self._locations:
            self[name].createOrReplaceTempView(name)

    def sql(self, text: str, **parameters: Any) -> DataFrame:
        """SQL over the views with ``:name`` parameters; a list is an array."""
        return self.spark.sql(text, args=parameters)
