"""Places of rows in a report's order, found without bringing the report to one task.

A few rows, chosen by the hash of all their columns, give the bounds of ranges
of about equal size.  A row's range follows from the bounds alone, so that it is
the same however often and in how many partitions the report is computed.  Rows
are numbered within their range, and the sizes of the ranges before it are
added.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ronda.plans.ordering import order_keys

ROWS_PER_RANGE = 20  # sampled rows for each bound


class _Key:
    """One column of an order."""

    def __init__(self, name: str, descending: bool):
        self.name, self.descending = name, descending

    def sort(self) -> Column:
        return F.desc(self.name) if self.descending else F.asc(self.name)

    def before(self, bound: Column) -> Column:
        """Whether the row comes before the bound; nulls are first ascending and last descending."""
        own = F.col(self.name)
        less = own > bound if self.descending else own < bound
        none = own.isNotNull() & bound.isNull() if self.descending else own.isNull() & bound.isNotNull()
        return F.coalesce(less, F.lit(False)) | none


def _range_of(keys: Sequence[_Key], bounds: Sequence[Row], schema) -> Column:
    """Number of the range of a row: a search tree over the bounds, so few of them are looked at."""

    def literal(bound: Row, key: _Key) -> Column:
        return F.lit(bound[key.name]).cast(schema[key.name].dataType)

    def before(bound: Row) -> Column:
        parts = [(k.before(literal(bound, k)), F.col(k.name).eqNullSafe(literal(bound, k))) for k in keys]
        return reduce(lambda later, part: part[0] | (part[1] & later), reversed(parts), F.lit(False))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(before(bounds[middle]), tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(bounds))


def with_places(df: DataFrame, report: str, name: str = "lugar", ranges: int | None = None) -> DataFrame:
    """``df`` with the place of every row in the order of ``report``, from 1.

    Rows that the order leaves equal are told apart by their other columns, in
    the order of the columns; rows alike in all of them take places next to each
    other.  ``ranges`` is the number of ranges, by default that of shuffle
    partitions; it decides how rows are spread and never a place.  One small job
    reads the bounds.
    """
    ordered = order_keys(df, report)
    taken = {key for key, _ in ordered}
    keys = [_Key(*k) for k in ordered] + [_Key(c, False) for c in df.columns if c not in taken]
    wanted = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mark = F.xxhash64(*df.columns)
    sampled = df.select(*df.columns, mark.alias("_marca")).distinct().orderBy("_marca", *df.columns).limit(wanted * ROWS_PER_RANGE)
    numbered = sampled.orderBy(*[k.sort() for k in keys]).collect()
    bounds = [numbered[k * len(numbered) // wanted] for k in range(1, wanted)] if numbered else []
    bounds = [b for k, b in enumerate(bounds) if not k or b != bounds[k - 1]]
    ranged = df.withColumn("_tramo", _range_of(keys, bounds, df.schema))
    # Sizes of the ranges: one row for each, put before one another in an array of that length.
    sizes = ranged.groupBy("_tramo").agg(F.count(F.lit(1)).alias("n")).groupBy().agg(
        F.collect_list(F.struct("_tramo", "n")).alias("tramos")
    )
    each = F.transform(
        "tramos",
        lambda t: F.struct(
            t["_tramo"].alias("_tramo"),
            F.aggregate(
                F.filter("tramos", lambda x: x["_tramo"] < t["_tramo"]), F.lit(0).cast("long"), lambda total, x: total + x["n"]
            ).alias("_antes"),
        ),
    )
    before = sizes.select(F.explode(each).alias("t")).select("t.*")
    nth = F.row_number().over(W.partitionBy("_tramo").orderBy(*[k.sort() for k in keys]))
    placed = ranged.withColumn("_nth", nth).join(before, "_tramo")
    return placed.select(*df.columns, (F.col("_antes") + F.col("_nth")).alias(name))
