"""Nested reports: the rows of a group as ordered arrays of bounded length."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE_ROWS = 4096


def nest_rows(
    flat: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Arrays ``name`` of the columns besides ``keys``, ordered by ``order``.

    Every group is cut into pages of ``page_rows`` rows, numbered from 0 in
    ``pagina``; rows of equal order are told apart by their other columns, so
    pages are the same however the rows are spread.  A row's rank is the number
    of rows with a smaller order key, which is a running total over one count
    for each key, plus its rank among its equals: no task meets a group as a
    whole.  Keys must not be null.
    """
    items = [c for c in flat.columns if c not in keys]
    rest = [c for c in items if c not in order]
    equals = [*keys, *order]
    counts = flat.groupBy(*equals).agg(F.count(F.lit(1)).alias("_filas"))
    up_to = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    before = counts.withColumn("_antes", F.sum("_filas").over(up_to) - F.col("_filas"))
    before = before.select(*[F.col(c).alias(f"_{c}") for c in equals], "_antes")
    same = reduce(
        lambda a, b: a & b,
        [F.col(c) == F.col(f"_{c}") for c in keys] + [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in order],
    )
    nth = F.row_number().over(W.partitionBy(*equals).orderBy(*(rest or order)))
    placed = flat.withColumn("_nth", nth).join(before, same)
    rank = F.col("_antes") + F.col("_nth") - 1
    gathered = (
        placed.withColumn("_pos", rank)
        .withColumn("pagina", F.floor(F.col("_pos") / page_rows))
        .groupBy(*keys, "pagina")
        .agg(F.array_sort(F.collect_list(F.struct("_pos", *items))).alias("_rows"))
    )
    return gathered.select(
        *keys,
        "pagina",
        F.transform("_rows", lambda row: F.struct(*[row[c].alias(c) for c in items])).alias(name),
    )
