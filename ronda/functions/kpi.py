"""Ratios, bands and punctuality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ronda import fixed_values as fv
from ronda.settings import DEFAULTS, Settings


def percent(part: Column, whole: Column, scale: int) -> Column:
    """Rounded percentage; 0 where the whole is zero or anything is null."""
    ratio = F.try_divide(part, F.nullif(whole, F.lit(0)))
    return F.coalesce(F.round(ratio * 100, scale), F.lit(0.0))


def band(pct: Column, settings: Settings = DEFAULTS) -> Column:
    """Traffic light of an already rounded percentage."""
    return (
        F.when(pct >= settings.green_from * 100, fv.BAND_GREEN)
        .when(pct >= settings.amber_from * 100, fv.BAND_AMBER)
        .otherwise(fv.BAND_RED)
    )


def minute_boundaries(start: str, end: str) -> Column:
    """Minute marks between two time columns: 08:59:59 to 09:00:00 is one."""
    return F.expr(
        f"timestampdiff(MINUTE, date_trunc('MINUTE', `{start}`), date_trunc('MINUTE', `{end}`))"
    )


def punctuality(planned: str = "her", actual: str = "entrada") -> Column:
    came = F.col("asistencia") == 1
    minutes = minute_boundaries(planned, actual).cast("string")
    late = F.concat(F.lit(fv.LATE_PREFIX), minutes, F.lit(fv.LATE_SUFFIX))
    return F.when(came & (F.col(actual) > F.col(planned)), late).when(came, fv.ON_TIME)


def hours(total: Column) -> Column:
    return F.coalesce(total.cast("double"), F.lit(0.0))
