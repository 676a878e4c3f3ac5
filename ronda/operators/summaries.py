"""History by site and day, with guards as bitmaps that can be united over any window.

Distinct counts cannot be added up.  Here the guards of a site are numbered
once, and a site's guards of one day are the bits of their numbers, so that
the guards of any window, and of several clients under one site name, are a
union of bitmaps.  Reports over these tables never meet single guards.
"""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ronda.functions.text import filled
from ronda.functions.time import MONTH, month_keys, within_days
from ronda.operators import fulfilment
from ronda.operators.scope import Principals, near, visible_client_sites, with_namesakes
from ronda.schemas import require_columns
from ronda.settings import DEFAULTS, Settings

CLIENT_SITE = ["cliente_rol", "instalacion_rol"]
PLACE = ["instalacion_rol", "zona", "empresa"]
WEEK = ["semana", "isoweek", "ano"]
DAY = [*PLACE, "cliente_rol", *WEEK, "dia"]
GUARD = ["instalacion_rol", "rutrol"]
MEASURES = ["planificadas", "entregadas", "registros", "asistencias", "extras"]


class Fulfilment(NamedTuple):
    """Hours by week, and by site and week."""

    weekly: DataFrame
    by_site: DataFrame


def guard_numbers(history: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(instalacion_rol, rutrol, numero) of all guards of each site name, from 1.

    Guards in ``known`` keep their numbers, others get the ones after.  Guards
    of a site are first put into 64 shares by hash and numbered there, and the
    shares before are added, so that a site with very many guards is no single
    sort.
    """
    require_columns(history, "history")
    guards = history.select(*GUARD).where(F.col("rutrol").isNotNull() & F.col("instalacion_rol").isNotNull()).distinct()
    if known is not None:
        guards = guards.join(known.select(*GUARD), GUARD, "left_anti")
    shared = guards.withColumn("_parte", F.pmod(F.xxhash64("rutrol"), F.lit(64)))
    sizes = shared.groupBy("instalacion_rol", "_parte").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("instalacion_rol").orderBy("_parte").rowsBetween(W.unboundedPreceding, -1)
    before = sizes.select("instalacion_rol", "_parte", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_antes"))
    nth = F.row_number().over(W.partitionBy("instalacion_rol", "_parte").orderBy("rutrol"))
    numbered = shared.withColumn("_nth", nth).join(before, ["instalacion_rol", "_parte"])
    if known is None:
        return numbered.select(*GUARD, (F.col("_antes") + F.col("_nth")).alias("numero"))
    last = known.groupBy("instalacion_rol").agg(F.max("numero").alias("_ultimo"))
    new = numbered.join(last, "instalacion_rol", "left").select(
        *GUARD, (F.coalesce("_ultimo", F.lit(0)) + F.col("_antes") + F.col("_nth")).alias("numero")
    )
    return known.select(*GUARD, "numero").unionByName(new)


def site_days(history: DataFrame) -> DataFrame:
    """Measures by site, client and day."""
    require_columns(history, "history")
    return history.groupBy(*DAY).agg(
        F.sum("horas_planificadas").alias("planificadas"),
        F.sum("horas_entregadas").alias("entregadas"),
        F.count(F.lit(1)).alias("registros"),
        F.sum("asistencia").alias("asistencias"),
        F.count_if(filled(F.col("tvf"))).alias("extras"),
    )


def site_guards(history: DataFrame, numbers: DataFrame) -> DataFrame:
    """Guards by site, client and day: a bitmap for every 32,768 numbers of the site.

    A bitmap ends with its last set bit.  While it is made it takes 4 kB, so
    guards are combined and dealt out as numbers and no row is sorted after.
    """
    require_columns(history, "history")
    numbered = history.select(*DAY, "rutrol").join(numbers, GUARD).select(*DAY, "numero").distinct()
    keys = [*DAY, "tramo"]
    dealt = numbered.withColumn("tramo", F.bitmap_bucket_number("numero")).repartition(*keys)
    made = dealt.groupBy(*keys).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("numero")).alias("guardias"),
        F.max(F.bitmap_bit_position("numero")).alias("_ultimo"),
    )
    ends = F.floor(F.col("_ultimo") / 8).cast("int") + 1
    return made.select(*keys, F.substring("guardias", F.lit(1), ends).alias("guardias"))


def _window(stored: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    if MONTH in stored.columns:
        first, last = month_keys(as_of, days)
        stored = stored.filter(F.col(MONTH).between(first, last)).drop(MONTH)
    return stored.filter(within_days(F.col("dia"), as_of, days))


def _unions(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """One bitmap by ``keys``, as long as the longest.  Bitmaps are dealt out as they are stored: a union takes 4 kB."""
    whole = bitmaps.repartition(*keys).groupBy(*keys).agg(
        F.bitmap_or_agg("guardias").alias("guardias"), F.max(F.octet_length("guardias")).alias("_bytes")
    )
    return whole.select(*keys, F.substring("guardias", F.lit(1), F.col("_bytes")).alias("guardias"))


def _united(bitmaps: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct guards by ``keys``."""
    whole = _unions(bitmaps, [*keys, "tramo"])
    return whole.groupBy(*keys).agg(F.sum(F.bitmap_count("guardias")).alias("guardias"))


def fulfilment_of(
    days_table: DataFrame,
    guards_table: DataFrame,
    grants: DataFrame,
    as_of: dt.date,
    days: int | None = None,
    settings: Settings = DEFAULTS,
    principals: Principals = None,
) -> Fulfilment:
    """:func:`fulfilment.weekly_fulfilment` and :func:`fulfilment.site_week_fulfilment` from stored days.

    Both come from one aggregate by site and week.  Sites of one name that a
    principal sees under several clients may share guards: for these the
    bitmaps are united once the principal is known.
    """
    days = settings.history_days if days is None else days
    visible = visible_client_sites(grants, principals)
    recent = near(_window(days_table, as_of, days), visible, CLIENT_SITE, principals)
    site_week = recent.groupBy(*PLACE, "cliente_rol", *WEEK).agg(
        F.min("dia").alias("primero"), F.max("dia").alias("ultimo"), *[F.sum(m).alias(m) for m in MEASURES]
    )
    weekly = fulfilment.weeks_of(
        site_week.groupBy(*CLIENT_SITE, *WEEK).agg(
            F.min("primero").alias("primero"), F.max("ultimo").alias("ultimo"), *[F.sum(m).alias(m) for m in MEASURES]
        ),
        visible,
        settings,
    )
    bitmaps = near(_window(guards_table, as_of, days), visible, CLIENT_SITE, principals)
    week_guards = _unions(bitmaps, [*PLACE, "cliente_rol", *WEEK, "tramo"])
    namesakes = (
        with_namesakes(visible).filter("varios").select("instalacion_rol", F.lit(True).alias("ambiguo")).distinct()
    )
    # Counts are put beside the measures by one more aggregate, which takes null zones and companies as they are.
    counted = week_guards.groupBy(*PLACE, "cliente_rol", *WEEK).agg(F.sum(F.bitmap_count("guardias")).alias("guardias"))
    whole = _beside(site_week.drop("registros"), counted, [*PLACE, "cliente_rol", *WEEK])
    marked = whole.join(namesakes, "instalacion_rol", "left")
    rated = fulfilment.rated_week(marked, settings)
    seen = fulfilment.seen_weeks(visible, rated)
    keys = ["email_login", *WEEK, *PLACE]
    several = seen.filter(F.col("ambiguo").isNotNull()).groupBy(*keys).agg(
        F.min("primero").alias("primero"),
        F.max("ultimo").alias("ultimo"),
        *[F.sum(m).alias(m) for m in fulfilment.SHOWN_MEASURES],
    )
    shared = visible.join(namesakes, "instalacion_rol", "left_semi").join(week_guards, CLIENT_SITE)
    united = _beside(several, _united(shared, keys), keys)
    by_site = fulfilment.site_weeks_of(
        seen.filter(F.col("ambiguo").isNull()), fulfilment.rated_week(united, settings)
    )
    return Fulfilment(weekly, by_site)


def _beside(measures: DataFrame, guards: DataFrame, keys: list[str]) -> DataFrame:
    """Measures with the number of guards of the same keys."""
    rest = [c for c in measures.columns if c not in keys]
    empty = guards.select(*keys, *[F.lit(None).cast(measures.schema[c].dataType).alias(c) for c in rest], "guardias")
    rows = measures.select(*keys, *rest, F.lit(None).cast("long").alias("guardias")).unionByName(empty)
    return rows.groupBy(*keys).agg(*[F.max(c).alias(c) for c in rest], F.coalesce(F.max("guardias"), F.lit(0)).alias("guardias"))
