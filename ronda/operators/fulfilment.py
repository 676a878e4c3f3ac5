"""Planned against delivered hours, by week and by site and week."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ronda.functions.kpi import band, hours, percent
from ronda.functions.text import filled
from ronda.functions.time import MONTH, day_range_label, month_keys, within_days
from ronda.operators.scope import Principals, near, visible_client_sites, with_namesakes
from ronda.schemas import require_columns
from ronda.settings import DEFAULTS, Settings

CLIENT_SITE = ["cliente_rol", "instalacion_rol"]
WEEK = ["semana", "isoweek", "ano"]
PLACE = ["instalacion_rol", "zona", "empresa"]
SHOWN_MEASURES = ["planificadas", "entregadas", "asistencias", "extras"]


def _window(history: DataFrame, as_of: dt.date, days: int | None, settings: Settings) -> DataFrame:
    """The trailing window; a table stored by month is read in these months only."""
    require_columns(history, "history")
    days = settings.history_days if days is None else days
    if MONTH in history.columns:
        first, last = month_keys(as_of, days)
        history = history.filter(F.col(MONTH).between(first, last)).drop(MONTH)
    return history.filter(within_days(F.col("dia"), as_of, days))


def rated_week(weeks: DataFrame, settings: Settings) -> DataFrame:
    pct = percent(F.col("entregadas"), F.col("planificadas"), 2)
    label = day_range_label(F.col("primero"), F.col("ultimo"))
    rated = weeks.withColumns({"periodo": label, "porcentaje": pct})
    return rated.withColumn("banda", band(F.col("porcentaje"), settings))


def weekly_fulfilment(
    history: DataFrame,
    grants: DataFrame,
    as_of: dt.date,
    days: int | None = None,
    settings: Settings = DEFAULTS,
    principals: Principals = None,
) -> DataFrame:
    """Hours and attendance per principal and week.

    Sites are counted by name.  Only those a principal sees under several
    clients need telling apart for that; the others are one each.
    """
    visible = visible_client_sites(grants, principals)
    recent = _window(history, as_of, days, settings)
    site_week = (
        near(recent, visible, CLIENT_SITE, principals)
        .groupBy(*CLIENT_SITE, *WEEK)
        .agg(
            F.min("dia").alias("primero"),
            F.max("dia").alias("ultimo"),
            F.sum("horas_planificadas").alias("planificadas"),
            F.sum("horas_entregadas").alias("entregadas"),
            F.count(F.lit(1)).alias("registros"),
            F.sum("asistencia").alias("asistencias"),
        )
    )
    return weeks_of(site_week, visible, settings)


def weeks_of(site_week: DataFrame, visible: DataFrame, settings: Settings) -> DataFrame:
    """The weekly report from measures by client, site and week."""
    times, several = F.col("accesos"), F.col("varios")
    names = F.count_distinct(F.when(several, F.col("instalacion_rol")))
    weeks = (
        with_namesakes(visible)
        .join(site_week, CLIENT_SITE)
        .groupBy("email_login", *WEEK)
        .agg(
            F.min("primero").alias("primero"),
            F.max("ultimo").alias("ultimo"),
            F.sum(F.col("planificadas") * times).alias("planificadas"),
            F.sum(F.col("entregadas") * times).alias("entregadas"),
            F.sum(F.col("registros") * times).alias("total_registros"),
            F.sum(F.col("asistencias") * times).alias("total_asistencias"),
            (F.count_if(~several) + names).alias("num_instalaciones"),
        )
    )
    planned, delivered = F.col("planificadas"), F.col("entregadas")
    return rated_week(weeks, settings).select(
        "email_login",
        *WEEK,
        F.col("primero").alias("fecha_inicio"),
        F.col("ultimo").alias("fecha_fin"),
        "periodo",
        hours(planned).alias("horas_presupuestadas"),
        hours(delivered).alias("horas_entregadas"),
        hours(planned - delivered).alias("horas_faltantes"),
        F.col("porcentaje").alias("porcentaje_cumplimiento"),
        F.col("banda").alias("estado_semaforo"),
        "total_registros",
        "total_asistencias",
        (F.col("total_registros") - F.col("total_asistencias")).alias("total_ausencias"),
        "num_instalaciones",
    )


def site_week_fulfilment(
    history: DataFrame,
    grants: DataFrame,
    as_of: dt.date,
    days: int | None = None,
    settings: Settings = DEFAULTS,
    principals: Principals = None,
) -> DataFrame:
    """Hours, guards and extra shifts per principal, site and week.

    Guards are counted once per site name.  Sites of one name under two
    clients that the same principal sees may share guards, so the facts of
    just those names keep the guard until the principal is known; all others
    come down to one row per site and week first.
    """
    visible = visible_client_sites(grants, principals)
    recent = _window(history, as_of, days, settings)
    guard_week = (
        near(recent, visible, CLIENT_SITE, principals)
        .groupBy(*PLACE, "cliente_rol", *WEEK, "rutrol")
        .agg(
            F.min("dia").alias("primero"),
            F.max("dia").alias("ultimo"),
            F.sum("horas_planificadas").alias("planificadas"),
            F.sum("horas_entregadas").alias("entregadas"),
            F.sum("asistencia").alias("asistencias"),
            F.count_if(filled(F.col("tvf"))).alias("extras"),
        )
    )
    namesakes = (
        with_namesakes(visible)
        .filter("varios")
        .select("instalacion_rol", F.lit(True).alias("ambiguo"))
        .distinct()
    )
    site_week = (
        guard_week.join(namesakes, "instalacion_rol", "left")
        .withColumn("guardia", F.when(F.col("ambiguo"), F.col("rutrol")))
        .groupBy(*PLACE, "cliente_rol", *WEEK, "guardia")
        .agg(
            F.min("primero").alias("primero"),
            F.max("ultimo").alias("ultimo"),
            F.sum("planificadas").alias("planificadas"),
            F.sum("entregadas").alias("entregadas"),
            F.sum("asistencias").alias("asistencias"),
            F.sum("extras").alias("extras"),
            F.count(F.when(F.col("ambiguo").isNull(), F.col("rutrol"))).alias("guardias"),
            F.max("ambiguo").alias("ambiguo"),
        )
    )
    # Range label, percentage and band do not depend on the viewer.
    seen = seen_weeks(visible, rated_week(site_week, settings))
    # Most rows are final now: one per principal, site and week.  Only the
    # namesakes are put together, so only they are shuffled once more.
    several = (
        seen.filter(F.col("ambiguo").isNotNull())
        .groupBy("email_login", *WEEK, *PLACE)
        .agg(
            F.min("primero").alias("primero"),
            F.max("ultimo").alias("ultimo"),
            *[F.sum(m).alias(m) for m in SHOWN_MEASURES],
            F.count_distinct("guardia").alias("guardias"),
        )
    )
    return site_weeks_of(seen.filter(F.col("ambiguo").isNull()), rated_week(several, settings))


def seen_weeks(visible: DataFrame, site_week: DataFrame) -> DataFrame:
    """Weeks of every site a principal sees; measures count as often as the site was granted."""
    return visible.join(site_week, CLIENT_SITE).withColumns(
        {m: F.col(m) * F.col("accesos") for m in SHOWN_MEASURES}
    )


def site_weeks_of(single: DataFrame, several: DataFrame) -> DataFrame:
    """The report from the weeks of sites with one client and of namesakes."""
    columns = ["email_login", *WEEK, *PLACE, *SHOWN_MEASURES, "guardias", "periodo", "porcentaje", "banda"]
    whole = single.select(*columns).unionByName(several.select(*columns))
    planned, delivered = F.col("planificadas"), F.col("entregadas")
    return whole.select(
        "email_login",
        *WEEK,
        "periodo",
        *PLACE,
        hours(planned).alias("horas_presupuestadas"),
        hours(delivered).alias("horas_entregadas"),
        hours(planned - delivered).alias("horas_faltantes"),
        F.col("porcentaje").alias("porcentaje_cumplimiento"),
        F.col("banda").alias("estado_semaforo"),
        F.col("guardias").alias("guardias_planificados"),
        F.col("asistencias").alias("asistencias_registradas"),
        F.col("extras").alias("cantidad_turnos_extra"),
    )
