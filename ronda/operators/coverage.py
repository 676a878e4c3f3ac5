"""Live coverage: overall, per site, and per site and service."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ronda import fixed_values as fv
from ronda.functions.kpi import band, percent
from ronda.functions.text import none_if_empty, service_type
from ronda.operators import open_posts as posts
from ronda.operators.scope import (
    Principals,
    by_site,
    nearby,
    principal_frame,
    visible_client_sites,
    visible_rows,
)
from ronda.schemas import require_columns
from ronda.settings import DEFAULTS, Settings

CLIENT_SITE = ["cliente_rol", "instalacion_rol"]
SITE = ["instalacion_rol", "zona", "cliente_rol", "empresa"]


def coverage_rollup(shifts: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """Required and present guards per site and service.

    Stored coverage comes with this table already made; this is our definition
    of it from single shifts.  Every shift requires one guard and is covered
    if the guard came.  ``zona`` is used if the shifts carry it.
    """
    require_columns(shifts, "shifts")
    zone = F.col("zona") if "zona" in shifts.columns else F.lit(None).cast("string")
    came = F.coalesce(F.col("asistencia") == 1, F.lit(False))
    refreshed = F.max("entrada") if as_of is None else F.lit(as_of)
    keyed = shifts.withColumn("zona", zone)
    counted = keyed.groupBy(*SITE, "tipo_de_servicio").agg(
        F.count(F.lit(1)).alias("total_guardias_requeridos"),
        F.count_if(came).alias("guardias_presentes"),
        refreshed.cast("timestamp").alias("ultima_actualizacion"),
    )
    required, present = F.col("total_guardias_requeridos"), F.col("guardias_presentes")
    return counted.withColumns(
        {"turnos_cubiertos": present, "turnos_descubiertos": required - present}
    )


PART_DAY = "dia"  # column that shifts and parts of the rollup are stored by


def rollup_parts(shifts: DataFrame) -> DataFrame:
    """What :func:`coverage_rollup` counts, by site, service and day of the planned start.

    Counts add up and the last entry is a maximum, so parts of single days can
    be replaced.  Shifts without a planned start belong to no day and are one
    part of their own.
    """
    require_columns(shifts, "shifts")
    day = F.col(PART_DAY) if PART_DAY in shifts.columns else F.to_date("her")
    zone = F.col("zona") if "zona" in shifts.columns else F.lit(None).cast("string")
    came = F.coalesce(F.col("asistencia") == 1, F.lit(False))
    return (
        shifts.withColumns({"zona": zone, PART_DAY: day})
        .groupBy(PART_DAY, *SITE, "tipo_de_servicio")
        .agg(
            F.count(F.lit(1)).alias("requeridos"),
            F.count_if(came).alias("presentes"),
            F.max("entrada").cast("timestamp").alias("entrada"),
        )
    )


def rollup_of_parts(parts: DataFrame, as_of: dt.datetime | None = None) -> DataFrame:
    """The rollup of all days from their parts."""
    refreshed = F.max("entrada") if as_of is None else F.lit(as_of).cast("timestamp")
    counted = parts.filter(F.col("requeridos") > 0).groupBy(*SITE, "tipo_de_servicio").agg(
        F.sum("requeridos").alias("total_guardias_requeridos"),
        F.sum("presentes").alias("guardias_presentes"),
        refreshed.alias("ultima_actualizacion"),
    )
    required, present = F.col("total_guardias_requeridos"), F.col("guardias_presentes")
    return counted.withColumns({"turnos_cubiertos": present, "turnos_descubiertos": required - present})


def coverage_overall(
    rollup: DataFrame,
    grants: DataFrame,
    open_posts: DataFrame,
    settings: Settings = DEFAULTS,
    principals: Principals = None,
) -> DataFrame:
    """One row per principal over all the sites that principal sees.

    A principal with nothing required gets an all-zero grey row.
    """
    require_columns(rollup, "rollup")
    visible = visible_client_sites(grants, principals)
    narrow = nearby(visible, principals)
    sites = narrow(rollup, CLIENT_SITE).groupBy(*CLIENT_SITE, "empresa").agg(
        F.sum("total_guardias_requeridos").alias("requeridos"),
        F.sum("guardias_presentes").alias("presentes"),
        F.max("ultima_actualizacion").alias("refrescado"),
    )
    times = F.col("accesos")
    totals = (
        visible.join(sites, CLIENT_SITE)
        .groupBy("email_login", "empresa")
        .agg(
            F.sum(F.col("requeridos") * times).alias("requeridos"),
            F.sum(F.col("presentes") * times).alias("presentes"),
            F.max("refrescado").alias("refrescado"),
        )
        .groupBy("email_login")
        .agg(
            F.sum("requeridos").alias("requeridos"),
            F.sum("presentes").alias("presentes"),
            F.max("refrescado").alias("refrescado"),
            F.array_sort(F.collect_list("empresa")).alias("empresas"),
        )
    )
    everyone = principal_frame(grants, principals)
    joined = everyone.join(totals, "email_login", "left").join(
        posts.posts_seen(narrow(open_posts, ["instalacion_rol"]), by_site(visible)), "email_login", "left"
    )
    live = F.coalesce(F.col("requeridos") != 0, F.lit(False))
    pct = percent(F.col("presentes"), F.col("requeridos"), 2)
    missing = F.col("requeridos") - F.col("presentes")
    next_refresh = F.col("refrescado") + F.expr(f"INTERVAL {fv.REFRESH_MINUTES} MINUTES")
    no_names = F.array().cast("array<string>")
    return joined.select(
        "email_login",
        F.when(live, F.col("requeridos")).otherwise(0).alias("total_turnos_activos"),
        F.when(live, F.col("presentes")).otherwise(0).alias("turnos_cubiertos"),
        F.when(live, missing).otherwise(0).alias("turnos_descubiertos"),
        F.when(live, pct).otherwise(0.0).alias("porcentaje_cobertura_general"),
        F.when(live, band(pct, settings)).otherwise(fv.BAND_GREY).alias("estado_semaforo"),
        F.when(live, F.col("refrescado")).alias("ultima_actualizacion"),
        F.when(live, next_refresh).alias("proxima_actualizacion"),
        F.when(live, F.coalesce("total_ppc", F.lit(0))).otherwise(0).alias("total_ppc"),
        F.when(live, F.col("empresas")).otherwise(no_names).alias("empresas"),
    )


def _with_site_lookups(
    sites: DataFrame,
    devices: DataFrame,
    open_posts: DataFrame,
    narrow: Callable[[DataFrame, list[str]], DataFrame],
) -> DataFrame:
    """Device and open-post columns, joined while the rows are one per site.

    ``equipos`` counts devices that cannot be told apart.  Distinguishable
    devices each make a row of their own.
    """
    require_columns(devices, "devices")
    named = devices.filter(F.col("nombre").isNotNull()).withColumnRenamed("nombre", "instalacion_rol")
    known = (
        narrow(named, ["instalacion_rol"])
        .groupBy("instalacion_rol", "numero", "ult_conexion")
        .agg(F.count(F.lit(1)).alias("equipos"))
    )
    looked_up = sites.join(known, "instalacion_rol", "left").join(
        posts.per_site(open_posts), "instalacion_rol", "left"
    )
    return looked_up.withColumns(
        {
            "tiene_faceid": F.col("equipos").isNotNull(),
            "equipos": F.coalesce("equipos", F.lit(1)),
            "ppc": F.coalesce("cantidad_ppc", F.lit(0)),
        }
    )


def _rated(
    sites: DataFrame, present: str, required: str, scale: int, settings: Settings
) -> DataFrame:
    """Percentage and band, which are the same for every viewer of a site."""
    pct = percent(F.col(present), F.col(required), scale)
    return sites.withColumn("porcentaje_cobertura", pct).withColumn(
        "estado_semaforo", band(F.col("porcentaje_cobertura"), settings)
    )


def _site_columns(number: Column) -> list[Column]:
    return [
        F.col("porcentaje_cobertura"),
        F.col("estado_semaforo"),
        F.col("ppc"),
        F.col("tiene_faceid"),
        number.alias("faceid_numero"),
        F.col("ult_conexion").alias("faceid_ultima_conexion"),
    ]


def coverage_by_site(
    rollup: DataFrame,
    grants: DataFrame,
    devices: DataFrame,
    open_posts: DataFrame,
    scale: int = 2,
    settings: Settings = DEFAULTS,
    principals: Principals = None,
) -> DataFrame:
    """Coverage of every site a principal sees, with device and open posts."""
    require_columns(rollup, "rollup")
    visible = visible_client_sites(grants, principals)
    narrow = nearby(visible, principals)
    sites = narrow(rollup, CLIENT_SITE).groupBy(*SITE).agg(
        F.sum("total_guardias_requeridos").alias("requeridos"),
        F.sum("guardias_presentes").alias("presentes"),
        F.sum("turnos_cubiertos").alias("cubiertos"),
        F.sum("turnos_descubiertos").alias("descubiertos"),
    )
    rated = _rated(sites, "presentes", "requeridos", scale, settings)
    looked_up = _with_site_lookups(rated, devices, narrow(open_posts, ["instalacion_rol"]), narrow)
    times = F.col("accesos") * F.col("equipos")
    return visible.join(looked_up, CLIENT_SITE).select(
        "email_login",
        *SITE,
        (F.col("requeridos") * times).alias("total_guardias_requeridos"),
        (F.col("presentes") * times).alias("guardias_presentes"),
        ((F.col("requeridos") - F.col("presentes")) * times).alias("guardias_ausentes"),
        (F.col("cubiertos") * times).alias("turnos_cubiertos"),
        (F.col("descubiertos") * times).alias("turnos_descubiertos"),
        *_site_columns(none_if_empty(F.col("numero"))),
    )


def coverage_by_site_fast(
    rollup: DataFrame,
    grants: DataFrame,
    devices: DataFrame,
    open_posts: DataFrame,
    settings: Settings = DEFAULTS,
    principals: Principals = None,
) -> DataFrame:
    """The short form: one decimal, no shift counts, device number as stored."""
    require_columns(rollup, "rollup")
    visible = visible_client_sites(grants, principals)
    narrow = nearby(visible, principals)
    sites = narrow(rollup, CLIENT_SITE).groupBy(*SITE).agg(
        F.sum("total_guardias_requeridos").alias("requeridos"),
        F.sum("guardias_presentes").alias("presentes"),
    )
    rated = _rated(sites, "presentes", "requeridos", 1, settings)
    looked_up = _with_site_lookups(rated, devices, narrow(open_posts, ["instalacion_rol"]), narrow)
    times = F.col("accesos") * F.col("equipos")
    return visible.join(looked_up, CLIENT_SITE).select(
        "email_login",
        *SITE,
        (F.col("requeridos") * times).alias("total_guardias_requeridos"),
        (F.col("presentes") * times).alias("guardias_presentes"),
        ((F.col("requeridos") - F.col("presentes")) * times).alias("guardias_ausentes"),
        *_site_columns(F.col("numero")),
    )


def coverage_by_site_service(
    rollup: DataFrame,
    grants: DataFrame,
    devices: DataFrame,
    open_posts: DataFrame,
    settings: Settings = DEFAULTS,
    principals: Principals = None,
) -> DataFrame:
    """One row per rollup row, grant and device; nothing is summed."""
    require_columns(rollup, "rollup")
    visible = visible_rows(grants, principals)
    narrow = nearby(visible, principals)
    seen = narrow(rollup, CLIENT_SITE)
    rated = _rated(seen, "guardias_presentes", "total_guardias_requeridos", 1, settings)
    looked_up = _with_site_lookups(rated, devices, narrow(open_posts, ["instalacion_rol"]), narrow)
    # Devices that look alike stay separate rows here.
    repeated = looked_up.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("equipos"))))
    required, present = F.col("total_guardias_requeridos"), F.col("guardias_presentes")
    return visible.join(repeated, CLIENT_SITE).select(
        "email_login",
        *SITE,
        service_type(F.col("tipo_de_servicio")).alias("tipo_de_servicio"),
        required,
        present,
        (required - present).alias("guardias_ausentes"),
        *_site_columns(F.col("numero")),
    )
