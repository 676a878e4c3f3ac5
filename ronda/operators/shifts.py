"""Single shifts of the sites a principal sees.

The rows stay flat: a site may hold a large share of all shifts, so they are
never gathered into one array here.  ``nesting.nest_rows`` makes arrays of
bounded length where a caller wants them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ronda.functions.kpi import punctuality
from ronda.functions.text import last_part, service_type
from ronda.functions.time import clock
from ronda.operators import open_posts as posts
from ronda.operators.nesting import PAGE_ROWS, nest_rows
from ronda.operators.scope import (
    Principals,
    near,
    nearby,
    visible_client_sites,
    visible_rows,
    visible_sites,
)
from ronda.schemas import require_columns

CLIENT_SITE = ["cliente_rol", "instalacion_rol"]


def _line_columns() -> dict[str, Column]:
    return {
        "codigo_turno": F.col("turno"),
        "cargo": F.col("cargo"),
        "hora_entrada_planificada": clock(F.col("her")),
        "hora_salida_planificada": clock(F.col("hsr")),
        "rut_planificado": F.col("rutrol"),
        "rut_asistente": F.col("rutasi"),
        "hora_entrada_real": clock(F.col("entrada")),
        "hora_salida_real": clock(F.col("salida")),
        "asistio": F.coalesce(F.col("asistencia") != 0, F.lit(False)),
        "estado_cobertura": F.col("COB"),
        "turno_extra": F.col("tvf"),
        "tipo": F.col("tipo"),
        "motivo_incumplimiento": F.col("motivoppc"),
        "puntualidad": punctuality(),
    }


def shift_lines(shifts: DataFrame) -> DataFrame:
    """Readable shifts.  ``turno`` and ``her`` give the order within a site."""
    require_columns(shifts, "shifts")
    columns = _line_columns()
    columns["nombre_planificado"] = F.col("nombrerol")
    columns["nombre_asistente"] = last_part(F.col("relevo"))
    columns["tipo_de_servicio"] = service_type(F.col("tipo_de_servicio"), F.col("tipo"))
    return shifts.select(
        *CLIENT_SITE,
        "empresa",
        "turno",
        "her",
        *[column.alias(name) for name, column in columns.items()],
    )


def shift_detail(
    shifts: DataFrame, grants: DataFrame, principals: Principals = None
) -> DataFrame:
    """Shifts of every visible site, matched by site alone."""
    granted = visible_rows(grants, principals).select("email_login", "instalacion_rol")
    seen = near(shifts, granted, ["instalacion_rol"], principals)
    return shift_lines(seen).drop("cliente_rol").join(granted, "instalacion_rol")


def _site_lines(shifts: DataFrame, page_rows: int) -> DataFrame:
    """Pages of the shifts of each site, for all its viewers."""
    lines = shift_lines(shifts).drop("cliente_rol").filter(F.col("instalacion_rol").isNotNull())
    return nest_rows(lines, ["instalacion_rol"], ["turno", "her"], "lineas", page_rows)


def _lines_shown() -> Column:
    """A shift as often as the site was granted."""
    repeated = F.flatten(
        F.transform("lineas", lambda line: F.array_repeat(line, F.col("accesos").cast("int")))
    )
    return F.when(F.col("accesos") == 1, F.col("lineas")).otherwise(repeated).alias("turnos")


def shift_pages(
    shifts: DataFrame, grants: DataFrame, principals: Principals = None, page_rows: int = PAGE_ROWS
) -> DataFrame:
    """Shifts of a site as ordered arrays of bounded length.

    The arrays are made once per site and then handed to its viewers; a shift
    appears as often as the site was granted.
    """
    visible = visible_sites(grants, principals)
    pages = _site_lines(near(shifts, visible, ["instalacion_rol"], principals), page_rows)
    return visible.join(pages, "instalacion_rol").select(
        "email_login", "instalacion_rol", "pagina", _lines_shown()
    )


def _first_companies(shifts: DataFrame, site: list[str]) -> DataFrame:
    """Shift count per site, with the first shift and the first whose company
    is known.  Equal starts are counted first, so that only few rows are left
    to be put in order, however many shifts a site has."""
    starts = shifts.groupBy(*site, "turno", "her", "empresa").agg(F.count(F.lit(1)).alias("n"))
    start = F.struct("turno", "her", "empresa")
    return starts.groupBy(*site).agg(
        F.min(start).alias("primero"),
        F.min(F.when(F.col("empresa").isNotNull(), start)).alias("conocido"),
        F.sum("n").alias("turnos"),
    )


def shift_sites(
    shifts: DataFrame, open_posts: DataFrame, grants: DataFrame, principals: Principals = None
) -> DataFrame:
    """One row per principal and site with shifts or open posts.

    The company is that of the first shift, even if it is null; a site that
    has open posts only is present without one.
    """
    require_columns(shifts, "shifts")
    visible = visible_sites(grants, principals)
    seen = _sites_seen(shifts, open_posts, visible, nearby(visible, principals))
    return seen.drop("accesos")


def _sites_seen(
    shifts: DataFrame, open_posts: DataFrame, visible: DataFrame, narrow: Callable[[DataFrame, list[str]], DataFrame]
) -> DataFrame:
    """Viewers of each site with its company and totals."""
    key = ["instalacion_rol"]
    by_shift = _first_companies(narrow(shifts, key), key)
    by_post = posts.per_site(narrow(open_posts, key))
    sites = by_shift.join(by_post, "instalacion_rol", "full_outer")
    return visible.join(sites, "instalacion_rol").select(
        "email_login",
        "instalacion_rol",
        "accesos",
        F.col("primero.empresa").alias("empresa"),
        (F.coalesce("turnos", F.lit(0)) * F.col("accesos")).alias("total_turnos"),
        (F.coalesce("cantidad_ppc", F.lit(0)) * F.col("accesos")).alias("total_ppc"),
    )


def site_pages(
    shifts: DataFrame,
    open_posts: DataFrame,
    grants: DataFrame,
    principals: Principals = None,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """The detail of every visible site as one report: shifts, open slots with their working day, and totals.

    One row per principal, site and page; ``turnos`` and ``ppc_por_turno`` are null
    on pages that only the other of them reaches, and company and totals of
    :func:`shift_sites` stand on each page.  Pages are put together once per site;
    no array is moved once it was handed to a viewer.
    """
    require_columns(open_posts, "open_posts")
    key = ["instalacion_rol"]
    visible = visible_sites(grants, principals)
    narrow = nearby(visible, principals)
    lines = _site_lines(narrow(shifts, key), page_rows)
    slots = posts.site_slots(narrow(open_posts, key), True, page_rows)
    pages = lines.join(slots, [*key, "pagina"], "full_outer")
    seen = _sites_seen(shifts, open_posts, visible, narrow)
    return seen.join(pages, key).select(
        "email_login",
        "instalacion_rol",
        "pagina",
        _lines_shown(),
        posts.slots_shown(slots).alias("ppc_por_turno"),
        "empresa",
        "total_turnos",
        "total_ppc",
    )


def site_shift_detail(
    shifts: DataFrame,
    grants: DataFrame,
    site: str | None = None,
    principals: Principals = None,
) -> DataFrame:
    """Shifts of one site (or of each), matched by client and site.

    The relief text stays as stored and service and names are left out.
    """
    require_columns(shifts, "shifts")
    if site is not None:
        shifts = shifts.filter(F.col("instalacion_rol") == site)
    granted = visible_rows(grants, principals)
    lines = near(shifts, granted, CLIENT_SITE, principals).select(
        *CLIENT_SITE,
        "empresa",
        "turno",
        "her",
        "relevo",
        *[column.alias(name) for name, column in _line_columns().items()],
    )
    return lines.join(granted, CLIENT_SITE)


def site_shift_totals(
    shifts: DataFrame,
    grants: DataFrame,
    site: str | None = None,
    principals: Principals = None,
) -> DataFrame:
    """Header of :func:`site_shift_detail`: first known company and total."""
    require_columns(shifts, "shifts")
    if site is not None:
        shifts = shifts.filter(F.col("instalacion_rol") == site)
    visible = visible_client_sites(grants, principals)
    sites = _first_companies(near(shifts, visible, CLIENT_SITE, principals), CLIENT_SITE)
    return (
        visible.join(sites, CLIENT_SITE)
        .groupBy("email_login", "instalacion_rol")
        .agg(
            F.min("conocido").alias("conocido"),
            F.sum(F.col("turnos") * F.col("accesos")).alias("total_turnos"),
        )
        .select(
            "email_login",
            "instalacion_rol",
            F.col("conocido.empresa").alias("empresa"),
            "total_turnos",
        )
    )
