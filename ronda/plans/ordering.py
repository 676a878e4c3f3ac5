"""Row order of each report.

Operators return sets.  A caller who needs the order adds it at the end; for
all principals together it starts with the principal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A minus sign stands for descending order.
REPORT_ORDER: dict[str, tuple[str, ...]] = {
    "coverage_by_site": ("-guardias_ausentes", "porcentaje_cobertura", "instalacion_rol"),
    "coverage_by_site_fast": ("-guardias_ausentes", "porcentaje_cobertura"),
    "coverage_by_site_service": ("instalacion_rol", "tipo_de_servicio", "-guardias_ausentes"),
    "shift_detail": ("instalacion_rol", "turno", "her"),
    "site_shift_detail": ("turno", "her"),
    "weekly_fulfilment": ("ano", "isoweek"),
    "site_week_fulfilment": ("-ano", "-isoweek", "instalacion_rol"),
    "open_posts_by_slot": ("instalacion_rol", "her", "hsr"),
    "survey_inbox": ("instalacion_rol", "modo", "-fecha_creacion"),
    "active_questions": ("orden",),
    "survey_answers": ("orden",),
    "site_contacts": ("nombre",),
    "co_assigned_contacts": ("nombre_completo",),
    "site_participants": ("nombre_completo",),
    "inbox": ("-fecha_envio", "-mensaje_id"),
}


# Lists of people, where email_login is the person found and not the asker.
_PEOPLE = {"co_assigned_contacts": ["solicitante"], "site_participants": []}


def order_keys(df: DataFrame, report: str) -> list[tuple[str, bool]]:
    """(column, descending) of a report's order; for all principals together it starts with the principal."""
    lead = _PEOPLE.get(report, [c for c in ("email_login",) if c in df.columns])
    return [(c, False) for c in lead] + [(c.removeprefix("-"), c.startswith("-")) for c in REPORT_ORDER[report]]


def in_report_order(df: DataFrame, report: str) -> DataFrame:
    return df.orderBy(*[F.desc(c) if descending else F.asc(c) for c, descending in order_keys(df, report)])
