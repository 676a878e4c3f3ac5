"""Posts still to be filled, in total and by time slot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ronda.functions.time import clock, slot_label
from ronda.operators.nesting import PAGE_ROWS, nest_rows
from ronda.operators.scope import Principals, near, principal_frame, visible_sites
from ronda.schemas import require_columns


def per_site(open_posts: DataFrame) -> DataFrame:
    require_columns(open_posts, "open_posts")
    return open_posts.groupBy("instalacion_rol").agg(F.count(F.lit(1)).alias("cantidad_ppc"))


def seen_posts(
    open_posts: DataFrame, grants: DataFrame, principals: Principals = None
) -> DataFrame:
    """Open posts at the sites each principal sees, for those that see any."""
    visible = visible_sites(grants, principals)
    return posts_seen(near(open_posts, visible, ["instalacion_rol"], principals), visible)


def posts_seen(open_posts: DataFrame, visible: DataFrame) -> DataFrame:
    """The same over the sites of :func:`scope.by_site`."""
    return visible.join(per_site(open_posts), "instalacion_rol").groupBy("email_login").agg(
        F.sum(F.col("cantidad_ppc") * F.col("accesos")).alias("total_ppc")
    )


def open_posts_total(
    open_posts: DataFrame, grants: DataFrame, principals: Principals = None
) -> DataFrame:
    """As above, with 0 for the principals who see none."""
    asked = principal_frame(grants, principals)
    totals = seen_posts(open_posts, grants, principals)
    return asked.join(totals, "email_login", "left").select(
        "email_login", F.coalesce("total_ppc", F.lit(0)).alias("total_ppc")
    )


def _slots(open_posts: DataFrame, with_working_day: bool) -> DataFrame:
    """Slots of each site with their labels, before any viewer is known."""
    slot = ["turno", *(["jornada"] if with_working_day else []), "her", "hsr"]
    counted = open_posts.groupBy("instalacion_rol", *slot).agg(F.count(F.lit(1)).alias("puestos"))
    return counted.withColumns(
        {
            "hora_entrada": clock(F.col("her")),
            "hora_salida": clock(F.col("hsr")),
            "horario": slot_label(F.col("her"), F.col("hsr")),
        }
    )


def open_posts_by_slot(
    open_posts: DataFrame,
    grants: DataFrame,
    site: str | None = None,
    with_working_day: bool = False,
    principals: Principals = None,
) -> DataFrame:
    """Open posts per site, shift, start and end.

    Slots are told apart by the full start and end, so two of them may carry
    the same clock label.
    """
    require_columns(open_posts, "open_posts")
    if site is not None:
        open_posts = open_posts.filter(F.col("instalacion_rol") == site)
    visible = visible_sites(grants, principals)
    near_by = near(open_posts, visible, ["instalacion_rol"], principals)
    slots = _slots(near_by, with_working_day)
    seen = visible.join(slots, "instalacion_rol")
    return seen.withColumn("cantidad_ppc", F.col("puestos") * F.col("accesos")).select(
        "email_login", *[c for c in slots.columns if c != "puestos"], "cantidad_ppc"
    )


def open_posts_nested(
    open_posts: DataFrame,
    grants: DataFrame,
    with_working_day: bool = False,
    principals: Principals = None,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """Slots of a site as an ordered array (see :func:`nesting.nest_rows`).

    The arrays are made once per site and then handed to its viewers.
    """
    require_columns(open_posts, "open_posts")
    visible = visible_sites(grants, principals)
    near_by = near(open_posts, visible, ["instalacion_rol"], principals)
    nested = site_slots(near_by, with_working_day, page_rows)
    return visible.join(nested, "instalacion_rol").select(
        "email_login", "instalacion_rol", "pagina", slots_shown(nested).alias("ppc_por_turno")
    )


def site_slots(open_posts: DataFrame, with_working_day: bool, page_rows: int) -> DataFrame:
    """Pages of the slots of each site, for all its viewers."""
    slots = _slots(open_posts, with_working_day).filter(F.col("instalacion_rol").isNotNull())
    return nest_rows(slots, ["instalacion_rol"], ["her", "hsr", "turno"], "slots", page_rows)


def slots_shown(nested: DataFrame) -> Column:
    """What a viewer sees of the slots in a page of :func:`site_slots`."""
    fields = nested.schema["slots"].dataType.elementType.fieldNames()
    labels = [c for c in fields if c not in ("her", "hsr", "puestos")]

    def shown(slot: Column) -> Column:
        amount = (slot["puestos"] * F.col("accesos")).alias("cantidad_ppc")
        return F.struct(*[slot[c].alias(c) for c in labels], amount)

    return F.transform("slots", shown)


def open_posts_by_site(slots: DataFrame) -> DataFrame:
    """Site totals over the slots of :func:`open_posts_by_slot`."""
    return slots.groupBy("email_login", "instalacion_rol").agg(
        F.sum("cantidad_ppc").alias("total_ppc"), F.count(F.lit(1)).alias("total_horarios")
    )
