"""Contacts of sites and participants of site conversations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ronda import fixed_values as fv
from ronda.functions.text import filled, strip
from ronda.operators.scope import Principals, restrict, visible_rows
from ronda.operators.updates import one_of_each
from ronda.schemas import require_columns

CONTACT_SITE = ["contacto_id", "instalacion_rol"]
PERSON = ["email_login", "firebase_uid", "nombre_completo", "rol_id"]


def site_contacts(
    grants: DataFrame,
    site_contacts: DataFrame,
    contacts: DataFrame,
    site: str | None = None,
    principals: Principals = None,
) -> DataFrame:
    """Active contacts of the sites each principal sees."""
    require_columns(site_contacts, "site_contacts")
    require_columns(contacts, "contacts")
    if site is not None:
        site_contacts = site_contacts.filter(F.col("instalacion_rol") == site)
    active = contacts.filter("activo").select(
        "contacto_id", F.col("nombre_contacto").alias("nombre"), "telefono", "cargo", "email"
    )
    placed = site_contacts.select("cliente_rol", *CONTACT_SITE).join(active, "contacto_id")
    return visible_rows(grants, principals).join(placed, ["cliente_rol", "instalacion_rol"]).select(
        "email_login", "instalacion_rol", "contacto_id", "nombre", "telefono", "cargo", "email"
    )


def assigned_circles(
    user_contacts: DataFrame, site_contacts: DataFrame, perms: DataFrame
) -> DataFrame:
    """Reachable members of every (contact, site) two people may share.

    One row per circle and member: as large as the assignments themselves,
    however many people share a circle.
    """
    require_columns(user_contacts, "user_contacts")
    reachable = perms.filter("usuario_activo").filter(filled(F.col("firebase_uid"))).select(
        *PERSON, "cliente_rol"
    )
    members = user_contacts.select("email_login", *CONTACT_SITE).distinct()
    linked = site_contacts.select(*CONTACT_SITE).distinct()
    return members.join(linked, CONTACT_SITE, "left_semi").join(reachable, "email_login")


def co_assigned_contacts(
    user_contacts: DataFrame,
    site_contacts: DataFrame,
    perms: DataFrame,
    principals: str | Sequence[str] | DataFrame,
) -> DataFrame:
    """Other reachable people in the circles of the principals who ask.

    The askers have to be named.  Each gets the members of that person's own
    circles, so the work follows the askers and no circle is paired with
    itself for everybody.
    """
    circles = assigned_circles(user_contacts, site_contacts, perms)
    asked = restrict(user_contacts.select("email_login", *CONTACT_SITE), principals).distinct()
    asker = asked.select(F.col("email_login").alias("solicitante"), *CONTACT_SITE)
    pairs = (
        circles.select("email_login", *CONTACT_SITE)
        .join(asker, CONTACT_SITE)
        .filter(F.col("email_login") != F.col("solicitante"))
        .select("solicitante", "email_login")
        .distinct()
    )
    people = perms.filter("usuario_activo").filter(filled(F.col("firebase_uid"))).select(
        *PERSON, "cliente_rol"
    )
    return pairs.join(people, "email_login").select("solicitante", *PERSON, "cliente_rol")


def own_or_admin(asks: DataFrame, perms: DataFrame) -> DataFrame:
    """Asks (``email_login`` about ``sobre``) that are allowed: about oneself,
    or made by an administrator."""
    admin = F.coalesce(F.col("es_admin"), F.lit(False))
    rights = perms.filter("usuario_activo").select("email_login", admin.alias("_admin"))
    allowed = asks.join(rights, "email_login")
    return allowed.filter((F.col("email_login") == F.col("sobre")) | F.col("_admin")).drop("_admin")


def _has_uid() -> Column:
    return F.coalesce(strip(F.col("firebase_uid")) != "", F.lit(False))


def _app_contacts(site_contacts: DataFrame, contacts: DataFrame) -> DataFrame:
    app = contacts.filter("activo and es_usuario_app").select(
        "contacto_id", F.col("email_usuario_app").alias("email_login")
    )
    return site_contacts.select(*CONTACT_SITE).join(app, "contacto_id")


def site_participants(
    site_contacts: DataFrame,
    contacts: DataFrame,
    grants: DataFrame,
    perms: DataFrame,
    sites: Sequence[str] | None = None,
) -> DataFrame:
    """Staff through site contacts and clients through grants, per site.

    ``con_uid`` tells who can be written to.  An empty list of sites gives an
    empty result.
    """
    for df, table in ((site_contacts, "site_contacts"), (contacts, "contacts")):
        require_columns(df, table)
    require_columns(grants, "grants")
    require_columns(perms, "perms")
    if sites is not None:
        chosen = F.col("instalacion_rol").isin(list(sites))
        site_contacts, grants = site_contacts.filter(chosen), grants.filter(chosen)
    active = perms.filter("usuario_activo").select(*PERSON)
    staff = (
        _app_contacts(site_contacts, contacts)
        .join(active.filter(F.col("rol_id") != fv.ROLE_CLIENT), "email_login")
        .select("instalacion_rol", *PERSON)
    )
    clients = (
        grants.select("email_login", "instalacion_rol")
        .join(active.filter(F.col("rol_id") == fv.ROLE_CLIENT), "email_login")
        .select("instalacion_rol", *PERSON)
    )
    return staff.unionByName(clients).distinct().withColumn("con_uid", _has_uid())


def participants_across_sites(participants: DataFrame) -> DataFrame:
    """The same people once each, over all the sites given."""
    return participants.select(*PERSON, "con_uid").distinct()


def participant_funnel(
    site_contacts: DataFrame, contacts: DataFrame, grants: DataFrame, perms: DataFrame
) -> DataFrame:
    """Per site, how many rows survive each step towards a participant."""
    active = perms.filter("usuario_activo").filter(filled(F.col("firebase_uid")))
    is_staff = F.col("rol_id") != fv.ROLE_CLIENT
    is_client = F.col("rol_id") == fv.ROLE_CLIENT
    linked = site_contacts.groupBy("instalacion_rol").agg(
        F.count(F.lit(1)).alias("filas_contacto")
    )
    granted = grants.groupBy("instalacion_rol").agg(F.count(F.lit(1)).alias("filas_permiso"))
    app = _app_contacts(site_contacts, contacts)
    staff = active.filter(is_staff).select("email_login", F.lit(True).alias("valido"))
    reached = (
        app.select("instalacion_rol", "email_login")
        .distinct()
        .join(staff, "email_login", "left")
        .groupBy("instalacion_rol")
        .agg(
            F.count("email_login").alias("contactos_app"),
            F.count("valido").alias("personal_valido"),
        )
    )
    clients = (
        grants.select("instalacion_rol", "email_login")
        .distinct()
        .join(active.filter(is_client).select("email_login"), "email_login", "left_semi")
        .groupBy("instalacion_rol")
        .agg(F.count(F.lit(1)).alias("clientes_validos"))
    )
    steps = linked
    for step in (granted, reached, clients):
        steps = steps.join(step, "instalacion_rol", "full_outer")
    counts = ["filas_contacto", "filas_permiso", "contactos_app", "personal_valido"]
    return steps.select(
        "instalacion_rol",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in (*counts, "clientes_validos")],
    )


def participant_samples(
    site_contacts: DataFrame, contacts: DataFrame, site: str, rows: int = 5
) -> DataFrame:
    """A few contact rows of one site with what the contact table says."""
    linked = (
        site_contacts.filter(F.col("instalacion_rol") == site)
        .orderBy("contacto_id", "cliente_rol")
        .limit(rows)
    )
    known = contacts.select(
        "contacto_id",
        "email_usuario_app",
        "activo",
        "es_usuario_app",
        F.lit(True).alias("existe"),
    )
    return linked.join(known, "contacto_id", "left").withColumn(
        "existe", F.coalesce("existe", F.lit(False))
    )


LINKED, APP, LOGIN = "contacto", "usuario_app", "permisos"


def site_samples(
    site_contacts: DataFrame,
    contacts: DataFrame,
    perms: DataFrame,
    site: str | None = None,
    linked_rows: int = 5,
    app_rows: int = 10,
) -> DataFrame:
    """What to look at where :func:`participant_funnel` shows a site without participants, for every site.

    (instalacion_rol, muestra, n, contacto_id, cliente_rol, email_usuario_app,
    activo, es_usuario_app, existe, rol_id, firebase_uid).  ``contacto`` are the first
    contact rows of the site with what the contact table says of them,
    ``usuario_app`` the first of its distinct active app users, ``permisos`` the
    permission row, if there is one, of the first of these with an address.
    First is by contact, client and address.  Of contacts and permission rows that
    repeat their key the first by all columns counts.

    Only the first rows of a group leave a task before they are shuffled, and
    only these are joined to anything.
    """
    require_columns(site_contacts, "site_contacts")
    require_columns(contacts, "contacts")
    if site is not None:
        site_contacts = site_contacts.filter(F.col("instalacion_rol") == site)

    def first_of(rows: DataFrame, order: list[str], most: int) -> DataFrame:
        nth = F.row_number().over(W.partitionBy("instalacion_rol").orderBy(*order))
        return rows.withColumn("n", nth).filter(F.col("n") <= most)

    known = contacts.select("contacto_id", "email_usuario_app", "activo", "es_usuario_app", F.lit(True).alias("existe"))
    single = one_of_each(known, "contacto_id", ["email_usuario_app"])
    links = site_contacts.select("instalacion_rol", "contacto_id", "cliente_rol")
    linked = first_of(links, ["contacto_id", "cliente_rol"], linked_rows).join(single, "contacto_id", "left")
    app = known.filter("activo and es_usuario_app").select("contacto_id", "email_usuario_app").distinct()
    users = links.select("instalacion_rol", "contacto_id").distinct().join(app, "contacto_id")
    sampled = first_of(users, ["contacto_id", "email_usuario_app"], app_rows)
    login = sampled.filter(F.col("n") == 1).filter(filled(F.col("email_usuario_app")))
    rights = one_of_each(
        perms.select(F.col("email_login").alias("email_usuario_app"), "rol_id", "firebase_uid", F.col("usuario_activo").alias("activo")),
        "email_usuario_app",
        ["rol_id"],
    ).withColumn("existe", F.lit(True))
    permission = login.select("instalacion_rol", "n", "contacto_id", "email_usuario_app").join(rights, "email_usuario_app", "left")
    columns = {
        "cliente_rol": "string", "activo": "boolean", "es_usuario_app": "boolean", "existe": "boolean", "rol_id": "string", "firebase_uid": "string",
    }

    def shown(rows: DataFrame, sample: str) -> DataFrame:
        rest = [F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns.items() if c != "existe"]
        there = F.coalesce("existe", F.lit(False)) if "existe" in rows.columns else F.lit(True)
        return rows.select("instalacion_rol", F.lit(sample).alias("muestra"), "n", "contacto_id", "email_usuario_app", *rest, there.alias("existe"))

    return shown(linked, LINKED).unionByName(shown(sampled, APP)).unionByName(shown(permission, LOGIN))
