"""The registered queries: operators over the stand-in tables.

Moments are given as text and amounts rounded, so that results compare; 
queries run over the whole of their tables and for all principals, except where
what is asked for is one principal, one site or one message: those names are
taken from the tables.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ronda import fixed_values as fv
from ronda.operators import (
    contacts,
    coverage,
    fulfilment,
    messaging,
    open_posts,
    scope,
    shifts,
    submissions,
    summaries,
    surveys,
    updates,
)
from ronda.functions.time import month_keys, months_between
from ronda.plans import jobs
from ronda.plans.places import with_places
from ronda.session import prepare
from ronda.sources import standin
from ronda.sources.scratch import new_path
from ronda.sources.standin import StandIn

Query = Callable[[SparkSession, str], DataFrame]
# Small, so that sites have several pages.
SHIFT_PAGE_ROWS, SLOT_PAGE_ROWS, SURVEY_PAGE_ROWS, SITE_PAGE_ROWS = 16, 4, 3, 8
QUERIES: dict[str, Callable[[StandIn], DataFrame]] = {}


def _register(build: Callable[[StandIn], DataFrame]) -> Callable[[StandIn], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _moment(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _texts(df: DataFrame, *moments: str) -> DataFrame:
    return df.withColumns({m: _moment(m) for m in moments})


def _rounded(df: DataFrame, *amounts: str) -> DataFrame:
    return df.withColumns({a: F.round(a, 2) for a in amounts})


HOURS = ("horas_presupuestadas", "horas_entregadas", "horas_faltantes")


@_register
def permission_profile(t: StandIn) -> DataFrame:
    profile = scope.permission_profile(t.perms())
    flags = [F.col(f"permisos.{flag}").alias(flag) for flag in fv.PERMISSION_FLAGS]
    return profile.select(*scope.PROFILE, *flags, "ver_todas_instalaciones")


@_register
def permitted_principals(t: StandIn) -> DataFrame:
    """Everyone permitted, for each flag and for none."""
    perms = t.perms()
    parts = [
        scope.permitted(perms, flag).withColumn("permiso", F.lit(flag or "activo"))
        for flag in (None, *fv.PERMISSION_FLAGS)
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@_register
def coverage_overall(t: StandIn) -> DataFrame:
    allowed = scope.permitted(t.perms(), "puede_ver_cobertura")
    overall = coverage.coverage_overall(
        t.rollup(), t.grants(), t.open_posts(), principals=allowed
    )
    flat = overall.withColumn("empresas", F.concat_ws(",", "empresas"))
    return _texts(flat, "ultima_actualizacion", "proxima_actualizacion")


@_register
def coverage_by_site(t: StandIn) -> DataFrame:
    sites = coverage.coverage_by_site(t.rollup(), t.grants(), t.devices(), t.open_posts())
    return _texts(sites, "faceid_ultima_conexion")


@_register
def coverage_by_site_fast(t: StandIn) -> DataFrame:
    sites = coverage.coverage_by_site_fast(t.rollup(), t.grants(), t.devices(), t.open_posts())
    return _texts(sites, "faceid_ultima_conexion")


@_register
def coverage_by_site_service(t: StandIn) -> DataFrame:
    rows = coverage.coverage_by_site_service(
        t.rollup(), t.grants(), t.devices(), t.open_posts()
    )
    return _texts(rows, "faceid_ultima_conexion")


@_register
def coverage_by_site_gated(t: StandIn) -> DataFrame:
    """Only for those who may see coverage."""
    allowed = scope.permitted(t.perms(), "puede_ver_cobertura")
    sites = coverage.coverage_by_site(
        t.rollup(), t.grants(), t.devices(), t.open_posts(), principals=allowed
    )
    return sites.select(
        "email_login", "instalacion_rol", "guardias_ausentes", "porcentaje_cobertura", "ppc"
    )


@_register
def coverage_by_site_placed(t: StandIn) -> DataFrame:
    """The whole report with the place of each row in its order."""
    sites = coverage.coverage_by_site(t.rollup(), t.grants(), t.devices(), t.open_posts())
    placed = with_places(
        _texts(sites, "faceid_ultima_conexion").select(
            "email_login",
            "instalacion_rol",
            "cliente_rol",
            "guardias_ausentes",
            "porcentaje_cobertura",
            "faceid_numero",
        ),
        "coverage_by_site",
    )
    return placed


@_register
def coverage_rollup(t: StandIn) -> DataFrame:
    return _texts(coverage.coverage_rollup(t.shifts()), "ultima_actualizacion")


@_register
def coverage_rollup_refreshed(t: StandIn) -> DataFrame:
    """The rollup from stored parts, of which those of the last day were out of date and then refreshed."""
    stored = new_path(t.spark, "shifts")
    by_day = t.shifts().withColumn(coverage.PART_DAY, F.to_date("her"))
    by_day.hint("rebalance", coverage.PART_DAY).write.partitionBy(coverage.PART_DAY).parquet(stored)
    shifts = t.spark.read.schema(by_day.schema).parquet(stored)
    last = shifts.agg(F.max(coverage.PART_DAY)).first()[0]
    before = shifts.withColumn("asistencia", F.when(F.col(coverage.PART_DAY) < F.lit(last), F.col("asistencia")))
    parts = new_path(t.spark, "rollup_parts")
    jobs.refresh_rollup_parts(before, parts)
    jobs.refresh_rollup_parts(shifts, parts, [last] if last else [])
    return _texts(coverage.rollup_of_parts(t.spark.read.parquet(parts)), "ultima_actualizacion")


@_register
def shift_lines(t: StandIn) -> DataFrame:
    return _texts(shifts.shift_lines(t.shifts()), "her")


@_register
def shift_detail(t: StandIn) -> DataFrame:
    return shifts.shift_detail(t.shifts(), t.grants()).select(
        "email_login",
        "instalacion_rol",
        "codigo_turno",
        "hora_entrada_planificada",
        "nombre_asistente",
        "asistio",
        "tipo_de_servicio",
        "puntualidad",
    )


@_register
def shift_pages(t: StandIn) -> DataFrame:
    """Arrays of shifts, shown by their length and the starts they list."""
    pages = shifts.shift_pages(t.shifts(), t.grants(), page_rows=SHIFT_PAGE_ROWS)
    starts = F.transform(
        "turnos", lambda s: F.concat(s["codigo_turno"], F.lit("@"), s["hora_entrada_planificada"])
    )
    return pages.select(
        "email_login",
        "instalacion_rol",
        "pagina",
        F.size("turnos").cast("long").alias("total_turnos"),
        F.array_join(starts, ",").alias("inicios"),
    )


@_register
def site_pages(t: StandIn) -> DataFrame:
    """Pages of the whole site detail, shown by their lengths and the slots they list."""
    pages = shifts.site_pages(t.shifts(), t.open_posts(), t.grants(), page_rows=SITE_PAGE_ROWS)
    slots = F.transform(
        "ppc_por_turno", lambda s: F.concat_ws("@", s["turno"], s["jornada"], s["hora_entrada"], s["cantidad_ppc"])
    )
    return pages.select(
        "email_login",
        "instalacion_rol",
        "pagina",
        "empresa",
        "total_turnos",
        "total_ppc",
        F.coalesce(F.size("turnos"), F.lit(0)).cast("long").alias("turnos_en_pagina"),
        F.coalesce(F.array_join(slots, ","), F.lit("")).alias("horarios"),
    )


@_register
def shift_sites(t: StandIn) -> DataFrame:
    return shifts.shift_sites(t.shifts(), t.open_posts(), t.grants())


@_register
def site_shift_detail(t: StandIn) -> DataFrame:
    return shifts.site_shift_detail(t.shifts(), t.grants()).select(
        "email_login",
        "cliente_rol",
        "instalacion_rol",
        "codigo_turno",
        "hora_salida_real",
        "relevo",
        "rut_asistente",
        "puntualidad",
    )


@_register
def site_shift_totals(t: StandIn) -> DataFrame:
    return shifts.site_shift_totals(t.shifts(), t.grants())


@_register
def weekly_fulfilment(t: StandIn) -> DataFrame:
    weeks = fulfilment.weekly_fulfilment(t.history(), t.grants(), standin.AS_OF, standin.DAYS)
    named = weeks.withColumns(
        {d: F.date_format(d, "yyyy-MM-dd") for d in ("fecha_inicio", "fecha_fin")}
    )
    return _rounded(named, *HOURS)


@_register
def site_week_fulfilment(t: StandIn) -> DataFrame:
    weeks = fulfilment.site_week_fulfilment(t.history(), t.grants(), standin.AS_OF, standin.DAYS)
    return _rounded(weeks, *HOURS)


def _fulfilment_of_days(t: StandIn) -> summaries.Fulfilment:
    """From stored days and guards of the months that the window touches; the last month is written again."""
    store = new_path(t.spark, "summaries")
    months = months_between(*month_keys(standin.AS_OF, standin.DAYS))
    jobs.refresh_summaries(t.history(), store, months)
    jobs.refresh_summaries(t.history(), store, months[-1:])
    days, guards = (t.spark.read.parquet(f"{store}/{name}") for name in ("site_days", "site_guards"))
    return summaries.fulfilment_of(days, guards, t.grants(), standin.AS_OF, standin.DAYS)


@_register
def weekly_fulfilment_of_days(t: StandIn) -> DataFrame:
    weeks = _fulfilment_of_days(t).weekly
    named = weeks.withColumns(
        {d: F.date_format(d, "yyyy-MM-dd") for d in ("fecha_inicio", "fecha_fin")}
    )
    return _rounded(named, *HOURS)


@_register
def site_week_fulfilment_of_days(t: StandIn) -> DataFrame:
    return _rounded(_fulfilment_of_days(t).by_site, *HOURS)


@_register
def open_posts_total(t: StandIn) -> DataFrame:
    allowed = scope.permitted(t.perms(), "puede_ver_cobertura")
    return open_posts.open_posts_total(t.open_posts(), t.grants(), allowed)


@_register
def open_posts_by_slot(t: StandIn) -> DataFrame:
    return open_posts.open_posts_by_slot(t.open_posts(), t.grants()).drop("her", "hsr")


@_register
def open_posts_by_slot_and_day(t: StandIn) -> DataFrame:
    slots = open_posts.open_posts_by_slot(t.open_posts(), t.grants(), with_working_day=True)
    return slots.drop("her", "hsr")


@_register
def open_posts_by_site(t: StandIn) -> DataFrame:
    return open_posts.open_posts_by_site(
        open_posts.open_posts_by_slot(t.open_posts(), t.grants())
    )


@_register
def open_posts_nested(t: StandIn) -> DataFrame:
    """Nested slots, taken apart again with their place in the array."""
    nested = open_posts.open_posts_nested(t.open_posts(), t.grants(), page_rows=SLOT_PAGE_ROWS)
    placed = nested.select(
        "email_login", "instalacion_rol", "pagina", F.posexplode("ppc_por_turno").alias("n", "s")
    )
    return placed.select(
        "email_login",
        "instalacion_rol",
        "pagina",
        (F.col("n") + 1).alias("puesto"),
        F.col("s.turno").alias("turno"),
        F.col("s.horario").alias("horario"),
        F.col("s.cantidad_ppc").alias("cantidad_ppc"),
    )


@_register
def survey_inbox(t: StandIn) -> DataFrame:
    inbox = surveys.survey_inbox(
        t.survey_requests(), t.grants(), t.perms(), standin.AS_OF, standin.INBOX_STAFF
    )
    return _texts(inbox, "fecha_creacion", "fecha_limite", "fecha_respuesta")


@_register
def survey_inbox_by_site(t: StandIn) -> DataFrame:
    sites = surveys.survey_inbox_by_site(
        t.survey_requests(), t.grants(), t.perms(), standin.AS_OF, standin.INBOX_STAFF
    )
    return _texts(sites, "fecha_vencimiento_proxima")


@_register
def survey_pages(t: StandIn) -> DataFrame:
    """Nested surveys, taken apart again with their place in the page."""
    pages = surveys.survey_pages(
        t.survey_requests(),
        t.grants(),
        t.perms(),
        standin.AS_OF,
        standin.INBOX_STAFF,
        page_rows=SURVEY_PAGE_ROWS,
    )
    placed = pages.select(
        "email_login", "instalacion_rol", "pagina", F.posexplode("encuestas").alias("n", "e")
    )
    return placed.select(
        "email_login",
        "instalacion_rol",
        "pagina",
        (F.col("n") + 1).alias("puesto"),
        *[F.col(f"e.{c}").alias(c) for c in ("encuesta_id", "modo", "estado")],
        F.date_format("e.fecha_creacion", "yyyy-MM-dd HH:mm:ss").alias("fecha_creacion"),
        *[F.col(f"e.{c}").alias(c) for c in ("puede_responder", "puede_ver_respuestas")],
    )


@_register
def survey_form_headers(t: StandIn) -> DataFrame:
    form = surveys.survey_form(t.survey_asks(), t.survey_requests(), t.grants(), t.questions())
    return _texts(form.headers, "fecha_limite")


@_register
def survey_form_questions(t: StandIn) -> DataFrame:
    form = surveys.survey_form(t.survey_asks(), t.survey_requests(), t.grants(), t.questions())
    return form.questions


@_register
def survey_answers(t: StandIn) -> DataFrame:
    return surveys.survey_answers(t.survey_requests(), t.answers(), t.questions())


@_register
def survey_answer_access(t: StandIn) -> DataFrame:
    access = surveys.answer_access(
        t.survey_asks(), t.survey_requests(), t.perms(), standin.ANSWER_STAFF
    )
    return _texts(access, "fecha_respuesta")


@_register
def survey_answers_shown(t: StandIn) -> DataFrame:
    access = surveys.answer_access(
        t.survey_asks(), t.survey_requests(), t.perms(), standin.ANSWER_STAFF
    )
    answers = surveys.survey_answers(t.survey_requests(), t.answers(), t.questions())
    return surveys.answers_for(access, answers)


def _decisions(t: StandIn, wanted: Sequence[str]) -> DataFrame:
    return submissions.decide_submissions(t.submissions(), t.survey_requests(), t.perms(), wanted=wanted)


@_register
def submission_decisions(t: StandIn) -> DataFrame:
    return _decisions(t, ("submission_id", "encuesta_id", "email", "resultado", "cierra"))


@_register
def submission_answers(t: StandIn) -> DataFrame:
    return _texts(submissions.submission_answers(_decisions(t, submissions.FOR_ANSWERS)), "fecha_respuesta")


@_register
def submission_rejections(t: StandIn) -> DataFrame:
    return _texts(submissions.submission_rejections(_decisions(t, submissions.FOR_REJECTIONS)), "arrival")


@_register
def submission_requests(t: StandIn) -> DataFrame:
    closing = submissions.closing_submissions(t.submissions(), t.survey_requests(), t.perms())
    closed = submissions.answered_requests(t.survey_requests(), closing)
    return _texts(closed, "fecha_creacion", "fecha_limite", "fecha_respuesta")


@_register
def site_contacts(t: StandIn) -> DataFrame:
    return contacts.site_contacts(t.grants(), t.site_contacts(), t.contacts())


@_register
def assigned_circles(t: StandIn) -> DataFrame:
    return contacts.assigned_circles(t.user_contacts(), t.site_contacts(), t.perms())


@_register
def co_assigned_contacts(t: StandIn) -> DataFrame:
    """For everyone who wrote in a chat."""
    writers = t.chat_messages().select(
        F.substring_index("sender_name", " ", -1).alias("email_login")
    )
    return contacts.co_assigned_contacts(
        t.user_contacts(), t.site_contacts(), t.perms(), writers.distinct()
    )


@_register
def site_participants(t: StandIn) -> DataFrame:
    return contacts.site_participants(t.site_contacts(), t.contacts(), t.grants(), t.perms())


@_register
def participants_across_sites(t: StandIn) -> DataFrame:
    return contacts.participants_across_sites(site_participants(t))


@_register
def participant_funnel(t: StandIn) -> DataFrame:
    return contacts.participant_funnel(t.site_contacts(), t.contacts(), t.grants(), t.perms())


@_register
def site_samples(t: StandIn) -> DataFrame:
    return contacts.site_samples(t.site_contacts(), t.contacts(), t.perms())


@_register
def fan_out_messages(t: StandIn) -> DataFrame:
    messages = messaging.fan_out_messages(
        t.outbound_requests(), t.user_contacts(), t.contacts(), standin.AS_OF_TIME
    )
    return _texts(messages, "fecha_envio")


@_register
def inbox(t: StandIn) -> DataFrame:
    rows = messaging.inbox(t.inbox_messages(), standin.INBOX_ROWS)
    return rows.select(
        "email_login",
        "puesto",
        "mensaje_id",
        F.col("remitente.email").alias("remitente_email"),
        F.col("remitente.nombre").alias("remitente_nombre"),
        F.col("instalacion.rol").alias("instalacion_rol"),
        F.col("instalacion.comuna").alias("instalacion_comuna"),
        "mensaje",
        "estado",
        _moment("fecha_envio"),
        _moment("fecha_lectura"),
        "leido",
    )


@_register
def notification_payloads(t: StandIn) -> DataFrame:
    return _payloads(messaging.notification_payloads(t.chat_messages(), t.users(), t.perms()))


@_register
def notification_recipients(t: StandIn) -> DataFrame:
    """Everybody who is told of the first message that names nobody."""
    chats = t.chat_messages()
    first = chats.filter(F.coalesce(F.size("participant_user_ids") < 1, F.lit(True)))
    message = first.agg(F.min("message_id")).first()[0] or ""
    return _payloads(messaging.notification_recipients(message, chats, t.users(), t.perms()))


def _payloads(payloads: DataFrame) -> DataFrame:
    return payloads.select(
        "message_id",
        "audiencia",
        "email_login",
        "fcm_token",
        "excluye_uid",
        "oculto_a_clientes",
        "titulo",
        "cuerpo",
        F.col("datos.conversationId").alias("conversation_id"),
        F.col("datos.senderId").alias("sender_id"),
        F.col("datos.visibleParaCliente").alias("visible_para_cliente"),
    )


@_register
def user_updates(t: StandIn) -> DataFrame:
    return _texts(updates.apply_user_updates(t.users(), t.user_updates()), "ultima_sesion")


@_register
def device_tokens(t: StandIn) -> DataFrame:
    return messaging.device_tokens(t.users())


def _first(rows: DataFrame, column: str) -> str:
    """A name that exists: the smallest."""
    return rows.agg(F.min(column)).first()[0] or ""


def _first_principal(t: StandIn) -> str:
    return _first(t.grants().filter("puede_ver"), "email_login")


def _first_site(t: StandIn) -> str:
    return _first(t.grants().filter("puede_ver"), "instalacion_rol")


@_register
def coverage_by_site_of_one(t: StandIn) -> DataFrame:
    """What one principal is shown."""
    return coverage.coverage_by_site_fast(
        t.rollup(), t.grants(), t.devices(), t.open_posts(), principals=_first_principal(t)
    ).select("email_login", "instalacion_rol", "cliente_rol", "guardias_presentes", "ppc", "tiene_faceid")


@_register
def weekly_fulfilment_of_one(t: StandIn) -> DataFrame:
    weeks = fulfilment.weekly_fulfilment(
        t.history(), t.grants(), standin.AS_OF, standin.DAYS, principals=_first_principal(t)
    )
    return weeks.select("email_login", "ano", "isoweek", "total_registros", "num_instalaciones")


@_register
def open_posts_of_one_site(t: StandIn) -> DataFrame:
    slots = open_posts.open_posts_by_slot(t.open_posts(), t.grants(), site=_first_site(t))
    return slots.select("email_login", "instalacion_rol", "turno", "horario", "cantidad_ppc")


@_register
def participants_of_two_sites(t: StandIn) -> DataFrame:
    sites = [r[0] for r in t.site_contacts().select("instalacion_rol").distinct().orderBy("instalacion_rol").limit(2).collect()]
    return contacts.site_participants(t.site_contacts(), t.contacts(), t.grants(), t.perms(), sites)


def all_queries() -> dict[str, Query]:
    def bind(build: Callable[[StandIn], DataFrame]) -> Query:
        return lambda spark, sf_dir: build(StandIn(prepare(spark), sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}
