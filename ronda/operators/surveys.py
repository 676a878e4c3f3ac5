"""Survey inbox, survey form and the answers given."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ronda import fixed_values as fv
from ronda.functions.time import open_periods
from ronda.operators.nesting import PAGE_ROWS, nest_rows
from ronda.operators.scope import Principals, near, visible_rows
from ronda.operators.updates import one_of_each
from ronda.schemas import require_columns

CLIENT_SITE = ["cliente_rol", "instalacion_rol"]

# Audiences of a survey.
STAFF, ANYONE, PERSON = "personal", "todos", "persona:"


class SurveyForm(NamedTuple):
    """What opening a survey shows: a header per ask, and the question list,
    which is the same for every survey."""

    headers: DataFrame
    questions: DataFrame


def _in_mode(mode: str) -> Column:
    return F.coalesce(F.col("modo") == mode, F.lit(False))


def _in_state(state: str) -> Column:
    return F.coalesce(F.col("estado") == state, F.lit(False))


def _open_requests(requests: DataFrame, as_of: dt.date) -> DataFrame:
    require_columns(requests, "survey_requests")
    return requests.filter(F.col("periodo").isin(*open_periods(as_of)))


def one_request_each(requests: DataFrame) -> DataFrame:
    """One row for each survey id: a done one if there is any, else the first by its columns."""
    done = F.when(F.col("estado") == fv.STATE_DONE, 0).otherwise(1)
    order = ["_abierta", *sorted(c for c in requests.columns if c != "encuesta_id")]
    return one_of_each(requests.withColumn("_abierta", done), "encuesta_id", order).drop("_abierta")


def _viewers(
    grants: DataFrame, perms: DataFrame, staff_roles: Sequence[str], principals: Principals
) -> DataFrame:
    """Visible sites of active principals, each site once, with staff flag."""
    role = perms.filter("usuario_activo").select(
        "email_login",
        F.coalesce(F.col("rol_id").isin(list(staff_roles)), F.lit(False)).alias("es_personal"),
    )
    return visible_rows(grants, principals).distinct().join(role, "email_login")


def _offered(surveys: DataFrame) -> DataFrame:
    """Surveys once for each audience: staff, and either anyone (shared) or
    the recipient, whose address counts without regard to case."""
    recipient = F.concat(F.lit(PERSON), F.lower("email_destinatario"))
    shared = F.col("modo") == fv.MODE_SHARED
    addressed = (F.col("modo") == fv.MODE_INDIVIDUAL) & recipient.isNotNull()
    audiences = (
        F.when(shared, F.array(F.lit(STAFF), F.lit(ANYONE)))
        .when(addressed, F.array(F.lit(STAFF), recipient))
        .otherwise(F.array(F.lit(STAFF)))
    )
    return surveys.withColumn("publico", F.explode(audiences))


def _listening(viewers: DataFrame) -> DataFrame:
    """Viewers once for each audience they belong to.  Staff belong to no
    other, so nobody meets a survey twice."""
    own = F.concat(F.lit(PERSON), F.lower("email_login"))
    wanted = F.when(F.col("es_personal"), F.array(F.lit(STAFF))).otherwise(
        F.array(F.lit(ANYONE), own)
    )
    return viewers.withColumn("publico", F.explode(wanted))


def survey_inbox(
    requests: DataFrame,
    grants: DataFrame,
    perms: DataFrame,
    as_of: dt.date,
    staff_roles: Sequence[str],
    principals: Principals = None,
) -> DataFrame:
    """Surveys of the running and the previous period at visible sites.

    Staff see all of them; others see shared ones and those addressed to them.
    Seeing ignores the case of the address, answering and reading do not.
    """
    viewers = _viewers(grants, perms, staff_roles, principals)
    surveys = near(_open_requests(requests, as_of), viewers, CLIENT_SITE, principals)
    rows = _offered(surveys).join(_listening(viewers), [*CLIENT_SITE, "publico"])
    shared, individual = _in_mode(fv.MODE_SHARED), _in_mode(fv.MODE_INDIVIDUAL)
    own = individual & F.col("email_destinatario").eqNullSafe(F.col("email_login"))
    staff = F.col("es_personal")
    return rows.select(
        "email_login",
        *CLIENT_SITE,
        "encuesta_id",
        "periodo",
        "modo",
        "estado",
        "email_destinatario",
        "fecha_creacion",
        "fecha_limite",
        "respondido_por_email",
        "respondido_por_nombre",
        "encuestado_nombre",
        "tipo_respuesta",
        "fecha_respuesta",
        (_in_state(fv.STATE_PENDING) & (shared | own)).alias("puede_responder"),
        (_in_state(fv.STATE_DONE) & (staff | shared | own)).alias("puede_ver_respuestas"),
    )


def survey_inbox_by_site(
    requests: DataFrame,
    grants: DataFrame,
    perms: DataFrame,
    as_of: dt.date,
    staff_roles: Sequence[str],
    principals: Principals = None,
) -> DataFrame:
    """Totals of :func:`survey_inbox` per principal and site.

    Surveys are counted per site, mode and recipient before the viewers are
    known; the counts then go to the same audiences as single surveys do.
    """
    viewers = _viewers(grants, perms, staff_roles, principals)
    individual = F.col("modo") == fv.MODE_INDIVIDUAL
    pending = _in_state(fv.STATE_PENDING)
    counted = (
        near(_open_requests(requests, as_of), viewers, CLIENT_SITE, principals)
        .withColumn("email_destinatario", F.when(individual, F.lower("email_destinatario")))
        .groupBy(*CLIENT_SITE, "modo", "email_destinatario")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(_in_state(fv.STATE_DONE)).alias("respondidas"),
            F.count_if(pending).alias("pendientes"),
            F.min(F.when(pending, F.col("fecha_limite"))).alias("vence"),
            F.max("fecha_creacion").alias("reciente"),
        )
    )
    # First in report order: mode, then newest first, unknown dates last.
    newest = F.coalesce(-F.unix_micros("reciente"), F.lit(2**63 - 1)).alias("orden")
    offered = (
        _offered(counted)
        .groupBy(*CLIENT_SITE, "publico")
        .agg(
            F.sum("total").alias("total"),
            F.sum("respondidas").alias("respondidas"),
            F.sum("pendientes").alias("pendientes"),
            F.min("vence").alias("vence"),
            F.min(F.struct("modo", newest, "cliente_rol")).alias("primera"),
        )
    )
    met = _listening(viewers).join(offered, [*CLIENT_SITE, "publico"])
    return met.groupBy("email_login", "instalacion_rol").agg(
        F.min("primera").getField("cliente_rol").alias("cliente_rol"),
        F.sum("total").alias("total_encuestas"),
        F.sum("respondidas").alias("respondidas"),
        F.sum("pendientes").alias("pendientes"),
        F.min("vence").alias("fecha_vencimiento_proxima"),
    )


SURVEY = [
    "encuesta_id",
    "periodo",
    "modo",
    "estado",
    "email_destinatario",
    "fecha_creacion",
    "fecha_limite",
    "respondido_por_email",
    "respondido_por_nombre",
    "encuestado_nombre",
    "tipo_respuesta",
    "fecha_respuesta",
]
PLACE = ["instalacion_rol", "clientes"]


def _surveys_shown() -> Column:
    """Surveys of a page with what the viewer ``email_login`` may do with each."""

    def shown(s: Column) -> Column:
        shared = F.coalesce(s["modo"] == fv.MODE_SHARED, F.lit(False))
        individual = F.coalesce(s["modo"] == fv.MODE_INDIVIDUAL, F.lit(False))
        own = individual & s["email_destinatario"].eqNullSafe(F.col("email_login"))
        pending = F.coalesce(s["estado"] == fv.STATE_PENDING, F.lit(False))
        done = F.coalesce(s["estado"] == fv.STATE_DONE, F.lit(False))
        return F.struct(
            *[s[c].alias(c) for c in SURVEY],
            (pending & (shared | own)).alias("puede_responder"),
            (done & (F.col("es_personal") | shared | own)).alias("puede_ver_respuestas"),
        )

    return F.transform("encuestas", shown).alias("encuestas")


def survey_pages(
    requests: DataFrame,
    grants: DataFrame,
    perms: DataFrame,
    as_of: dt.date,
    staff_roles: Sequence[str],
    principals: Principals = None,
    page_rows: int = PAGE_ROWS,
) -> DataFrame:
    """:func:`survey_inbox` nested: (email_login, instalacion_rol, pagina, encuestas).

    The surveys of a site, under all clients the viewer sees it under, ordered
    by mode, newest first, and cut into pages of ``page_rows`` from 0.

    Lists are ordered and cut once for each site, set of clients and audience,
    not for each viewer.  Staff take the list of the staff as it is.  Everybody
    else merges two lists in order: shared surveys and their own, which come
    later by mode, so the place of an own survey is its rank plus the number of
    shared ones.  A page of the own list falls on two pages of the merged one at
    most; where it meets the last shared page, both are put together.  What is
    joined to viewers are pages; single surveys are never dealt out by viewer.
    """
    viewers = _viewers(grants, perms, staff_roles, principals)
    # Viewers who see the same name under the same clients share their lists.
    seen = viewers.filter(F.col("instalacion_rol").isNotNull()).groupBy("email_login", "instalacion_rol", "es_personal").agg(
        F.array_sort(F.collect_set("cliente_rol")).alias("clientes")
    )
    open_now = near(_open_requests(requests, as_of), viewers, CLIENT_SITE, principals)
    places = seen.select(*PLACE).distinct()
    offered = _offered(
        places.withColumn("cliente_rol", F.explode("clientes")).join(open_now, CLIENT_SITE)
    ).withColumn("_nueva", F.coalesce(-F.unix_micros("fecha_creacion"), F.lit(2**63 - 1)))
    # Two surveys may share id and moment; the client and the other columns decide then.
    nested = nest_rows(
        offered.select(*PLACE, "publico", "modo", "_nueva", *[c for c in SURVEY if c != "modo"], "cliente_rol"),
        [*PLACE, "publico"],
        ["modo", "_nueva", "encuesta_id"],
        "encuestas",
        page_rows,
    )
    for_staff = nested.filter(F.col("publico") == STAFF).drop("publico")
    shared = nested.filter(F.col("publico") == ANYONE).drop("publico")
    personal = nested.filter(F.startswith("publico", F.lit(PERSON)))
    shared_total = (
        offered.filter(F.col("publico") == ANYONE).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("_compartidas"))
    )
    staff, others = seen.filter("es_personal"), seen.filter(~F.col("es_personal"))
    first = F.coalesce("_compartidas", F.lit(0)) + F.col("pagina") * page_rows
    cut = page_rows - first % page_rows
    own = (
        others.withColumn("publico", F.concat(F.lit(PERSON), F.lower("email_login")))
        .join(personal, [*PLACE, "publico"])
        .join(shared_total, PLACE, "left")
        .withColumns({"_hoja": F.floor(first / page_rows), "_corte": cut.cast("int")})
        .withColumn(
            "_parte",
            F.explode(
                F.array(
                    F.struct(F.col("_hoja").alias("pagina"), F.slice("encuestas", F.lit(1), F.col("_corte")).alias("encuestas")),
                    F.struct(
                        (F.col("_hoja") + 1).alias("pagina"),
                        F.slice("encuestas", F.col("_corte") + 1, F.lit(page_rows)).alias("encuestas"),
                    ),
                )
            ),
        )
        .filter(F.size("_parte.encuestas") > 0)
    )
    # The two parts that may fall on one page: the end of a page of own surveys and the beginning of the next.
    own_pages = (
        own.groupBy("email_login", *PLACE, F.col("_parte.pagina").alias("pagina"))
        .agg(
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct(F.col("pagina").alias("p"), F.col("_parte.encuestas").alias("e")))),
                    lambda x: x["e"],
                )
            ).alias("encuestas"),
            F.first(F.coalesce("_compartidas", F.lit(0))).alias("_compartidas"),
        )
    )
    meets = (F.col("pagina") == F.floor(F.col("_compartidas") / page_rows)) & (F.col("_compartidas") % page_rows != 0)
    meeting = own_pages.filter(meets).select("email_login", *PLACE, F.col("pagina").alias("_hoja"), F.col("encuestas").alias("_propias"))
    with_shared = others.join(meeting, ["email_login", *PLACE], "left").join(shared, PLACE)
    joined = F.when(F.col("pagina") == F.col("_hoja"), F.concat("encuestas", "_propias")).otherwise(F.col("encuestas"))
    columns = ["email_login", "instalacion_rol", "es_personal", "pagina", "encuestas"]
    parts = (
        staff.join(for_staff, PLACE).select(*columns),
        with_shared.withColumn("encuestas", joined).select(*columns),
        own_pages.filter(~meets).withColumn("es_personal", F.lit(False)).select(*columns),
    )
    pages = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return pages.select("email_login", "instalacion_rol", "pagina", _surveys_shown())


def survey_form(
    asks: DataFrame, requests: DataFrame, grants: DataFrame, questions: DataFrame
) -> SurveyForm:
    """Answers ``asks`` (principal, survey) with a header and its ``acceso``.

    Of requests that repeat an id the one that is done counts, as in all reports
    on a single survey.  ``acceso`` is ``ok``, ``sin_acceso`` without a visible grant for the site,
    or ``no_encontrada``; the header is filled for ``ok`` only.
    """
    require_columns(requests, "survey_requests")
    require_columns(questions, "questions")
    require_columns(asks, "survey_asks")
    header = ["periodo", "modo", "estado", "fecha_limite", "encuestado_nombre"]
    surveys = one_request_each(requests).select(
        "encuesta_id", *CLIENT_SITE, *header, F.lit(True).alias("_existe")
    )
    seen = visible_rows(grants).distinct().withColumn("_ve", F.lit(True))
    asked = asks.join(surveys, "encuesta_id", "left").join(
        seen, ["email_login", *CLIENT_SITE], "left"
    )
    access = (
        F.when(F.col("_existe").isNull(), "no_encontrada")
        .when(F.col("_ve").isNull(), "sin_acceso")
        .otherwise("ok")
    )
    headers = asked.select(
        "email_login",
        "encuesta_id",
        access.alias("acceso"),
        *[F.when(access == "ok", F.col(c)).alias(c) for c in ("instalacion_rol", *header)],
    )
    return SurveyForm(headers, active_questions(questions))


def active_questions(questions: DataFrame) -> DataFrame:
    return questions.filter("activa").select(
        "pregunta_id",
        "orden",
        "texto_pregunta",
        "tipo_respuesta",
        "requiere_comentario",
        "obligatoria",
        "categoria",
    )


def survey_answers(requests: DataFrame, answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers of completed surveys with their question.

    ``solo_para`` is the recipient of an individual survey and null for all
    others: anyone active may read a survey that is not addressed to somebody
    else, and staff may read all.
    """
    require_columns(requests, "survey_requests")
    require_columns(answers, "answers")
    done = one_request_each(requests).filter(F.col("estado") == fv.STATE_DONE).select(
        "encuesta_id", "periodo", "instalacion_rol", "modo", "email_destinatario"
    )
    asked = questions.select("pregunta_id", "texto_pregunta", "tipo_respuesta", "orden")
    solo = F.when(_in_mode(fv.MODE_INDIVIDUAL), F.coalesce("email_destinatario", F.lit("")))
    return answers.join(done, "encuesta_id").join(asked, "pregunta_id").select(
        "encuesta_id",
        "instalacion_rol",
        "periodo",
        "modo",
        solo.alias("solo_para"),
        "pregunta_id",
        "texto_pregunta",
        "tipo_respuesta",
        "respuesta_valor",
        F.col("comentario_adicional").alias("comentario"),
        "orden",
    )


def answer_access(
    asks: DataFrame, requests: DataFrame, perms: DataFrame, staff_roles: Sequence[str]
) -> DataFrame:
    """Whether each ask (active principal, survey) may read the answers, and
    the survey header if so."""
    require_columns(asks, "survey_asks")
    staff = F.coalesce(F.col("rol_id").isin(list(staff_roles)), F.lit(False))
    active = perms.filter("usuario_activo").select("email_login", staff.alias("es_personal"))
    header = ["periodo", "instalacion_rol", "modo", "respondido_por_nombre", "encuestado_nombre"]
    surveys = one_request_each(requests).select(
        "encuesta_id",
        *header,
        "email_destinatario",
        "estado",
        "fecha_respuesta",
        F.lit(True).alias("_existe"),
    )
    asked = asks.join(active, "email_login").join(surveys, "encuesta_id", "left")
    elses = _in_mode(fv.MODE_INDIVIDUAL) & ~F.col("email_destinatario").eqNullSafe(
        F.col("email_login")
    )
    access = (
        F.when(F.col("_existe").isNull(), "no_encontrada")
        .when(elses & ~F.col("es_personal"), "sin_acceso")
        .when(~_in_state(fv.STATE_DONE), "sin_responder")
        .otherwise("ok")
    )
    return asked.select(
        "email_login",
        "encuesta_id",
        access.alias("acceso"),
        *[
            F.when(access == "ok", F.col(c)).alias(c)
            for c in (*header, "fecha_respuesta")
        ],
    )


def answers_for(access: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers every ask is given; ``answers`` from :func:`survey_answers`."""
    granted = access.filter(F.col("acceso") == "ok").select("email_login", "encuesta_id")
    return answers.drop("solo_para").join(granted, "encuesta_id")
