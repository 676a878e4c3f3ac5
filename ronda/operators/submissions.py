"""Survey submissions: one batch checked against the stored requests.

Submissions count in order of arrival.  Only the first one accepted for a
pending survey changes that survey, so later ones meet exactly one other
state, and a batch needs one look for the first acceptable submission of each
survey instead of going through them one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ronda import fixed_values as fv
from ronda.functions.text import filled, none_if_empty, row_id, strip
from ronda.operators.surveys import one_request_each
from ronda.operators.updates import keyed_update, one_of_each
from ronda.schemas import require_columns
from ronda.settings import DEFAULTS, Settings

ACCEPTED = "aceptada"
DECISION = (
    "submission_id",
    "encuesta_id",
    "email",
    "responde_nombre",
    "arrival",
    "respuestas",
    "resultado",
    "cierra",
    "encuestado_nombre",
    "tipo_respuesta",
)
# Columns that a submission brings along only where the result needs them.
CARRIED = ("encuestado_dado", "respuestas", "responde_nombre", "rol_id")
# What each output takes of a decision.
FOR_ANSWERS = ("submission_id", "encuesta_id", "arrival", "respuestas", "resultado")
FOR_REJECTIONS = ("submission_id", "encuesta_id", "email", "arrival", "resultado")
FOR_REQUESTS = ("encuesta_id", "email", "responde_nombre", "arrival", "cierra", "encuestado_nombre", "tipo_respuesta")


class Outcome(NamedTuple):
    answers: DataFrame
    requests: DataFrame
    rejections: DataFrame


def _verdict(state: Column, responder: Column) -> Column:
    """First rule a submission breaks, given the state it meets."""
    shared = F.coalesce(F.col("modo") == fv.MODE_SHARED, F.lit(False))
    individual = F.coalesce(F.col("modo") == fv.MODE_INDIVIDUAL, F.lit(False))
    done = F.coalesce(state == fv.STATE_DONE, F.lit(False))
    blank = ~F.col("_con_nombre")
    return (
        F.when(F.col("_usuario").isNull(), "usuario_desconocido")
        .when(F.col("_existe").isNull(), "encuesta_desconocida")
        .when(individual & ~F.col("email_destinatario").eqNullSafe(F.col("email")), "no_destinatario")
        .when(shared & done, "ya_respondida")
        .when(shared & blank, "falta_encuestado")
        .when(F.col("fecha_limite").isNull(), "sin_fecha_limite")
        .when(F.col("fecha_limite") < F.col("arrival"), "vencida")
        .when(done & responder.eqNullSafe(F.col("email")), "ya_respondida_por_usuario")
        .otherwise(ACCEPTED)
    )


def _respondent() -> Column:
    """Name to store: given for a shared survey; otherwise a given one
    replaces the stored one, and white space alone empties it."""
    given = F.col("encuestado_dado")
    name = none_if_empty(strip(given))
    must_give = F.coalesce(F.col("modo") == fv.MODE_SHARED, F.lit(False))
    return F.when(must_give | filled(given), name).otherwise(F.col("encuestado_guardado"))


def _responder_type(settings: Settings) -> Column:
    kind = F.when(F.col("rol_id") == fv.ROLE_CLIENT, fv.RESPONDER_CLIENT)
    return kind.otherwise(settings.staff_label)


def _would_close() -> Column:
    """Whether a submission is acceptable for its survey as stored, and that is pending."""
    pending = F.coalesce(F.col("estado") == fv.STATE_PENDING, F.lit(False))
    return pending & (_verdict(F.col("estado"), F.col("respondido_por_email")) == ACCEPTED)


def _met(submissions: DataFrame, requests: DataFrame, perms: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Every submission once, beside its sender and its survey as stored."""
    require_columns(submissions, "submissions")
    require_columns(requests, "survey_requests")
    require_columns(perms, "perms")
    given = [c for c in ("encuestado_nombre", "respuestas") if c != "respuestas" or c in wanted]
    order = ["arrival", "encuesta_id", "email", *given]
    delivered = one_of_each(submissions.select("submission_id", *order), "submission_id", order)
    surveys = one_request_each(requests).select(
        "encuesta_id",
        "modo",
        "email_destinatario",
        "estado",
        "respondido_por_email",
        "fecha_limite",
        F.col("encuestado_nombre").alias("encuestado_guardado"),
        F.lit(True).alias("_existe"),
    )
    made_from = {"responde_nombre": "responde_nombre", "tipo_respuesta": "rol_id"}
    known = [made_from[c] for c in made_from if c in wanted]
    people = perms.filter("usuario_activo").select(
        F.col("email_login").alias("email"),
        *[F.col("nombre_completo").alias(c) if c == "responde_nombre" else F.col(c) for c in known],
        F.lit(True).alias("_usuario"),
    )
    carried = [c for c in ("encuestado_dado", "respuestas") if c.replace("dado", "nombre") in wanted]
    return (
        delivered.withColumnRenamed("encuestado_nombre", "encuestado_dado")
        .withColumn("_con_nombre", filled(strip(F.col("encuestado_dado"))))
        .select("submission_id", "encuesta_id", "email", "arrival", "_con_nombre", *carried)
        .join(people, "email", "left")
        .join(surveys, "encuesta_id", "left")
    )


def decide_submissions(
    submissions: DataFrame,
    requests: DataFrame,
    perms: DataFrame,
    settings: Settings = DEFAULTS,
    wanted: Sequence[str] = DECISION,
) -> DataFrame:
    """Every submission once, with its ``resultado``.

    A submission delivered again, known by its id, is the one that arrived
    first.  Of requests that repeat an id the one that is done counts, else the
    first by its other columns.  Write this to a table before using it for more
    than one output.  ``wanted`` names the columns of the result: what others
    are made from is left out of the shuffles, and decisions stay the same.

    Submissions are looked at twice, for the first acceptable one of each survey
    and for their own verdict.  Both looks take the same columns and no filter,
    so that they read the same shuffles; the first one's whole row is kept.
    """
    met = _met(submissions, requests, perms, wanted)
    place = F.struct("arrival", "submission_id")
    row = F.struct("arrival", "submission_id", "email", *[c for c in CARRIED if c in met.columns])
    # An id that cannot be null is what keeps a filter for it out of this look only.
    winners = (
        met.groupBy("encuesta_id")
        .agg(F.min(F.when(_would_close(), row)).alias("ganadora"))
        .filter(F.col("ganadora").isNotNull())
        .select(
            F.coalesce("encuesta_id", F.lit("")).alias("_encuesta"),
            F.struct("ganadora.arrival", "ganadora.submission_id").alias("_puesto"),
            F.col("ganadora.email").alias("_gana"),
        )
    )
    later = F.coalesce(place > F.col("_puesto"), F.lit(False))
    state = F.when(later, fv.STATE_DONE).otherwise(F.col("estado"))
    responder = F.when(later, F.col("_gana")).otherwise(F.col("respondido_por_email"))
    wins = F.coalesce(place == F.col("_puesto"), F.lit(False))
    made = {
        "resultado": lambda: _verdict(state, responder),
        "cierra": lambda: wins,
        "encuestado_nombre": _respondent,
        "tipo_respuesta": lambda: _responder_type(settings),
    }
    return met.join(winners, F.col("encuesta_id") == F.col("_encuesta"), "left").select(
        *[made[c]().alias(c) if c in made else F.col(c) for c in wanted]
    )


def closing_submissions(
    submissions: DataFrame, requests: DataFrame, perms: DataFrame, settings: Settings = DEFAULTS
) -> DataFrame:
    """The decisions with ``cierra`` alone, in the columns that :func:`answered_requests` takes.

    These are the first acceptable submissions of pending surveys, so they need
    no second look at the others.
    """
    met = _met(submissions, requests, perms, FOR_REQUESTS).filter(_would_close())
    row = F.struct(
        "arrival",
        "submission_id",
        "email",
        "responde_nombre",
        F.lit(True).alias("cierra"),
        _respondent().alias("encuestado_nombre"),
        _responder_type(settings).alias("tipo_respuesta"),
    )
    first = met.groupBy("encuesta_id").agg(F.min(row).alias("_gana"))
    return first.select(*[c if c == "encuesta_id" else F.col(f"_gana.{c}").alias(c) for c in FOR_REQUESTS])


def submission_answers(decisions: DataFrame) -> DataFrame:
    """Answer rows of the accepted submissions."""
    # An inner explode would put a filter for empty arrays before the decision, into one of its two looks only.
    rows = decisions.filter(F.col("resultado") == ACCEPTED).select(
        "submission_id", "encuesta_id", "arrival", F.posexplode_outer("respuestas").alias("pos", "r")
    ).filter(F.col("pos").isNotNull())
    return rows.select(
        row_id(F.col("submission_id"), F.col("pos")).alias("respuesta_id"),
        "encuesta_id",
        F.col("r.pregunta_id").alias("pregunta_id"),
        F.col("r.respuesta_valor").alias("respuesta_valor"),
        F.col("r.comentario").alias("comentario_adicional"),
        F.col("arrival").alias("fecha_respuesta"),
    )


def submission_rejections(decisions: DataFrame) -> DataFrame:
    return decisions.filter(F.col("resultado") != ACCEPTED).select(
        "submission_id", "encuesta_id", "email", "arrival", F.col("resultado").alias("motivo")
    )


def answered_requests(requests: DataFrame, decisions: DataFrame) -> DataFrame:
    """The requests with those closed that a submission completed."""
    closing = decisions.filter("cierra").select(
        "encuesta_id", "email", "responde_nombre", "encuestado_nombre", "tipo_respuesta", "arrival"
    )
    return keyed_update(
        requests,
        closing,
        "encuesta_id",
        {
            "estado": F.lit(fv.STATE_DONE),
            "respondido_por_email": F.col("new.email"),
            "respondido_por_nombre": F.col("new.responde_nombre"),
            "encuestado_nombre": F.col("new.encuestado_nombre"),
            "tipo_respuesta": F.col("new.tipo_respuesta"),
            "fecha_respuesta": F.col("new.arrival"),
        },
        only_if=F.col("old.estado") == fv.STATE_PENDING,
    )


def apply_submissions(
    submissions: DataFrame, requests: DataFrame, perms: DataFrame, settings: Settings = DEFAULTS
) -> Outcome:
    """All three outputs; ``plans.jobs`` runs them off one stored decision."""
    decisions = decide_submissions(submissions, requests, perms, settings)
    return Outcome(
        submission_answers(decisions),
        answered_requests(requests, decisions),
        submission_rejections(decisions),
    )
