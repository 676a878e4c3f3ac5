"""Schemas of the logical tables and the check made where they enter a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

S, B, I, L, D = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType(), T.DoubleType()
DAY, NTZ, TS = T.DateType(), T.TimestampNTZType(), T.TimestampType()


def _schema(*groups: tuple[T.DataType, str]) -> T.StructType:
    return T.StructType(
        [T.StructField(name, kind, True) for kind, names in groups for name in names.split()]
    )


ANSWER = _schema((S, "pregunta_id respuesta_valor comentario"))

SCHEMAS: dict[str, T.StructType] = {
    "grants": _schema((S, "email_login cliente_rol instalacion_rol"), (B, "puede_ver")),
    "perms": _schema(
        (S, "email_login firebase_uid nombre_completo cliente_rol rol_id nombre_rol"),
        (
            B,
            "puede_ver_cobertura puede_ver_encuestas puede_enviar_mensajes puede_ver_empresas "
            "puede_ver_metricas_globales puede_ver_trabajadores puede_ver_mensajes_recibidos "
            "es_admin ver_todas_instalaciones usuario_activo",
        ),
    ),
    "users": _schema((S, "email_login firebase_uid fcm_token"), (TS, "ultima_sesion")),
    "user_updates": _schema((S, "email_login firebase_uid fcm_token"), (TS, "momento")),
    "rollup": _schema(
        (S, "instalacion_rol zona cliente_rol empresa tipo_de_servicio"),
        (L, "total_guardias_requeridos guardias_presentes turnos_cubiertos turnos_descubiertos"),
        (TS, "ultima_actualizacion"),
    ),
    "shifts": _schema(
        (S, "instalacion_rol cliente_rol empresa turno cargo rutrol nombrerol rutasi relevo COB"),
        (S, "tvf tipo tipo_de_servicio motivoppc"),
        (NTZ, "her hsr entrada salida"),
        (I, "asistencia"),
    ),
    "history": _schema(
        (S, "semana instalacion_rol cliente_rol zona empresa rutrol tvf"),
        (I, "isoweek ano"),
        (DAY, "dia"),
        (D, "horas_planificadas horas_entregadas"),
        (I, "asistencia"),
    ),
    "open_posts": _schema((S, "instalacion_rol turno jornada"), (NTZ, "her hsr")),
    "devices": _schema((S, "nombre numero"), (TS, "ult_conexion")),
    "survey_requests": _schema(
        (S, "encuesta_id periodo cliente_rol instalacion_rol modo email_destinatario estado"),
        (S, "respondido_por_email respondido_por_nombre encuestado_nombre tipo_respuesta"),
        (TS, "fecha_creacion fecha_limite fecha_respuesta"),
    ),
    "questions": _schema(
        (S, "pregunta_id texto_pregunta tipo_respuesta categoria"),
        (I, "orden"),
        (B, "requiere_comentario obligatoria activa"),
    ),
    "answers": _schema(
        (S, "respuesta_id encuesta_id pregunta_id respuesta_valor comentario_adicional"),
        (TS, "fecha_respuesta"),
    ),
    "submissions": _schema(
        (S, "submission_id encuesta_id email encuestado_nombre"),
        (T.ArrayType(ANSWER), "respuestas"),
        (TS, "arrival"),
    ),
    "survey_asks": _schema((S, "email_login encuesta_id")),
    "contacts": _schema(
        (S, "contacto_id nombre_contacto telefono cargo email email_usuario_app"),
        (B, "activo es_usuario_app"),
    ),
    "site_contacts": _schema((S, "contacto_id instalacion_rol cliente_rol")),
    "user_contacts": _schema((S, "email_login contacto_id instalacion_rol"), (B, "puede_contactar")),
    "outbound_requests": _schema(
        (S, "solicitud_id email_usuario cliente_rol mensaje"), (T.ArrayType(S), "instalaciones")
    ),
    "messages": _schema(
        (S, "mensaje_id email_usuario cliente_rol instalacion_rol contacto_id mensaje estado"),
        (TS, "fecha_envio"),
    ),
    "inbox_messages": _schema(
        (S, "mensaje_id remitente_email remitente_nombre remitente_cliente instalacion_rol"),
        (S, "instalacion_direccion instalacion_comuna mensaje estado destinatario_email_app"),
        (TS, "fecha_envio fecha_lectura"),
        (B, "leido"),
    ),
    "chat_messages": _schema(
        (S, "conversation_id message_id sender_id sender_name message_text"),
        (B, "visible_para_cliente"),
        (T.ArrayType(S), "participant_user_ids"),
    ),
}

_TIMES = (T.TimestampType, T.TimestampNTZType)
_NUMBERS = (T.NumericType,)


def _fits(found: T.DataType, wanted: T.DataType) -> bool:
    for family in (_TIMES, _NUMBERS):
        if isinstance(wanted, family):
            return isinstance(found, family)
    if isinstance(wanted, T.ArrayType):
        return isinstance(found, T.ArrayType)
    return type(found) is type(wanted)


def require_columns(df: DataFrame, table: str) -> DataFrame:
    """``df`` itself, if it has every column of ``table`` in a fitting type."""
    found = {f.name: f.dataType for f in df.schema.fields}
    wrong = []
    for field in SCHEMAS[table].fields:
        if field.name not in found:
            wrong.append(f"{field.name} is missing")
        elif not _fits(found[field.name], field.dataType):
            kind = found[field.name].simpleString()
            wrong.append(f"{field.name} is {kind}, not {field.dataType.simpleString()}")
    if wrong:
        raise ValueError(f"table {table}: " + "; ".join(wrong))
    return df
