"""Outgoing messages, inboxes and push notifications."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ronda import fixed_values as fv
from ronda.functions.text import clipped, filled, row_id
from ronda.schemas import require_columns

INBOX_SALTS = 16


def fan_out_messages(
    requests: DataFrame, user_contacts: DataFrame, contacts: DataFrame, as_of: dt.datetime
) -> DataFrame:
    """One pending message per requested site and contact the sender may write to.

    A site named twice in a request gets its messages twice.
    """
    require_columns(requests, "outbound_requests")
    require_columns(user_contacts, "user_contacts")
    require_columns(contacts, "contacts")
    active = contacts.filter("activo").select("contacto_id", "telefono", "nombre_contacto").distinct()
    allowed = (
        user_contacts.filter("puede_contactar")
        .select(
            F.col("email_login").alias("email_usuario"), "instalacion_rol", "contacto_id"
        )
        .distinct()
        .join(active, "contacto_id")
    )
    wanted = requests.select(
        "solicitud_id",
        "email_usuario",
        "cliente_rol",
        "mensaje",
        F.posexplode("instalaciones").alias("pos", "instalacion_rol"),
    )
    return wanted.join(allowed, ["email_usuario", "instalacion_rol"]).select(
        row_id(
            F.col("solicitud_id"),
            F.col("pos"),
            F.col("contacto_id"),
            F.col("telefono"),
            F.col("nombre_contacto"),
        ).alias("mensaje_id"),
        "email_usuario",
        "cliente_rol",
        "instalacion_rol",
        "contacto_id",
        "mensaje",
        F.lit(fv.MESSAGE_PENDING).alias("estado"),
        F.lit(as_of).cast("timestamp").alias("fecha_envio"),
    )


def inbox(messages: DataFrame, rows: int = fv.INBOX_ROWS, salts: int = INBOX_SALTS) -> DataFrame:
    """The newest ``rows`` messages of every recipient, sender and site nested.

    Messages are first ranked within a share of each recipient's messages, so
    a recipient with very many of them is not ranked by a single task; the
    newest overall are among the newest of each share.
    """
    require_columns(messages, "inbox_messages")
    newest = [F.desc("fecha_envio"), F.desc("mensaje_id")]
    share = W.partitionBy("destinatario_email_app", "_parte").orderBy(*newest)
    whole = W.partitionBy("destinatario_email_app").orderBy(*newest)
    part = F.pmod(F.xxhash64("mensaje_id"), F.lit(salts))
    kept = (
        messages.withColumn("_parte", part)
        .withColumn("_n", F.row_number().over(share))
        .filter(F.col("_n") <= rows)
        .withColumn("puesto", F.row_number().over(whole))
        .filter(F.col("puesto") <= rows)
    )
    return kept.select(
        F.col("destinatario_email_app").alias("email_login"),
        "puesto",
        "mensaje_id",
        F.struct(
            F.col("remitente_email").alias("email"),
            F.col("remitente_nombre").alias("nombre"),
            F.col("remitente_cliente").alias("cliente"),
        ).alias("remitente"),
        F.struct(
            F.col("instalacion_rol").alias("rol"),
            F.col("instalacion_direccion").alias("direccion"),
            F.col("instalacion_comuna").alias("comuna"),
        ).alias("instalacion"),
        "mensaje",
        "estado",
        "fecha_envio",
        "fecha_lectura",
        "leido",
    )


def device_tokens(users: DataFrame) -> DataFrame:
    """Users that have a device token."""
    require_columns(users, "users")
    return users.filter(filled(F.col("fcm_token"))).select(
        "email_login", "fcm_token", "firebase_uid"
    )


def _reachable(users: DataFrame, perms: DataFrame) -> DataFrame:
    """Devices of people who may be told of a message, with their role."""
    role = perms.select("email_login", "rol_id", "usuario_activo")
    return (
        device_tokens(users)
        .filter(F.col("firebase_uid").isNotNull())
        .join(role, "email_login", "left")
        .filter(F.coalesce(F.col("usuario_activo"), F.lit(True)))
        .drop("usuario_activo")
    )


def _to_named(messages: DataFrame) -> Column:
    return F.coalesce(F.size("participant_user_ids") > 0, F.lit(False))


def _written(messages: DataFrame) -> DataFrame:
    """What is told of a message; only the clipped body, never the whole text."""
    shown = F.coalesce(F.col("visible_para_cliente"), F.lit(True))
    return messages.select(
        "message_id",
        "participant_user_ids",
        F.col("sender_id").alias("excluye_uid"),
        (~shown).alias("oculto_a_clientes"),
        F.concat(F.lit(fv.PUSH_TITLE_PREFIX), F.col("sender_name")).alias("titulo"),
        clipped(F.col("message_text")).alias("cuerpo"),
        F.struct(
            F.lit(fv.PUSH_KIND).alias("tipo"),
            F.col("conversation_id").alias("conversationId"),
            F.col("message_id").alias("messageId"),
            F.col("sender_id").alias("senderId"),
            F.col("sender_name").alias("senderName"),
            shown.cast("string").alias("visibleParaCliente"),
        ).alias("datos"),
    )


def _excluded() -> Column:
    hidden = F.col("oculto_a_clientes") & F.col("rol_id").eqNullSafe(fv.ROLE_CLIENT)
    return (F.col("firebase_uid") == F.col("excluye_uid")) | hidden


TO_NAMED, TO_ALL = "nombrados", "todos"
PAYLOAD = ["message_id", "audiencia", "email_login", "firebase_uid", "fcm_token", "excluye_uid", "oculto_a_clientes"]
PAYLOAD += ["titulo", "cuerpo", "datos"]


def notification_payloads(
    messages: DataFrame, users: DataFrame, perms: DataFrame, empty_means_all: bool = True
) -> DataFrame:
    """One payload per chat message and device of a named participant.

    A message that names nobody goes to everybody: it stays one row, with the
    audience ``todos``, no device, and its two exclusions, so the result grows
    with messages and participants and not with messages times devices.
    :func:`notification_recipients` lists the devices of a single message.
    """
    written = _written(messages)
    named = _to_named(messages)
    to_named = (
        written.filter(named)
        .withColumn("firebase_uid", F.explode(F.array_distinct("participant_user_ids")))
        .join(_reachable(users, perms), "firebase_uid")
        .filter(~_excluded())
        .withColumn("audiencia", F.lit(TO_NAMED))
        .select(*PAYLOAD)
    )
    if not empty_means_all:
        return to_named
    nobody = {c: F.lit(None).cast("string") for c in ("email_login", "firebase_uid", "fcm_token")}
    to_all = written.filter(~named).withColumns({"audiencia": F.lit(TO_ALL), **nobody})
    return to_named.unionByName(to_all.select(*PAYLOAD))


def notification_recipients(
    message_id: str, messages: DataFrame, users: DataFrame, perms: DataFrame
) -> DataFrame:
    """Payloads of one message that goes to everybody, one per device.

    The message is looked up first, so devices are filtered and joined with
    nothing.  No rows for a message that is unknown or names participants.
    """
    found = _written(messages).filter((F.col("message_id") == message_id) & ~_to_named(messages)).first()
    devices = _reachable(users, perms)
    if found is None:
        return messages.sparkSession.createDataFrame(
            [], notification_payloads(messages, users, perms).schema
        )
    told = {c: F.lit(found[c]) for c in ("message_id", "excluye_uid", "oculto_a_clientes", "titulo", "cuerpo")}
    told["excluye_uid"] = told["excluye_uid"].cast("string")
    data = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in found["datos"].asDict().items()])
    rows = devices.withColumns({**told, "datos": data, "audiencia": F.lit(TO_ALL)})
    return rows.filter(~_excluded()).select(*PAYLOAD)
