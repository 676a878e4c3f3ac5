"""Keyed updates of a table, as a new version of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def one_of_each(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row for each key, the first by ``order`` and then by all other columns.

    A minimum that combines before the shuffle, so that no table is sorted by
    all its columns and a key that is repeated very often costs no more than
    others.
    """
    lead = [c for c in order if c != key]
    rest = [c for c in rows.columns if c != key and c not in lead]
    first = rows.groupBy(key).agg(F.min(F.struct(*lead, *rest)).alias("_primera"))
    return first.select(*[key if c == key else F.col(f"_primera.{c}").alias(c) for c in rows.columns])


def keyed_update(
    table: DataFrame,
    changes: DataFrame,
    key: str,
    assign: Mapping[str, Column],
    only_if: Column | None = None,
) -> DataFrame:
    """``table`` with the columns in ``assign`` set where ``changes`` has the key.

    Of changes that repeat a key the first by all their columns counts, so no
    row of the table is ever multiplied.  Expressions speak of ``old`` and
    ``new``; ``only_if`` false or null leaves a row as it was.
    """
    old = table.alias("old")
    single = one_of_each(changes, key, changes.columns)
    new = single.withColumn("_nuevo", F.lit(True)).alias("new")
    hit = F.coalesce(F.col("new._nuevo"), F.lit(False))
    if only_if is not None:
        hit = hit & F.coalesce(only_if, F.lit(False))
    joined = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "left")
    return joined.select(
        *[
            F.when(hit, assign[c]).otherwise(F.col(f"old.{c}")).alias(c)
            if c in assign
            else F.col(f"old.{c}").alias(c)
            for c in table.columns
        ]
    )


def apply_user_updates(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Users after a batch of device-token and uid updates.

    The newest of each kind counts.  A token also sets the last session; a
    uid is only written where it is missing or different.
    """
    moment = F.col("momento")
    token = F.max(F.when(F.col("fcm_token").isNotNull(), F.struct(moment, F.col("fcm_token"))))
    uid = F.max(F.when(F.col("firebase_uid").isNotNull(), F.struct(moment, F.col("firebase_uid"))))
    newest = (
        updates.groupBy("email_login")
        .agg(token.alias("token"), uid.alias("uid"))
        .select(
            "email_login",
            F.col("token.fcm_token").alias("fcm_token"),
            F.col("token.momento").alias("sesion"),
            F.col("uid.firebase_uid").alias("firebase_uid"),
        )
    )
    wrong = F.col("new.firebase_uid").isNotNull() & ~F.col("old.firebase_uid").eqNullSafe(
        F.col("new.firebase_uid")
    )
    return keyed_update(
        users,
        newest,
        "email_login",
        {
            "fcm_token": F.coalesce("new.fcm_token", "old.fcm_token"),
            "ultima_sesion": F.coalesce("new.sesion", "old.ultima_sesion"),
            "firebase_uid": F.when(wrong, F.col("new.firebase_uid")).otherwise(
                F.col("old.firebase_uid")
            ),
        },
    )
