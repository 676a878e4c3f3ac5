"""Jobs that write tables.  Each may be run again after a failure."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ronda.functions.time import MONTH, month_key
from ronda.operators import coverage, messaging, submissions, summaries, updates
from ronda.settings import Settings
from ronda.sources import sinks


def run_submissions(
    spark: SparkSession,
    batch: DataFrame,
    batch_id: str,
    perms: DataFrame,
    store: str,
    settings: Settings | None = None,
) -> None:
    """Decides a batch of submissions and stores what follows from it.

    ``store`` holds the versions of the requests under ``requests``.  The
    decisions are stored first and all outputs are made from them, so they
    agree with each other and a lost executor cannot change them.  The next
    version of the requests, which carries the batch's name, comes last: the
    batch stands once that is complete.  Until then a second run decides again
    and replaces what the first one left, since another batch may have come
    between; from then on it decides nothing and only writes what is missing.
    """
    settings = settings or Settings.from_spark(spark)
    requests_at = f"{store}/requests"
    stands = sinks.version_of_batch(spark, requests_at, batch_id) is not None
    version = sinks.latest_version(spark, requests_at)
    requests = sinks.read_version(spark, requests_at, version)
    if not stands:
        decided = submissions.decide_submissions(batch, requests, perms, settings)
        sinks.append_batch(decided, f"{store}/decisions", batch_id, replace=True)
    decisions = spark.read.parquet(sinks.batch_path(f"{store}/decisions", batch_id))
    for name, rows in (
        ("answers", submissions.submission_answers(decisions)),
        ("rejections", submissions.submission_rejections(decisions)),
    ):
        sinks.append_batch(rows, f"{store}/{name}", batch_id, replace=not stands)
    if not stands:
        closed = submissions.answered_requests(requests, decisions)
        sinks.publish_version(closed, requests_at, version + 1, batch_id)


def run_rollup(shifts: DataFrame, store: str, as_of: dt.datetime) -> int:
    """Refreshes the coverage rollup as its next version."""
    version = sinks.latest_version(shifts.sparkSession, store) + 1
    return sinks.publish_version(coverage.coverage_rollup(shifts, as_of), store, version)


def refresh_rollup_parts(shifts: DataFrame, store: str, days: Sequence[dt.date] | None = None) -> None:
    """Writes the rollup's parts under ``store``, one folder a day; with ``days``, of these days only.

    Other days stay as they are, and neither their shifts nor their parts are
    read: shifts that are stored by ``dia`` are read in the folders of the days,
    others by the time of their planned start.  A day of which all shifts are
    gone is left with a part that counts nothing.  May be run again at any time.
    """
    spark = shifts.sparkSession
    changed = shifts
    if days is not None:
        if coverage.PART_DAY in shifts.columns:
            changed = shifts.filter(F.col(coverage.PART_DAY).isin(*days))
        else:
            start = lambda d: F.lit(dt.datetime.combine(d, dt.time())).cast("timestamp_ntz")
            within = [(F.col("her") >= start(d)) & (F.col("her") < start(d + dt.timedelta(days=1))) for d in days]
            changed = shifts.filter(reduce(lambda a, b: a | b, within, F.lit(False)))
    parts = coverage.rollup_parts(changed)
    if days is not None:
        blank = spark.createDataFrame([(d,) for d in days], f"{coverage.PART_DAY} date")
        parts = parts.unionByName(
            blank.withColumns({"requeridos": F.lit(0).cast("long"), "presentes": F.lit(0).cast("long")}), True
        )
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if days is not None else "static").partitionBy(
        coverage.PART_DAY
    ).parquet(store)


def refresh_summaries(history: DataFrame, store: str, months: Sequence[int] | None = None) -> None:
    """Writes site days and guards by month under ``store``; with ``months`` (yyyymm), of these only.

    A history that is stored by month is read in these months only.  Numbers of
    guards come first, as a new version in which known guards keep theirs, so
    that bitmaps of other months stay right and a run can be repeated.
    """
    spark = history.sparkSession
    if MONTH not in history.columns:
        history = history.withColumn(MONTH, month_key(F.col("dia")))
    if months is not None:
        history = history.filter(F.col(MONTH).isin(*months))
    rows = history.drop(MONTH)
    numbers_at = f"{store}/guard_numbers"
    version = sinks.latest_version(spark, numbers_at)
    known = sinks.read_version(spark, numbers_at, version) if version else None
    sinks.publish_version(summaries.guard_numbers(rows, known), numbers_at, version + 1)
    numbers = sinks.read_version(spark, numbers_at, version + 1)
    for name, made in (("site_days", summaries.site_days(rows)), ("site_guards", summaries.site_guards(rows, numbers))):
        made.withColumn(MONTH, month_key(F.col("dia"))).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic" if months is not None else "static"
        ).partitionBy(MONTH).parquet(f"{store}/{name}")


def run_user_updates(changes: DataFrame, store: str) -> int:
    """Applies token and uid updates to the newest version of the users."""
    spark = changes.sparkSession
    version = sinks.latest_version(spark, store)
    users = sinks.read_version(spark, store, version)
    return sinks.publish_version(updates.apply_user_updates(users, changes), store, version + 1)


def run_fan_out(
    requests: DataFrame,
    user_contacts: DataFrame,
    contacts: DataFrame,
    as_of: dt.datetime,
    store: str,
    batch_id: str,
) -> None:
    messages = messaging.fan_out_messages(requests, user_contacts, contacts, as_of)
    sinks.append_batch(messages, store, batch_id)
