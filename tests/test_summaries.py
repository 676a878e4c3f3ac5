"""Stored parts: days of the rollup, guards as bitmaps, and what a refresh reads."""

import datetime as dt
import random
import re

import pytest
from literals import grant, rows
from pyspark.sql import functions as F

from ronda.functions.time import months_between
from ronda.operators import coverage, fulfilment, summaries
from ronda.plans import jobs
from ronda.sources import sinks

TODAY = dt.date(2024, 3, 20)


def shift(day, site="s", client="c", came=1, service="S", hour=8):
    start = None if day is None else dt.datetime.combine(day, dt.time(hour))
    return dict(
        instalacion_rol=site, cliente_rol=client, empresa="e", tipo_de_servicio=service, asistencia=came, her=start,
        entrada=start,
    )


def some_shifts(seed):
    rnd = random.Random(seed)
    days = [None, *(TODAY - dt.timedelta(days=k) for k in range(5))]
    return [shift(rnd.choice(days), rnd.choice("st"), rnd.choice("cd"), rnd.choice([0, 1, None]), rnd.choice(["S", None])) for _ in range(200)]


def test_refresh_of_a_day_equals_the_full_rollup(make, spark, tmp_path):
    store, before, after = str(tmp_path / "parts"), some_shifts(1), some_shifts(2)
    at = lambda s, d: s["her"] is not None and s["her"].date() == d
    kept = [s for s in before if not at(s, TODAY)] + [s for s in after if at(s, TODAY)]
    jobs.refresh_rollup_parts(make("shifts", *before), store)
    for _ in range(2):  # may be run again
        jobs.refresh_rollup_parts(make("shifts", *kept), store, [TODAY])
    got = coverage.rollup_of_parts(spark.read.parquet(store))
    want = coverage.coverage_rollup(make("shifts", *kept))
    assert rows(got, *want.columns) == rows(want)


def test_a_day_that_lost_all_its_shifts_is_emptied(make, spark, tmp_path):
    store = str(tmp_path / "parts")
    jobs.refresh_rollup_parts(make("shifts", shift(TODAY), shift(TODAY - dt.timedelta(days=1))), store)
    jobs.refresh_rollup_parts(make("shifts", shift(TODAY - dt.timedelta(days=1))), store, [TODAY])
    (row,) = coverage.rollup_of_parts(spark.read.parquet(store)).collect()
    assert row.total_guardias_requeridos == 1


def test_refresh_reads_that_day_only(make, spark, tmp_path):
    path, store = str(tmp_path / "shifts"), str(tmp_path / "parts")
    make("shifts", *some_shifts(3)).withColumn("dia", F.to_date("her")).write.partitionBy("dia").parquet(path)
    shifts = spark.read.parquet(path)
    seen = coverage.rollup_parts(shifts.filter(F.col("dia").isin(TODAY)))
    scan = seen._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(dia#\d+\), \(dia#\d+ = 2024-03-20\)\]", scan)
    files = lambda: {str(p): p.stat().st_mtime_ns for p in (tmp_path / "parts").glob("dia=*/*.parquet")}
    jobs.refresh_rollup_parts(shifts, store)
    before = files()
    jobs.refresh_rollup_parts(shifts, store, [TODAY])
    changed = {p for p in before.keys() ^ files().keys()}
    assert changed and all("dia=2024-03-20" in p for p in changed)


def history(days_back, guard, site="s", client="c", zone="z", planned=8.0):
    day = TODAY - dt.timedelta(days=days_back)
    year, week, _ = day.isocalendar()
    return dict(
        semana=f"S{week}", isoweek=week, ano=year, dia=day, instalacion_rol=site, cliente_rol=client, zona=zone,
        empresa=None, rutrol=guard, tvf=None, asistencia=1, horas_planificadas=planned, horas_entregadas=planned,
    )


@pytest.mark.parametrize("days", [3, 17, 60])
def test_bitmaps_count_like_the_direct_reports(make, spark, tmp_path, days):
    rnd = random.Random(days)
    facts = [
        history(rnd.randrange(80), rnd.choice(["g1", "g2", "g3", "g4", None]), rnd.choice("stu"), rnd.choice("cd"), rnd.choice(["z", None]))
        for _ in range(300)
    ]
    grants = make(
        "grants",
        grant("ana", "s", "c"), grant("ana", "s", "d"), grant("ana", "t", "c"), grant("ana", "t", "c"), grant("ben", "s", "d"), grant("ben", "u", "d"),
    )
    table, store = make("history", *facts), str(tmp_path / "store")
    jobs.refresh_summaries(table, store)
    jobs.refresh_summaries(table, store, [202402])
    made = [spark.read.parquet(f"{store}/{n}") for n in ("site_days", "site_guards")]
    got = summaries.fulfilment_of(*made, grants, TODAY, days)
    weekly, by_site = fulfilment.weekly_fulfilment(table, grants, TODAY, days), fulfilment.site_week_fulfilment(table, grants, TODAY, days)
    assert rows(got.weekly, *weekly.columns) == rows(weekly)
    assert rows(got.by_site, *by_site.columns) == rows(by_site)


def test_no_guard_is_shuffled_for_the_report(make, spark, tmp_path):
    store = str(tmp_path / "store")
    jobs.refresh_summaries(make("history", *[history(k, f"g{k}") for k in range(20)]), store)
    made = [spark.read.parquet(f"{store}/{n}") for n in ("site_days", "site_guards")]
    got = summaries.fulfilment_of(*made, make("grants", grant("ana", "s")), TODAY, 30)
    text = got.by_site._jdf.queryExecution().executedPlan().toString()
    assert "rutrol" not in text and "ano_mes" in text and "bitmap_or_agg" in text


def test_known_guards_keep_their_numbers(make, spark, tmp_path):
    store = str(tmp_path / "store")
    jobs.refresh_summaries(make("history", history(1, "b"), history(1, "d"), history(1, "b", "t")), store)
    first = {(r.instalacion_rol, r.rutrol): r.numero for r in sinks.read_version(spark, f"{store}/guard_numbers").collect()}
    jobs.refresh_summaries(make("history", history(1, "a"), history(1, "b"), history(1, "c")), store, [202403])
    then = {(r.instalacion_rol, r.rutrol): r.numero for r in sinks.read_version(spark, f"{store}/guard_numbers").collect()}
    assert first.items() <= then.items()
    assert sorted(n for (site, _), n in then.items() if site == "s") == [1, 2, 3, 4]


def test_more_guards_than_a_bitmap_holds(spark, make):
    many = spark.range(40_000).select(F.concat(F.lit("g"), "id").alias("rutrol"))
    one = make("history", history(1, "x")).drop("rutrol")
    facts = one.join(F.broadcast(many)).select(*make("history").columns)
    numbers = summaries.guard_numbers(facts)
    assert numbers.agg(F.count_distinct("numero"), F.min("numero"), F.max("numero")).first()[:] == (40_000, 1, 40_000)
    made = summaries.site_days(facts), summaries.site_guards(facts, numbers)
    (row,) = summaries.fulfilment_of(*made, make("grants", grant("ana", "s")), TODAY, 30).by_site.collect()
    assert row.guardias_planificados == 40_000


def test_months_between():
    assert months_between(202311, 202402) == [202311, 202312, 202401, 202402]
