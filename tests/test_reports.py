"""Reports through the registry: permissions, and one person against all."""

import datetime as dt
import json

import pytest
from literals import rows
from pyspark.sql import functions as F

from ronda.plans.edge import json_rows
from ronda.plans.reports import Reports
from ronda.schemas import SCHEMAS
from ronda.settings import Settings
from ronda.sources import standin
from ronda.sources.standin import StandIn
from ronda.sources.tables import Tables

AS_OF = standin.AS_OF
REPORTS = {
    "profile": {},
    "coverage_overall": {},
    "coverage_by_site": {},
    "coverage_by_site_fast": {},
    "coverage_by_site_service": {},
    "shift_detail": {},
    "shift_sites": {},
    "shift_pages": {"page_rows": 16},
    "site_pages": {"page_rows": 16},
    "open_posts_nested": {"page_rows": 4},
    "open_posts_by_site": {},
    "survey_pages": {"as_of": AS_OF, "page_rows": 4},
    "site_shift_detail": {"site": "1"},
    "site_shift_totals": {},
    "weekly_fulfilment": {"as_of": AS_OF},
    "site_week_fulfilment": {"as_of": AS_OF},
    "open_posts_total": {},
    "open_posts_by_slot": {"with_working_day": True},
    "survey_inbox": {"as_of": AS_OF},
    "survey_inbox_by_site": {"as_of": AS_OF},
    "site_contacts": {},
    "inbox": {},
}


@pytest.fixture(scope="module")
def reports(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    source, found = StandIn(spark, sf_dir), {}
    for name in SCHEMAS:
        if name != "messages":
            found[name] = str(base / name)
            getattr(source, name)().write.parquet(found[name])
    return Reports(Tables(spark, found), Settings())


@pytest.mark.parametrize("name", REPORTS)
def test_one_person_is_a_part_of_all(reports, name):
    everybody = getattr(reports, name)(**REPORTS[name])
    chosen = sorted(r.email_login for r in everybody.select("email_login").distinct().collect())[:2]
    assert chosen
    several = getattr(reports, name)(principals=[*chosen, "nobody"], **REPORTS[name])
    expected = rows(_rounded(everybody.filter(F.col("email_login").isin(chosen))))
    assert rows(_rounded(several)) == expected
    single = getattr(reports, name)(principals=chosen[0], **REPORTS[name])
    assert rows(single, "email_login") == [t for t in rows(everybody, "email_login") if t[0] == chosen[0]]


def _rounded(df):
    return df.withColumns({f.name: F.round(f.name, 6) for f in df.schema if f.dataType.typeName() == "double"})


def test_flag_is_needed(reports):
    perms = reports.tables["perms"].filter("usuario_activo")
    allowed = {r.email_login for r in perms.filter("puede_ver_cobertura").collect()}
    active = {r.email_login for r in perms.collect()}
    shown = {r.email_login for r in reports.coverage_by_site().collect()}
    ungated = {r.email_login for r in reports.coverage_by_site_fast().collect()}
    assert shown <= allowed < active and ungated <= active and ungated - allowed
    assert reports.coverage_by_site(principals=sorted(ungated - allowed)).count() == 0


def test_other_reports_run(reports, spark):
    asks = reports.tables["survey_asks"]
    form = reports.survey_form(asks)
    assert form.headers.count() > 0 and form.questions.count() > 0
    assert reports.survey_answers(asks).count() > 0
    about = spark.createDataFrame([("1", "1"), ("1", "2")], "email_login string, sobre string")
    assert reports.co_assigned_contacts(about).count() >= 0
    people = reports.site_participants()
    assert people.filter("firebase_uid IS NULL OR firebase_uid = ''").count() == 0
    assert reports.participants_across_sites().count() <= people.count()
    assert reports.participant_funnel().count() > 0
    assert reports.fan_out_messages(dt.datetime(2024, 1, 1)).count() > 0
    assert reports.notification_payloads().count() > 0
    assert reports.device_tokens().count() > 0


def test_slots_sum_to_site_and_total(reports):
    slots = reports.open_posts_by_slot()
    summed = slots.groupBy("email_login").agg(F.sum("cantidad_ppc").alias("total_ppc"))
    totals = reports.open_posts_total().filter("total_ppc > 0")
    assert rows(summed) == rows(totals)


def test_json_at_the_edge(spark):
    report = spark.sql(
        "SELECT 'a' AS email_login, TIMESTAMP'2024-01-01 09:00:00' AS m, "
        "timestamp_ntz'2024-01-01 09:00:00' AS n, DATE'2024-01-01' AS d, "
        "CAST(NULL AS STRING) AS x, array(named_struct('k', 1)) AS filas"
    )
    row = json_rows(report).first()
    assert row.email_login == "a"
    assert json.loads(row.json) == {
        "m": "2024-01-01T09:00:00.000000+00:00",
        "n": "2024-01-01T09:00:00.000000",
        "d": "2024-01-01",
        "x": None,
        "filas": [{"k": 1}],
    }
