"""Shape of the physical plans."""

import re

import pytest

from ronda.operators import coverage, fulfilment, messaging, surveys
from ronda.plans.queries import all_queries
from ronda.plans.reports import Reports
from ronda.sources import standin
from ronda.sources.history import write_history
from ronda.sources.standin import StandIn
from ronda.sources.tables import Tables

FORBIDDEN = (
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "FlatMapGroupsInPandas",
)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_no_python_and_no_cross_join(spark, sf_dir, name):
    text = plan(all_queries()[name](spark, sf_dir))
    assert not [node for node in FORBIDDEN if node in text]


@pytest.fixture
def stored(spark, sf_dir, tmp_path):
    source = StandIn(spark, sf_dir)

    def read(name):
        path = str(tmp_path / name)
        getattr(source, name)().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return read


@pytest.fixture
def as_on_a_cluster(spark):
    """No table is small enough to be broadcast, and the plan is not adapted."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "-1")
    spark.conf.set(names[1], "false")
    yield
    for n, value in before.items():
        spark.conf.set(n, value)


def test_history_is_read_once(spark, stored, as_on_a_cluster):
    history, grants = stored("history"), stored("grants")
    text = plan(fulfilment.site_week_fulfilment(history, grants, standin.AS_OF, 90))
    assert len(re.findall(r"FileScan parquet \[[^\]]*horas_planificadas", text)) == 1
    assert "ReusedExchange" in text
    assert "GreaterThanOrEqual(dia" in text


def test_facts_come_down_before_viewers_are_joined(spark, stored, as_on_a_cluster):
    text = plan(fulfilment.weekly_fulfilment(stored("history"), stored("grants"), standin.AS_OF, 90))
    joined = re.search(r"SortMergeJoin \[cliente_rol#\d+, instalacion_rol#\d+\]", text).start()
    assert text.index("partial_sum(horas_planificadas") > joined


def test_inbox_is_limited_before_the_shuffle(spark, stored):
    text = plan(messaging.inbox(stored("inbox_messages"), 10))
    assert text.count("10, Partial") == 2 and text.count("10, Final") == 2


def test_period_and_flags_reach_the_scan(spark, stored):
    text = plan(
        surveys.survey_inbox_by_site(
            stored("survey_requests"), stored("grants"), stored("perms"), standin.AS_OF, ("ADMIN",)
        )
    )
    assert "In(periodo, [199804,199806])" in text
    assert "EqualTo(puede_ver,true)" in text and "EqualTo(usuario_activo,true)" in text


def test_named_principal_narrows_the_facts(spark, stored):
    history, grants = stored("history"), stored("grants")
    who = grants.filter("puede_ver").first().email_login
    text = plan(
        fulfilment.weekly_fulfilment(history, grants, standin.AS_OF, 90, principals=who)
    )
    assert "LeftSemi" in text and f"EqualTo(email_login,{who})" in text


def test_named_principal_narrows_the_lookups(spark, stored):
    """Rollup, devices and open posts of other sites are dropped before any of them is shuffled."""
    grants = stored("grants")
    who = grants.filter("puede_ver").first().email_login
    text = plan(
        coverage.coverage_by_site(
            stored("rollup"), grants, stored("devices"), stored("open_posts"), principals=who
        )
    )
    assert text.count("LeftSemi") == 3


def test_reports_read_the_months_they_need(spark, sf_dir, tmp_path):
    made = StandIn(spark, sf_dir)
    path = str(tmp_path / "history")
    write_history(made.history(), path)
    tables = {"history": path, "grants": made.grants(), "perms": made.perms()}
    reports = Reports(Tables(spark, tables))
    for report in (reports.weekly_fulfilment, reports.site_week_fulfilment):
        text = plan(report(as_of=standin.AS_OF))
        assert re.search(r"PartitionFilters: \[isnotnull\(ano_mes#\d+\), \(ano_mes#\d+ >= \d+\)", text)


def test_named_principal_costs_no_job_while_the_plan_is_made(spark, stored):
    grants, rollup = stored("grants"), stored("rollup")
    devices, posts = stored("devices"), stored("open_posts")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "no jobs")
    coverage.coverage_by_site(rollup, grants, devices, posts, principals=["1", "2"])
    assert not jobs.getJobIdsForGroup("planning")


def test_sites_of_a_named_principal_reach_the_scan_as_a_filter(spark, stored, as_on_a_cluster):
    """With sites that are too many for a broadcast: a bloom filter over the facts before they are shuffled."""
    history, grants = stored("history"), stored("grants")
    names = {
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    before = {n: spark.conf.get(n) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    who = grants.filter("puede_ver").first().email_login
    text = plan(fulfilment.weekly_fulfilment(history, grants, standin.AS_OF, 90, principals=who))
    for n, value in before.items():
        spark.conf.set(n, value)
    assert "might_contain" in text


def test_single_surveys_are_not_dealt_out_by_viewer(spark, stored):
    tables = stored("survey_requests"), stored("grants"), stored("perms")
    text = plan(surveys.survey_pages(*tables, standin.AS_OF, ("ADMIN",), page_rows=4))
    by_viewer = [line for line in text.split("\n") if "Exchange hashpartitioning(email_login" in line]
    assert by_viewer
    arrays = re.findall(r"Window \[[^\n]*email_login", text)
    assert not arrays


def test_one_row_of_each_key_sorts_no_table_by_all_columns(spark, stored):
    from ronda.operators.surveys import one_request_each

    text = plan(one_request_each(stored("survey_requests")))
    assert "Window" not in text and "partial_min" in text


def test_samples_leave_their_tasks_as_first_rows(spark, stored):
    from ronda.operators import contacts

    text = plan(contacts.site_samples(stored("site_contacts"), stored("contacts"), stored("perms")))
    assert text.count("5, Partial") >= 1 and text.count("10, Partial") >= 1
