"""Every report with the permission it needs, over a table registry.

``principals`` is one address, several, a frame of them, or None for all.  A
report answers for those of them who are active and hold its flag.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ronda.operators import (
    contacts,
    coverage,
    fulfilment,
    messaging,
    open_posts,
    scope,
    shifts,
    surveys,
)
from ronda.operators.nesting import PAGE_ROWS
from ronda.operators.scope import Principals
from ronda.settings import Settings
from ronda.sources.tables import Tables

COVERAGE = "puede_ver_cobertura"
WRITE = "puede_enviar_mensajes"
READ_INBOX = "puede_ver_mensajes_recibidos"


class Reports:
    def __init__(self, tables: Tables, settings: Settings | None = None):
        self.tables = tables
        self.settings = settings or Settings.from_spark(tables.spark)

    def allowed(self, principals: Principals, flag: str | None = None) -> DataFrame | list[str]:
        """The principals who may have the report.  Of a few named ones the
        names remain, so that a report can narrow its facts to their sites."""
        found = scope.restrict(scope.permitted(self.tables["perms"], flag), principals)
        if principals is None or isinstance(principals, DataFrame):
            return found
        return [row.email_login for row in found.collect()]

    def profile(self, principals: Principals = None) -> DataFrame:
        return scope.restrict(scope.permission_profile(self.tables["perms"]), principals)

    def coverage_overall(self, principals: Principals = None) -> DataFrame:
        t = self.tables
        return coverage.coverage_overall(
            t["rollup"],
            t["grants"],
            t["open_posts"],
            self.settings,
            self.allowed(principals, COVERAGE),
        )

    def _by_site(self, report, principals: Principals, flag: str | None, **options) -> DataFrame:
        t = self.tables
        return report(
            t["rollup"],
            t["grants"],
            t["devices"],
            t["open_posts"],
            settings=self.settings,
            principals=self.allowed(principals, flag),
            **options,
        )

    def coverage_by_site(self, principals: Principals = None) -> DataFrame:
        return self._by_site(coverage.coverage_by_site, principals, COVERAGE)

    def coverage_by_site_fast(self, principals: Principals = None) -> DataFrame:
        return self._by_site(coverage.coverage_by_site_fast, principals, None)

    def coverage_by_site_service(self, principals: Principals = None) -> DataFrame:
        return self._by_site(coverage.coverage_by_site_service, principals, None)

    def shift_detail(self, principals: Principals = None) -> DataFrame:
        who = self.allowed(principals, COVERAGE)
        return shifts.shift_detail(self.tables["shifts"], self.tables["grants"], who)

    def shift_pages(self, principals: Principals = None, page_rows: int = PAGE_ROWS) -> DataFrame:
        who = self.allowed(principals, COVERAGE)
        return shifts.shift_pages(self.tables["shifts"], self.tables["grants"], who, page_rows)

    def site_pages(self, principals: Principals = None, page_rows: int = PAGE_ROWS) -> DataFrame:
        """The whole detail of a site: shifts and open slots by page, with the totals."""
        t = self.tables
        who = self.allowed(principals, COVERAGE)
        return shifts.site_pages(t["shifts"], t["open_posts"], t["grants"], who, page_rows)

    def shift_sites(self, principals: Principals = None) -> DataFrame:
        t = self.tables
        who = self.allowed(principals, COVERAGE)
        return shifts.shift_sites(t["shifts"], t["open_posts"], t["grants"], who)

    def site_shift_detail(
        self, site: str | None = None, principals: Principals = None
    ) -> DataFrame:
        who = self.allowed(principals, COVERAGE)
        return shifts.site_shift_detail(self.tables["shifts"], self.tables["grants"], site, who)

    def site_shift_totals(
        self, site: str | None = None, principals: Principals = None
    ) -> DataFrame:
        who = self.allowed(principals, COVERAGE)
        return shifts.site_shift_totals(self.tables["shifts"], self.tables["grants"], site, who)

    def weekly_fulfilment(
        self, as_of: dt.date, days: int | None = None, principals: Principals = None
    ) -> DataFrame:
        who = self.allowed(principals, COVERAGE)
        return fulfilment.weekly_fulfilment(
            self.tables["history"], self.tables["grants"], as_of, days, self.settings, who
        )

    def site_week_fulfilment(
        self, as_of: dt.date, days: int | None = None, principals: Principals = None
    ) -> DataFrame:
        who = self.allowed(principals, COVERAGE)
        return fulfilment.site_week_fulfilment(
            self.tables["history"], self.tables["grants"], as_of, days, self.settings, who
        )

    def open_posts_total(self, principals: Principals = None) -> DataFrame:
        who = self.allowed(principals, COVERAGE)
        return open_posts.open_posts_total(self.tables["open_posts"], self.tables["grants"], who)

    def open_posts_by_slot(
        self,
        site: str | None = None,
        with_working_day: bool = False,
        principals: Principals = None,
    ) -> DataFrame:
        who = self.allowed(principals, COVERAGE)
        return open_posts.open_posts_by_slot(
            self.tables["open_posts"], self.tables["grants"], site, with_working_day, who
        )

    def open_posts_nested(
        self, with_working_day: bool = False, principals: Principals = None, page_rows: int = PAGE_ROWS
    ) -> DataFrame:
        who = self.allowed(principals, COVERAGE)
        return open_posts.open_posts_nested(
            self.tables["open_posts"], self.tables["grants"], with_working_day, who, page_rows
        )

    def open_posts_by_site(self, principals: Principals = None) -> DataFrame:
        return open_posts.open_posts_by_site(self.open_posts_by_slot(principals=principals))

    def survey_inbox(self, as_of: dt.date, principals: Principals = None) -> DataFrame:
        t = self.tables
        staff = self.settings.inbox_staff_roles
        return surveys.survey_inbox(
            t["survey_requests"], t["grants"], t["perms"], as_of, staff, principals
        )

    def survey_inbox_by_site(self, as_of: dt.date, principals: Principals = None) -> DataFrame:
        t = self.tables
        staff = self.settings.inbox_staff_roles
        return surveys.survey_inbox_by_site(
            t["survey_requests"], t["grants"], t["perms"], as_of, staff, principals
        )

    def survey_pages(
        self, as_of: dt.date, principals: Principals = None, page_rows: int = PAGE_ROWS
    ) -> DataFrame:
        t = self.tables
        staff = self.settings.inbox_staff_roles
        return surveys.survey_pages(
            t["survey_requests"], t["grants"], t["perms"], as_of, staff, principals, page_rows
        )

    def _asks(self, asks: DataFrame) -> DataFrame:
        return asks.join(self.allowed(None), "email_login", "left_semi")

    def survey_form(self, asks: DataFrame) -> surveys.SurveyForm:
        t = self.tables
        return surveys.survey_form(
            self._asks(asks), t["survey_requests"], t["grants"], t["questions"]
        )

    def survey_answer_access(self, asks: DataFrame) -> DataFrame:
        """The header of every answer page, or why there is none."""
        t = self.tables
        return surveys.answer_access(
            asks, t["survey_requests"], t["perms"], self.settings.answer_staff_roles
        )

    def survey_answers(self, asks: DataFrame) -> DataFrame:
        t = self.tables
        access = self.survey_answer_access(asks)
        answers = surveys.survey_answers(t["survey_requests"], t["answers"], t["questions"])
        return surveys.answers_for(access, answers)

    def site_contacts(self, site: str | None = None, principals: Principals = None) -> DataFrame:
        t = self.tables
        who = self.allowed(principals)
        return contacts.site_contacts(t["grants"], t["site_contacts"], t["contacts"], site, who)

    def co_assigned_contacts(self, asks: DataFrame) -> DataFrame:
        """Contacts of ``sobre`` for every ask of ``email_login`` about it."""
        t = self.tables
        permitted = contacts.own_or_admin(asks, t["perms"])
        about = permitted.select(F.col("sobre").alias("email_login")).distinct()
        return contacts.co_assigned_contacts(
            t["user_contacts"], t["site_contacts"], t["perms"], about
        )

    def site_participants(self, sites: Sequence[str] | None = None) -> DataFrame:
        t = self.tables
        found = contacts.site_participants(
            t["site_contacts"], t["contacts"], t["grants"], t["perms"], sites
        )
        return found.filter("con_uid").drop("con_uid")

    def participants_across_sites(self, sites: Sequence[str] | None = None) -> DataFrame:
        return self.site_participants(sites).drop("instalacion_rol").distinct()

    def participant_funnel(self) -> DataFrame:
        t = self.tables
        return contacts.participant_funnel(
            t["site_contacts"], t["contacts"], t["grants"], t["perms"]
        )

    def site_samples(self, site: str | None = None) -> DataFrame:
        t = self.tables
        return contacts.site_samples(t["site_contacts"], t["contacts"], t["perms"], site)

    def fan_out_messages(self, as_of: dt.datetime) -> DataFrame:
        """Messages of the senders who may write, with the client of their profile."""
        t = self.tables
        senders = t["perms"].filter("usuario_activo").filter(WRITE)
        requests = t["outbound_requests"].drop("cliente_rol")
        sent = requests.join(
            senders.select(F.col("email_login").alias("email_usuario"), "cliente_rol"),
            "email_usuario",
        )
        return messaging.fan_out_messages(sent, t["user_contacts"], t["contacts"], as_of)

    def inbox(self, principals: Principals = None) -> DataFrame:
        messages = self.tables["inbox_messages"]
        addressed = messages.withColumn("email_login", F.col("destinatario_email_app"))
        wanted = scope.restrict(addressed, self.allowed(principals, READ_INBOX))
        return messaging.inbox(wanted.select(*messages.columns), self.settings.inbox_rows)

    def notification_payloads(self) -> DataFrame:
        t = self.tables
        return messaging.notification_payloads(t["chat_messages"], t["users"], t["perms"])

    def device_tokens(self) -> DataFrame:
        return messaging.device_tokens(self.tables["users"])
