"""What the reports send through shuffles."""

import datetime as dt
import re

import pytest
from literals import rows
from pyspark.sql import functions as F

from ronda.operators import shifts, submissions, summaries


@pytest.fixture
def static(spark):
    """Plans that show the exchanges as they are carried out."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def exchanges(df, key):
    """Exchanges by a key that are carried out; those read again do not count."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in text.splitlines() if re.search(r"(?<!Reused)Exchange hashpartitioning\(" + key, x) and "ReusedExchange" not in x]


def test_pages_are_not_moved_after_viewers_got_them(make, static):
    start = dt.datetime(2024, 1, 1, 8)
    facts = make("shifts", *[dict(instalacion_rol="s", cliente_rol="c", turno="A", her=start, rutrol=str(i)) for i in range(3)])
    posts = make("open_posts", *[dict(instalacion_rol=s, turno="A", jornada="1", her=start, hsr=start) for s in ("s", "s", "t")])
    grant = dict(email_login="a", cliente_rol="c", instalacion_rol="s", puede_ver=True)
    granted = make("grants", grant, grant, {**grant, "email_login": "b"}, {**grant, "instalacion_rol": "t"})
    pages = shifts.site_pages(facts, posts, granted, page_rows=2)
    assert not [x for x in exchanges(pages, "email_login") if "pagina" in x]
    found = {
        (r.email_login, r.instalacion_rol, r.pagina): (len(r.turnos or []), [s.cantidad_ppc for s in r.ppc_por_turno or []], r.total_turnos, r.total_ppc)
        for r in pages.collect()
    }
    assert found == {
        ("a", "s", 0): (4, [4], 6, 4),
        ("a", "s", 1): (2, [], 6, 4),
        ("b", "s", 0): (2, [2], 3, 2),
        ("b", "s", 1): (1, [], 3, 2),
        ("a", "t", 0): (0, [1], 0, 1),
    }


@pytest.fixture
def batch(make):
    at = dt.datetime(2024, 1, 1)
    people = make("perms", *[dict(email_login=e, nombre_completo=e.upper(), rol_id="CLIENTE", usuario_activo=True) for e in "ab"])
    asked = make(
        "survey_requests",
        *[dict(encuesta_id=s, modo="compartida", estado=e, fecha_limite=dt.datetime(2024, 2, 1)) for s, e in (("1", "pendiente"), ("2", "completada"), ("", "pendiente"))],
    )
    sent = [
        ("x", "1", "a", 2, " P ", []),
        ("y", "1", "b", 1, "Q", None),
        ("y", "1", "a", 3, "R", None),
        ("z", "2", "a", 1, "P", None),
        ("n", None, "a", 1, "P", None),
        ("m", "", "a", 1, "P", None),
        ("u", "1", "nobody", 0, "P", None),
    ]
    given = make(
        "submissions",
        *[
            dict(submission_id=i, encuesta_id=s, email=e, arrival=at + dt.timedelta(hours=h), encuestado_nombre=n, respuestas=r)
            for i, s, e, h, n, r in sent
        ],
    )
    return given, asked, people


@pytest.mark.parametrize("wanted", [submissions.DECISION, submissions.FOR_ANSWERS, submissions.FOR_REJECTIONS])
def test_both_looks_at_submissions_read_one_shuffle(batch, static, wanted):
    decided = submissions.decide_submissions(*batch, wanted=wanted)
    out = submissions.submission_answers(decided) if wanted == submissions.FOR_ANSWERS else decided
    for key in ("email", "encuesta_id"):
        # One of the submissions and one of the people or requests.
        assert len(exchanges(out, key + "#")) == 2
    assert decided.columns == list(wanted)
    whole = submissions.decide_submissions(*batch)
    assert rows(decided) == rows(whole.select(*wanted))
    verdicts = {r.submission_id: (r.resultado, r.cierra) for r in whole.collect()}
    assert verdicts == {
        "x": ("ya_respondida", False),
        "y": ("aceptada", True),
        "z": ("ya_respondida", False),
        "n": ("encuesta_desconocida", False),
        "m": ("aceptada", True),
        "u": ("usuario_desconocido", False),
    }


def test_closing_submissions_need_one_look(batch, static):
    closing = submissions.closing_submissions(*batch)
    assert len(exchanges(closing, "encuesta_id#")) == 2 and not exchanges(closing, "_encuesta")
    decided = submissions.decide_submissions(*batch).filter("cierra")
    assert rows(closing) == rows(decided.select(*submissions.FOR_REQUESTS)) and closing.count() == 2


def test_bitmaps_end_with_their_last_bit(spark, make):
    day = dict(semana="S1", isoweek=1, ano=2024, dia=dt.date(2024, 1, 3), zona="Z", empresa="E", cliente_rol="c", instalacion_rol="s")
    history = make("history", *[dict(**day, rutrol=f"{i:03d}") for i in (*range(20), 3, 3)])
    made = summaries.site_guards(history, summaries.guard_numbers(history))
    row = made.select(F.octet_length("guardias").alias("n"), F.bitmap_count("guardias").alias("k")).first()
    assert (row.n, row.k) == (3, 20)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.index("bitmap_construct_agg") < plan.index("Exchange") and "partial_bitmap_construct_agg" in plan[: plan.index("Exchange")]
    assert summaries._unions(made, ["instalacion_rol", "tramo"]).select(F.octet_length("guardias")).first()[0] == 3
