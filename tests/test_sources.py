import datetime as dt
import re

import pytest
from literals import person, rows
from pyspark.sql import functions as F

from ronda.operators import updates
from ronda.plans import jobs
from ronda.schemas import SCHEMAS, require_columns
from ronda.settings import Settings
from ronda.sources import history, sinks
from ronda.sources.standin import StandIn
from ronda.sources.tables import Tables

NOW = dt.datetime(2024, 6, 15, 12)


def test_standin_has_every_schema(spark, sf_dir):
    tables = StandIn(spark, sf_dir)
    for name in SCHEMAS:
        if name != "messages":
            require_columns(getattr(tables, name)(), name)


def test_wrong_columns_are_named(spark):
    df = spark.createDataFrame([("s", 1)], "nombre string, numero int")
    with pytest.raises(ValueError, match="numero is int, not string; ult_conexion is missing"):
        require_columns(df, "devices")


def test_tables_from_path_view_and_frame(spark, make, tmp_path):
    path = str(tmp_path / "devices")
    make("devices", dict(nombre="s")).write.parquet(path)
    make("contacts", dict(contacto_id="1", activo=True), dict(contacto_id="2")).createOrReplaceTempView("people")
    tables = Tables(spark, {"devices": path, "contacts": "people", "perms": make("perms", person("a"))})
    assert tables["devices"].count() == 1 and "grants" not in tables
    tables.register_views()
    found = tables.sql("SELECT contacto_id FROM contacts WHERE array_contains(:ids, contacto_id)", ids=["2", "3"])
    assert rows(found) == [("2",)]
    assert tables.sql("SELECT * FROM perms WHERE email_login = :who", who="b").count() == 0
    with pytest.raises(ValueError, match="unknown tables: nope"):
        Tables(spark, {"nope": path})


def test_history_window_prunes_months(spark, sf_dir, tmp_path):
    path = str(tmp_path / "history")
    whole = StandIn(spark, sf_dir).history()
    history.write_history(whole, path)
    as_of = dt.date(1998, 6, 30)
    window = history.read_history(spark, path, as_of, 90)
    first = as_of - dt.timedelta(days=90)
    direct = whole.filter(F.col("dia").between(F.lit(first), F.lit(as_of)))
    assert rows(window.select(*whole.columns)) == rows(direct)
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(ano_mes#\d+\), \(ano_mes#\d+ >= 199804\)", plan)
    months = [p for p in (tmp_path / "history").iterdir() if p.is_dir()]
    assert all(len(list(m.glob("*.parquet"))) == 1 for m in months)


def test_batch_can_be_repeated(spark, tmp_path):
    path = str(tmp_path / "out")
    for _ in range(2):
        sinks.append_batch(spark.range(3), path, "b1")
    sinks.append_batch(spark.range(2), path, "b2")
    assert spark.read.parquet(path).count() == 5
    sinks.append_batch(spark.range(9), path, "b1")  # complete: kept
    assert spark.read.parquet(path).count() == 5
    sinks.append_batch(spark.range(9), path, "b1", replace=True)
    assert spark.read.parquet(path).count() == 11
    sinks.append_rows(spark.range(1), str(tmp_path / "plain"))
    sinks.append_rows(spark.range(1), str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 2
    with pytest.raises(ValueError):
        sinks.append_batch(spark.range(1), path, "../b")


def test_versions(spark, tmp_path):
    base = str(tmp_path / "users")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, base)
    sinks.publish_version(spark.range(1), base, 1)
    newest = sinks.read_version(spark, base)
    sinks.publish_version(newest.unionByName(spark.range(5)), base, 2)
    assert sinks.latest_version(spark, base) == 2
    assert sinks.read_version(spark, base).count() == 6
    assert sinks.read_version(spark, base, 1).count() == 1
    with pytest.raises(ValueError, match="exists"):
        sinks.publish_version(spark.range(1), base, 2)
    # An attempt that did not finish is not seen, and is replaced.
    (tmp_path / "users" / "v00000003").mkdir()
    assert sinks.latest_version(spark, base) == 2
    sinks.publish_version(spark.range(4), base, 3)
    assert sinks.read_version(spark, base).count() == 4


def test_submission_job(spark, make, tmp_path):
    store = str(tmp_path / "store")
    survey = dict(
        encuesta_id="1", modo="compartida", estado="pendiente", fecha_limite=NOW + dt.timedelta(days=1)
    )
    sinks.publish_version(make("survey_requests", survey), f"{store}/requests", 1)
    sent = [
        dict(submission_id=k, encuesta_id="1", email="a", encuestado_nombre="Ana",
             respuestas=[("q", "5", None)], arrival=NOW + dt.timedelta(minutes=m))
        for k, m in (("x", 2), ("y", 1))
    ]
    perms = make("perms", person("a", "SUPERVISOR_ACME"))
    jobs.run_submissions(spark, make("submissions", *sent), "day1", perms, store, Settings(org_code="ACME"))
    closed = sinks.read_version(spark, f"{store}/requests").first()
    assert (closed.estado, closed.respondido_por_email, closed.tipo_respuesta) == ("completada", "a", "acme")
    assert closed.fecha_respuesta == NOW + dt.timedelta(minutes=1)
    assert spark.read.parquet(f"{store}/answers").count() == 1
    assert rows(spark.read.parquet(f"{store}/rejections"), "submission_id", "motivo") == [("x", "ya_respondida")]
    later = make("submissions", dict(sent[0], submission_id="z"))
    jobs.run_submissions(spark, later, "day2", perms, store)
    assert spark.read.parquet(f"{store}/answers").count() == 1
    assert spark.read.parquet(f"{store}/rejections").count() == 2


def test_submission_job_again_after_failure(spark, make, tmp_path):
    """Everything but the last step was done before; the rerun gives the same."""
    store = str(tmp_path / "store")
    survey = dict(
        encuesta_id="1", modo="individual", estado="pendiente", email_destinatario="a",
        fecha_limite=NOW + dt.timedelta(days=1),
    )
    sinks.publish_version(make("survey_requests", survey), f"{store}/requests", 1)
    perms = make("perms", person("a"))
    batch = make("submissions", dict(submission_id="x", encuesta_id="1", email="a", arrival=NOW,
                                     respuestas=[("q", "1", None)]))
    stale = make("submissions", dict(submission_id="old", encuesta_id="none", email="a", arrival=NOW))
    half = jobs.submissions.decide_submissions(stale, make("survey_requests", survey), perms)
    sinks.append_batch(half, f"{store}/decisions", "b")
    jobs.run_submissions(spark, batch, "b", perms, store)
    assert rows(spark.read.parquet(f"{store}/decisions"), "submission_id", "resultado") == [("x", "aceptada")]
    assert sinks.read_version(spark, f"{store}/requests").first().estado == "completada"


def _store(spark, store):
    return [
        rows(spark.read.parquet(f"{store}/{name}"))
        for name in ("decisions", "answers", "rejections")
    ] + [rows(sinks.read_version(spark, f"{store}/requests"))]


def test_finished_batch_again(spark, make, tmp_path):
    """A batch run twice after success, with repeated submissions and requests, changes nothing."""
    store = str(tmp_path / "store")
    survey = dict(
        encuesta_id="1", modo="individual", estado="pendiente", email_destinatario="a",
        fecha_limite=NOW + dt.timedelta(days=1),
    )
    sinks.publish_version(make("survey_requests", survey, survey), f"{store}/requests", 1)
    perms = make("perms", person("a"))
    sent = dict(submission_id="x", encuesta_id="1", email="a", arrival=NOW, respuestas=[("q", "1", None)])
    batch = make("submissions", sent, sent)
    jobs.run_submissions(spark, batch, "b", perms, store)
    first = _store(spark, store)
    assert [len(x) for x in first] == [1, 1, 0, 2]
    for _ in range(2):
        jobs.run_submissions(spark, batch, "b", perms, store)
    assert _store(spark, store) == first
    assert sinks.latest_version(spark, f"{store}/requests") == 2
    late = make("submissions", dict(sent, submission_id="y"))
    jobs.run_submissions(spark, late, "c", perms, store)
    jobs.run_submissions(spark, batch, "b", perms, store)
    assert spark.read.parquet(f"{store}/answers").count() == 1
    assert rows(spark.read.parquet(f"{store}/rejections"), "submission_id") == [("y",)]
    assert sinks.latest_version(spark, f"{store}/requests") == 3


def test_update_with_a_repeated_key(make):
    users = make("users", dict(email_login="a"), dict(email_login="b"))
    changes = users.select("email_login", F.lit("t").alias("fcm_token"))
    changed = updates.keyed_update(users, changes.union(changes), "email_login", {"fcm_token": F.col("new.fcm_token")})
    assert rows(changed, "email_login", "fcm_token") == [("a", "t"), ("b", "t")]


def test_other_jobs(spark, make, tmp_path):
    users = str(tmp_path / "users")
    sinks.publish_version(make("users", dict(email_login="a")), users, 1)
    change = make("user_updates", dict(email_login="a", fcm_token="t", momento=NOW))
    assert jobs.run_user_updates(change, users) == 2
    assert sinks.read_version(spark, users).first().fcm_token == "t"
    shift = dict(instalacion_rol="s", cliente_rol="c", asistencia=1)
    assert jobs.run_rollup(make("shifts", shift), str(tmp_path / "rollup"), NOW) == 1
    assert sinks.read_version(spark, str(tmp_path / "rollup")).first().guardias_presentes == 1
    request = dict(solicitud_id="1", email_usuario="a", instalaciones=["s"])
    link = dict(email_login="a", contacto_id="1", instalacion_rol="s", puede_contactar=True)
    jobs.run_fan_out(
        make("outbound_requests", request), make("user_contacts", link),
        make("contacts", dict(contacto_id="1", activo=True)), NOW, str(tmp_path / "messages"), "b1",
    )
    assert spark.read.parquet(str(tmp_path / "messages")).count() == 1
