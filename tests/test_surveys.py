import datetime as dt
import random

from literals import grant, person, rows

from ronda.operators import submissions as sub
from ronda.operators import surveys

NOW = dt.datetime(2024, 6, 15, 12)
TODAY = NOW.date()
STAFF = ("JEFE_ORG",)


def request(key, mode="compartida", state="pendiente", to="a", site="s", period="202406", **more):
    row = dict(
        encuesta_id=key, modo=mode, estado=state, email_destinatario=to, instalacion_rol=site,
        cliente_rol="c", periodo=period, fecha_creacion=NOW, fecha_limite=NOW + dt.timedelta(days=9),
    )
    row.update(more)
    return row


def test_inbox_visibility_and_rights(make):
    requests = make(
        "survey_requests",
        request("shared"),
        request("mine", "individual", to="a@x"),
        request("cased", "individual", to="A@X"),
        request("other", "individual", to="b@x"),
        request("old", period="202402"),
        request("before", period="202404", state="completada"),
        request("done", "individual", "completada", to="A@X"),
    )
    perms = make("perms", person("a@x", "CLIENTE"), person("boss"), person("off", active=False))
    grants = make(
        "grants", *[grant(p, "s") for p in ("a@x", "a@x", "boss", "off")], grant("a@x", "t", sees=None)
    )
    args = requests, grants, perms, TODAY, STAFF
    seen = surveys.survey_inbox(*args)
    client = rows(
        seen.filter("email_login = 'a@x'"), "encuesta_id", "puede_responder", "puede_ver_respuestas"
    )
    assert client == [
        ("before", False, True),
        ("cased", False, False),
        ("done", False, False),
        ("mine", True, False),
        ("shared", True, False),
    ]
    boss = rows(seen.filter("email_login = 'boss'"), "encuesta_id", "puede_ver_respuestas")
    assert [k for k, _ in boss] == ["before", "cased", "done", "mine", "other", "shared"]
    assert dict(boss)["done"] is True
    assert seen.filter("email_login = 'off'").count() == 0
    totals = surveys.survey_inbox_by_site(*args)
    shown = rows(totals, "email_login", "total_encuestas", "respondidas", "pendientes")
    assert shown == [("a@x", 5, 2, 3), ("boss", 6, 2, 4)]


def test_site_totals_take_client_of_first_row(make):
    requests = make(
        "survey_requests",
        request("1", fecha_creacion=NOW, cliente_rol="old"),
        request("2", fecha_creacion=NOW + dt.timedelta(days=1), cliente_rol="new"),
        request("3", fecha_creacion=None, cliente_rol="undated", state="otra"),
    )
    perms = make("perms", person("boss"))
    grants = make("grants", *[grant("boss", "s", c) for c in ("old", "new", "undated")])
    got = surveys.survey_inbox_by_site(requests, grants, perms, TODAY, STAFF).first()
    assert (got.cliente_rol, got.total_encuestas, got.pendientes) == ("new", 3, 2)


def test_form_access(make):
    asks = make(
        "survey_asks",
        *[dict(email_login="a", encuesta_id=k) for k in ("1", "2", "none")],
    )
    requests = make("survey_requests", request("1"), request("2", site="t"))
    grants = make("grants", grant("a", "s", sees=False), grant("a", "s"), grant("a", "t", sees=None))
    questions = make(
        "questions",
        dict(pregunta_id="q2", orden=2, activa=True),
        dict(pregunta_id="q1", orden=1, activa=True),
        dict(pregunta_id="q3", orden=3, activa=False),
        dict(pregunta_id="q4", orden=4, activa=None),
    )
    form = surveys.survey_form(asks, requests, grants, questions)
    shown = rows(form.headers, "encuesta_id", "acceso", "instalacion_rol")
    assert shown == [("1", "ok", "s"), ("2", "sin_acceso", None), ("none", "no_encontrada", None)]
    assert rows(form.questions, "pregunta_id") == [("q1",), ("q2",)]


def test_answers_shown(make):
    requests = make(
        "survey_requests",
        request("1", "individual", "completada", to="a"),
        request("2", "compartida", "completada", to="a"),
        request("3", state="pendiente"),
        request("4", "individual", "completada", to=None),
    )
    answers = make(
        "answers",
        *[dict(respuesta_id=k + q, encuesta_id=k, pregunta_id=q) for k in "1234" for q in ("q", "gone")],
    )
    questions = make("questions", dict(pregunta_id="q", orden=1, activa=False))
    perms = make("perms", person("a", "CLIENTE"), person("b", "CLIENTE"), person("boss"))
    asks = make("survey_asks", *[dict(email_login=p, encuesta_id=k) for p in ("a", "b", "boss") for k in "1234"])
    access = surveys.answer_access(asks, requests, perms, STAFF)
    denied = rows(access.filter("acceso = 'sin_acceso'"), "email_login", "encuesta_id")
    assert denied == [("a", "4"), ("b", "1"), ("b", "4")]
    assert access.filter("acceso = 'sin_responder'").count() == 3
    shown = surveys.answers_for(access, surveys.survey_answers(requests, answers, questions))
    assert rows(shown, "email_login", "encuesta_id") == [
        ("a", "1"), ("a", "2"), ("b", "2"), ("boss", "1"), ("boss", "2"), ("boss", "4"),
    ]


def one_by_one(batch, requests, people):
    """The rules applied to each submission in turn, as the check of the batch."""
    state = {r["encuesta_id"]: dict(r) for r in requests}
    verdicts, answers = {}, []
    for s in sorted(batch, key=lambda s: (s["arrival"], s["submission_id"])):
        user, r = people.get(s["email"]), state.get(s["encuesta_id"])
        given = s["encuestado_nombre"]
        name = (given or "").strip()
        if user is None or not user["usuario_activo"]:
            verdict = "usuario_desconocido"
        elif r is None:
            verdict = "encuesta_desconocida"
        elif r["modo"] == "individual" and r["email_destinatario"] != s["email"]:
            verdict = "no_destinatario"
        elif r["modo"] == "compartida" and r["estado"] == "completada":
            verdict = "ya_respondida"
        elif r["modo"] == "compartida" and not name:
            verdict = "falta_encuestado"
        elif r["fecha_limite"] is None:
            verdict = "sin_fecha_limite"
        elif r["fecha_limite"] < s["arrival"]:
            verdict = "vencida"
        elif r["estado"] == "completada" and r.get("respondido_por_email") == s["email"]:
            verdict = "ya_respondida_por_usuario"
        else:
            verdict = "aceptada"
            answers += [(s["encuesta_id"], p, s["arrival"]) for p, _, _ in s["respuestas"] or []]
            if r["estado"] == "pendiente":
                keep = r["modo"] != "compartida" and not given
                r.update(
                    estado="completada",
                    respondido_por_email=s["email"],
                    respondido_por_nombre=user["nombre_completo"],
                    encuestado_nombre=r.get("encuestado_nombre") if keep else name or None,
                    tipo_respuesta="cliente" if user["rol_id"] == "CLIENTE" else "org",
                    fecha_respuesta=s["arrival"],
                )
        verdicts[s["submission_id"]] = verdict
    return verdicts, sorted(answers), state


def test_batch_is_as_one_by_one(make):
    rnd = random.Random(7)
    modes, states = ["compartida", "individual", "otra"], ["pendiente", "pendiente", "completada", None]
    requests = [
        request(
            f"e{i}", rnd.choice(modes), rnd.choice(states), to=rnd.choice(["p0", "p1", "P1", None]),
            respondido_por_email=rnd.choice(["p0", "p1", None]),
            encuestado_nombre=rnd.choice(["Eva", None]),
            fecha_limite=rnd.choice([NOW, NOW + dt.timedelta(days=3), NOW + dt.timedelta(days=30), None]),
        )
        for i in range(40)
    ]
    people = {
        p: person(p, role, active=p != "p3")
        for p, role in (("p0", "CLIENTE"), ("p1", "JEFE_ORG"), ("p2", None), ("p3", "CLIENTE"))
    }
    # A third of all submissions is for one survey.
    batch = [
        dict(
            submission_id=f"s{i:04d}",
            encuesta_id="e0" if i % 3 == 0 else f"e{rnd.randrange(42)}",
            email=f"p{rnd.choice([0, 0, 1, 1, 2, 3, 4])}",
            encuestado_nombre=rnd.choice([None, "", " \t", " Ana ", "Bea"]),
            respuestas=rnd.choice([None, [], [("q1", "5", None)], [("q1", "5", "x"), ("q2", None, "y")]]),
            arrival=NOW + dt.timedelta(hours=rnd.randrange(0, 24 * 10)),
        )
        for i in range(600)
    ]
    verdicts, answers, state = one_by_one(batch, requests, people)
    tables = make("submissions", *batch), make("survey_requests", *requests), make("perms", *people.values())
    decided = sub.decide_submissions(*tables)
    assert {r.submission_id: r.resultado for r in decided.collect()} == verdicts
    assert len(set(verdicts.values())) == 9
    out = sub.apply_submissions(*tables)
    assert rows(out.answers, "encuesta_id", "pregunta_id", "fecha_respuesta") == sorted(answers, key=repr)
    assert out.answers.select("respuesta_id").distinct().count() == len(answers)
    columns = ["encuesta_id", "estado", "respondido_por_email", "respondido_por_nombre",
               "encuestado_nombre", "tipo_respuesta", "fecha_respuesta"]
    expected = [tuple(r.get(c) for c in columns) for r in state.values()]
    assert rows(out.requests, *columns) == sorted(expected, key=repr)
    refused = sum(v != "aceptada" for v in verdicts.values())
    assert out.rejections.count() == refused


def inbox_lists(requests, grants, perms):
    """(viewer, site, ids) in order, by a loop over everything."""
    people = {p["email_login"]: p["rol_id"] for p in perms if p["usuario_activo"]}
    lists = {}
    for who, role in people.items():
        sees = {(g["cliente_rol"], g["instalacion_rol"]) for g in grants if g["email_login"] == who and g["puede_ver"]}
        for r in requests:
            mine = r["modo"] == "compartida" or (
                r["modo"] == "individual" and (r["email_destinatario"] or "").lower() == who.lower()
            )
            if (r["cliente_rol"], r["instalacion_rol"]) in sees and (role in STAFF or mine):
                lists.setdefault((who, r["instalacion_rol"]), []).append(r)
    newest = lambda r: (r["fecha_creacion"] is None, -(r["fecha_creacion"] or NOW).timestamp())
    return {
        k: [r["encuesta_id"] for r in sorted(v, key=lambda r: (r["modo"], newest(r), r["encuesta_id"]))]
        for k, v in lists.items()
    }


def test_pages_as_lists_of_each_viewer(make):
    rnd = random.Random(4)
    requests = [
        request(
            f"e{k:03d}", rnd.choice(["compartida", "individual"]), rnd.choice(["pendiente", "completada"]),
            rnd.choice(["a@x", "A@X", "b@x", None]), rnd.choice("st"), cliente_rol=rnd.choice("cd"),
            fecha_creacion=rnd.choice([None, NOW, NOW - dt.timedelta(hours=1)]),
        )
        for k in range(160)
    ]
    perms = [person("a@x", "CLIENTE"), person("b@x", "CLIENTE"), person("boss"), person("off", active=False), person("new", "CLIENTE")]
    grants = [
        grant("a@x", "s"), grant("a@x", "s"), grant("a@x", "s", "d"), grant("b@x", "s"), grant("b@x", "t", "d"),
        grant("boss", "s"), grant("boss", "t"), grant("boss", "t", "d"), grant("off", "s"), grant("new", "t", sees=None),
    ]
    want = inbox_lists(requests, grants, perms)
    tables = make("survey_requests", *requests), make("grants", *grants), make("perms", *perms)
    flat = surveys.survey_inbox(*tables, TODAY, STAFF)
    rights = {(r.email_login, r.encuesta_id): (r.puede_responder, r.puede_ver_respuestas) for r in flat.collect()}
    for size in (1, 2, 7, 1000):
        pages = surveys.survey_pages(*tables, TODAY, STAFF, page_rows=size).collect()
        got = {}
        for p in sorted(pages, key=lambda p: p.pagina):
            got.setdefault((p.email_login, p.instalacion_rol), []).append((p.pagina, p.encuestas))
        assert got.keys() == want.keys()
        for key, parts in got.items():
            assert [k for k, _ in parts] == list(range(len(parts)))
            assert all(len(e) == size for _, e in parts[:-1]) and 0 < len(parts[-1][1]) <= size
            assert [e.encuesta_id for _, es in parts for e in es] == want[key]
            assert all(rights[key[0], e.encuesta_id] == (e.puede_responder, e.puede_ver_respuestas) for _, es in parts for e in es)


def test_repeated_requests_are_one_survey_everywhere(make, spark):
    later = NOW + dt.timedelta(days=1)
    requests = make(
        "survey_requests",
        request("k", fecha_creacion=later),
        request("k", state="completada", respondido_por_email="b"),
        request("k"),
        request("p", fecha_creacion=later),
        request("p"),
    )
    grants, perms = make("grants", grant("a", "s")), make("perms", person("a"))
    questions = make("questions", dict(pregunta_id="q", texto_pregunta="?", orden=1, activa=True))
    answers = make("answers", dict(respuesta_id="r", encuesta_id="k", pregunta_id="q", respuesta_valor="5"))
    asks = make("survey_asks", dict(email_login="a", encuesta_id="k"), dict(email_login="a", encuesta_id="p"))
    headers = surveys.survey_form(asks, requests, grants, questions).headers
    assert rows(headers, "encuesta_id", "estado") == [("k", "completada"), ("p", "pendiente")]
    access = surveys.answer_access(asks, requests, perms, STAFF)
    assert rows(access, "encuesta_id", "acceso") == [("k", "ok"), ("p", "sin_responder")]
    shown = surveys.answers_for(access, surveys.survey_answers(requests, answers, questions))
    assert rows(shown, "encuesta_id", "respuesta_valor") == [("k", "5")]
    one = sub.one_request_each(requests)
    assert rows(one, "encuesta_id", "estado", "fecha_creacion") == [("k", "completada", NOW), ("p", "pendiente", NOW)]
