import datetime as dt
import random

from literals import grant, person, rows

from ronda.operators import contacts, messaging, updates

NOW = dt.datetime(2024, 1, 1, 12)


def linked(*pairs):
    return [dict(contacto_id=c, instalacion_rol=s, cliente_rol="c") for c, s in pairs]


def test_site_contacts(make):
    got = contacts.site_contacts(
        make("grants", grant("a", "s"), grant("a", "t", "other")),
        make("site_contacts", *linked(("1", "s"), ("2", "s"), ("3", "t"))),
        make("contacts", dict(contacto_id="1", activo=True), dict(contacto_id="2", activo=None),
             dict(contacto_id="3", activo=True)),
    )
    assert rows(got, "email_login", "contacto_id") == [("a", "1")]


def test_co_assigned_as_brute_force(make):
    rnd = random.Random(3)
    people = [
        person(f"p{i}", uid=rnd.choice(["auto", "auto", "", None]), active=rnd.random() < 0.8)
        for i in range(30)
    ]
    # One circle holds a third of all assignments.
    assigned = {
        (f"p{rnd.randrange(30)}", "1", "s") if i % 3 == 0
        else (f"p{rnd.randrange(30)}", str(rnd.randrange(5)), rnd.choice("st"))
        for i in range(120)
    }
    live = {(str(c), s) for c in range(4) for s in "st"}
    expected = set()
    reachable = {p["email_login"] for p in people if p["usuario_activo"] and p["firebase_uid"]}
    for a, c, s in assigned:
        for b, c2, s2 in assigned:
            if a != b and (c, s) == (c2, s2) and (c, s) in live and b in reachable:
                expected.add((a, b))
    tables = (
        make("user_contacts", *[dict(email_login=a, contacto_id=c, instalacion_rol=s) for a, c, s in assigned]),
        make("site_contacts", *linked(*live), *linked(("1", "s"))),
        make("perms", *people),
    )
    everyone = sorted({a for a, _, _ in assigned})
    got = contacts.co_assigned_contacts(*tables, everyone)
    assert set(rows(got, "solicitante", "email_login")) == expected
    assert got.count() == len(expected)
    one = contacts.co_assigned_contacts(*tables, "p1")
    assert set(rows(one, "solicitante", "email_login")) == {e for e in expected if e[0] == "p1"}


def test_asking_about_others_needs_admin(spark, make):
    perms = make("perms", person("a"), person("boss", es_admin=True), person("off", active=False))
    asks = spark.createDataFrame(
        [("a", "a"), ("a", "b"), ("boss", "b"), ("off", "off")], "email_login string, sobre string"
    )
    assert rows(contacts.own_or_admin(asks, perms), "email_login", "sobre") == [("a", "a"), ("boss", "b")]


def participant_tables(make):
    return (
        make("site_contacts", *linked(("1", "s"), ("2", "s"), ("3", "s"), ("4", "s"), ("1", "t"))),
        make(
            "contacts",
            dict(contacto_id="1", activo=True, es_usuario_app=True, email_usuario_app="boss"),
            dict(contacto_id="2", activo=True, es_usuario_app=True, email_usuario_app="cli"),
            dict(contacto_id="3", activo=True, es_usuario_app=None, email_usuario_app="boss2"),
            dict(contacto_id="4", activo=True, es_usuario_app=True, email_usuario_app="blank"),
        ),
        make("grants", grant("cli", "s", sees=False), grant("cli", "s"), grant("boss2", "s"), grant("cli2", "u")),
        make("perms", person("boss"), person("boss2"), person("blank", uid=" \t"),
             person("cli", "CLIENTE"), person("cli2", "CLIENTE", uid=None), person("norole", None)),
    )


def test_participants(make):
    tables = participant_tables(make)
    got = contacts.site_participants(*tables)
    assert rows(got, "instalacion_rol", "email_login", "con_uid") == [
        ("s", "blank", False), ("s", "boss", True), ("s", "cli", True), ("t", "boss", True),
        ("u", "cli2", False),
    ]
    assert contacts.participants_across_sites(got).count() == 4
    assert rows(contacts.site_participants(*tables, sites=["t"]), "email_login") == [("boss",)]
    assert contacts.site_participants(*tables, sites=[]).count() == 0


def test_funnel(make):
    got = contacts.participant_funnel(*participant_tables(make))
    assert rows(got) == [("s", 4, 3, 3, 2, 1), ("t", 1, 0, 1, 1, 0), ("u", 0, 1, 0, 0, 0)]
    tables = participant_tables(make)
    sample = contacts.participant_samples(tables[0], tables[1], "s", 2)
    assert rows(sample, "contacto_id", "existe") == [("1", True), ("2", True)]


def test_repeated_site_sends_twice(make):
    requests = make(
        "outbound_requests",
        dict(solicitud_id="1", email_usuario="a", cliente_rol="c", mensaje="m", instalaciones=["s", "t", "s"]),
        dict(solicitud_id="2", email_usuario="a", cliente_rol="c", mensaje="m", instalaciones=[]),
    )
    allowed = make(
        "user_contacts",
        *[dict(email_login="a", contacto_id=c, instalacion_rol="s", puede_contactar=v)
          for c, v in (("1", True), ("1", True), ("2", False), ("3", None), ("4", True))],
    )
    people = make("contacts", *[dict(contacto_id=c, activo=c != "4") for c in "1234"])
    got = messaging.fan_out_messages(requests, allowed, people, NOW)
    assert rows(got, "instalacion_rol", "contacto_id", "estado") == [("s", "1", "pendiente")] * 2
    assert got.select("mensaje_id").distinct().count() == 2
    again = messaging.fan_out_messages(requests, allowed, people, NOW)
    assert rows(got) == rows(again)


def test_inbox_keeps_the_newest_of_a_hot_recipient(make):
    messages = [
        dict(mensaje_id=f"{i:04d}", destinatario_email_app="hot" if i % 3 else f"p{i % 7}",
             fecha_envio=NOW + dt.timedelta(minutes=i // 2))
        for i in range(600)
    ]
    got = messaging.inbox(make("inbox_messages", *messages), rows=5, salts=4)
    expected = []
    for who in {m["destinatario_email_app"] for m in messages}:
        mine = [m for m in messages if m["destinatario_email_app"] == who]
        mine.sort(key=lambda m: (m["fecha_envio"], m["mensaje_id"]), reverse=True)
        expected += [(who, i + 1, m["mensaje_id"]) for i, m in enumerate(mine[:5])]
    assert rows(got, "email_login", "puesto", "mensaje_id") == sorted(expected, key=repr)


def chat(key, sender="us", to=None, visible=True, text="hola"):
    return dict(conversation_id="k", message_id=key, sender_id=sender, sender_name="S",
                message_text=text, visible_para_cliente=visible, participant_user_ids=to)


def test_notification_recipients(make):
    def user(email, uid="auto", token="t"):
        return dict(email_login=email, firebase_uid="u" + email if uid == "auto" else uid, fcm_token=token)

    users = make(
        "users", user("s"), user("cli"), user("boss"), user("off"), user("stranger"), user("notoken", token=""),
        user("nouid", uid=None), user("emptyuid", uid=""),
    )
    perms = make("perms", person("s"), person("cli", "CLIENTE"), person("boss", None), person("off", active=False))
    messages = make(
        "chat_messages",
        chat("all"),
        chat("empty", to=[]),
        chat("hidden", visible=False),
        chat("default", visible=None, to=["ucli", "ucli", "us", "unobody"]),
        chat("named", visible=False, to=["ucli", "uboss"]),
    )
    got = messaging.notification_payloads(messages, users, perms)
    assert rows(got.filter("audiencia = 'nombrados'"), "message_id", "email_login") == [
        ("default", "cli"), ("named", "boss"),
    ]
    to_all = rows(got.filter("audiencia = 'todos'"), "message_id", "email_login", "excluye_uid", "oculto_a_clientes")
    assert to_all == [("all", None, "us", False), ("empty", None, "us", False), ("hidden", None, "us", True)]
    everyone = ["boss", "cli", "emptyuid", "stranger"]
    for key, who in {"all": everyone, "empty": everyone, "hidden": ["boss", "emptyuid", "stranger"], "named": [], "none": []}.items():
        told = messaging.notification_recipients(key, messages, users, perms)
        assert told.columns == got.columns
        assert rows(told, "email_login") == [(w,) for w in who]
    flags = {r.message_id: r.datos.visibleParaCliente for r in got.collect()}
    assert flags["hidden"] == "false" and flags["default"] == "true"
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    named_only = messaging.notification_payloads(messages, users, perms, empty_means_all=False)
    assert {r.message_id for r in named_only.collect()} == {"default", "named"}


def test_user_updates(make):
    users = make(
        "users",
        dict(email_login="a", firebase_uid=None, fcm_token="old", ultima_sesion=NOW),
        dict(email_login="b", firebase_uid="ub", fcm_token=None, ultima_sesion=NOW),
        dict(email_login="c", firebase_uid="uc", fcm_token="tc", ultima_sesion=NOW),
    )
    later = [NOW + dt.timedelta(hours=h) for h in range(4)]
    changes = make(
        "user_updates",
        dict(email_login="a", fcm_token="t2", momento=later[2]),
        dict(email_login="a", fcm_token="t1", momento=later[1]),
        dict(email_login="a", firebase_uid="ua", momento=later[3]),
        dict(email_login="b", firebase_uid="ub", momento=later[1]),
        dict(email_login="unknown", fcm_token="x", momento=later[1]),
    )
    got = updates.apply_user_updates(users, changes)
    assert rows(got) == [
        ("a", "ua", "t2", later[2]), ("b", "ub", None, NOW), ("c", "uc", "tc", NOW),
    ]
    assert rows(messaging.device_tokens(got), "email_login") == [("a",), ("c",)]
