import datetime as dt

from literals import grant, person, rows

from ronda.operators import coverage, fulfilment, open_posts, scope, shifts
from ronda.plans.ordering import in_report_order

T0 = dt.datetime(2024, 1, 1, 9, 0)


def line(site, required, present, client="c", company="E", service=None, at=T0):
    return dict(
        instalacion_rol=site,
        zona="Z",
        cliente_rol=client,
        empresa=company,
        tipo_de_servicio=service,
        total_guardias_requeridos=required,
        guardias_presentes=present,
        turnos_cubiertos=present,
        turnos_descubiertos=required - present,
        ultima_actualizacion=at,
    )


def post(site, hour, turno="D", minute=0, day=1):
    start = dt.datetime(2024, 1, day, hour, minute)
    return dict(
        instalacion_rol=site, turno=turno, jornada="J", her=start, hsr=start + dt.timedelta(hours=8)
    )


def test_repeated_grant_counts_twice(make):
    grants = make("grants", grant("a", "s"), grant("a", "s"), grant("b", "s"))
    sites = coverage.coverage_by_site(
        make("rollup", line("s", 10, 9)), grants, make("devices"), make("open_posts")
    )
    got = rows(sites, "email_login", "total_guardias_requeridos", "porcentaje_cobertura")
    assert got == [("a", 20, 90.0), ("b", 10, 90.0)]


def test_only_true_grants_show_a_site(make):
    grants = make("grants", grant("a", "s"), grant("b", "s", sees=False), grant("d", "s", sees=None))
    sites = coverage.coverage_by_site(
        make("rollup", line("s", 1, 1)), grants, make("devices"), make("open_posts")
    )
    assert rows(sites, "email_login") == [("a",)]


def test_devices_multiply_rows_and_equal_ones_sum(make):
    devices = make(
        "devices",
        dict(nombre="s", numero="1"),
        dict(nombre="s", numero=""),
        dict(nombre="s", numero=""),
        dict(nombre=None, numero="9"),
    )
    args = make("rollup", line("s", 2, 1)), make("grants", grant("a", "s")), devices
    sites = coverage.coverage_by_site(*args, make("open_posts", post("s", 8)))
    shown = rows(sites, "faceid_numero", "tiene_faceid", "total_guardias_requeridos", "ppc")
    assert shown == [("1", True, 2, 1), (None, True, 4, 1)]
    fast = coverage.coverage_by_site_fast(*args, make("open_posts"))
    assert rows(fast, "faceid_numero", "ppc") == [("", 0), ("1", 0)]
    assert "turnos_cubiertos" not in fast.columns
    service = coverage.coverage_by_site_service(*args, make("open_posts"))
    assert rows(service, "faceid_numero") == [("",), ("",), ("1",)]


def test_zero_required_is_red_per_site_and_grey_overall(make):
    rollup, grants = make("rollup", line("s", 0, 0)), make("grants", grant("a", "s"))
    posts = make("open_posts", post("s", 8))
    site = coverage.coverage_by_site(rollup, grants, make("devices"), posts)
    assert rows(site, "estado_semaforo", "porcentaje_cobertura") == [("ROJO", 0.0)]
    overall = coverage.coverage_overall(rollup, grants, posts)
    assert rows(overall) == [("a", 0, 0, 0, 0.0, "GRIS", None, None, 0, [])]


def test_overall_for_someone_without_sites(make):
    rollup, grants = make("rollup", line("s", 4, 4)), make("grants", grant("a", "s"))
    overall = coverage.coverage_overall(rollup, grants, make("open_posts"), principals=["a", "z"])
    shown = rows(overall, "email_login", "estado_semaforo", "total_turnos_activos")
    assert shown == [("a", "VERDE", 4), ("z", "GRIS", 0)]


def test_overall_counts_posts_of_sites_without_coverage(make):
    rollup = make("rollup", line("s", 4, 3, company="F"), line("s", 4, 4, company=None))
    grants = make("grants", grant("a", "s"), grant("a", "other"))
    posts = make("open_posts", post("s", 8), post("other", 8), post("hidden", 8))
    shown = coverage.coverage_overall(rollup, grants, posts).first()
    assert (shown.total_ppc, shown.empresas) == (2, ["F"])
    assert shown.porcentaje_cobertura_general == 87.5
    assert shown.proxima_actualizacion - shown.ultima_actualizacion == dt.timedelta(minutes=5)


def test_service_rows_and_blank_service(make):
    rollup = make(
        "rollup", line("s", 2, 1), line("s", 2, 1, service=""), line("s", 3, 3, service="X")
    )
    got = coverage.coverage_by_site_service(
        rollup, make("grants", grant("a", "s")), make("devices"), make("open_posts")
    )
    assert rows(got, "tipo_de_servicio") == [("1 Servicio",), ("1 Servicio",), ("X",)]


def test_report_order(make):
    rollup = make("rollup", line("s2", 9, 5), line("s1", 8, 4), line("s3", 9, 9), line("s4", 4, 0))
    grants = make("grants", *[grant("a", f"s{i}") for i in range(1, 5)])
    sites = coverage.coverage_by_site(rollup, grants, make("devices"), make("open_posts"))
    ordered = in_report_order(sites, "coverage_by_site").collect()
    assert [r.instalacion_rol for r in ordered] == ["s4", "s1", "s2", "s3"]


def test_rollup_of_shifts(make):
    def shift(came, service=None):
        return dict(
            instalacion_rol="s", cliente_rol="c", empresa="E", tipo_de_servicio=service, asistencia=came
        )

    rollup = coverage.coverage_rollup(
        make("shifts", shift(1), shift(0), shift(None), shift(1, "X")), T0
    )
    shown = rows(
        rollup, "tipo_de_servicio", "total_guardias_requeridos", "guardias_presentes", "turnos_descubiertos"
    )
    assert shown == [("X", 1, 1, 0), (None, 3, 1, 2)]


def test_same_label_stays_two_slots(make):
    posts = make("open_posts", post("s", 8, day=1), post("s", 8, day=2), post("s", 8, day=2))
    slots = open_posts.open_posts_by_slot(posts, make("grants", grant("a", "s")))
    assert rows(slots, "horario", "cantidad_ppc") == [("08:00 - 16:00", 1), ("08:00 - 16:00", 2)]
    total = open_posts.open_posts_by_site(slots)
    assert rows(total) == [("a", "s", 3, 2)]


def test_posts_match_by_site_alone(make):
    grants = make("grants", grant("a", "s", "c1"), grant("a", "s", "c2"), grant("b", "t"))
    posts = make("open_posts", post("s", 8), post("s", 9))
    assert rows(open_posts.open_posts_total(posts, grants)) == [("a", 4), ("b", 0)]
    nested = open_posts.open_posts_nested(posts, grants).first()
    assert [(s.hora_entrada, s.cantidad_ppc) for s in nested.ppc_por_turno] == [
        ("08:00", 2),
        ("09:00", 2),
    ]
    one = open_posts.open_posts_by_slot(posts, grants, site="t")
    assert one.count() == 0


def shift(site, turno, hour, company="E", client="c", **more):
    start = dt.datetime(2024, 1, 1, hour)
    return dict(
        instalacion_rol=site, cliente_rol=client, turno=turno, her=start, empresa=company, **more
    )


def test_company_of_first_shift(make):
    data = make("shifts", shift("s", "B", 7, "X"), shift("s", "A", 9, None), shift("s", "A", 10, "Y"))
    grants = make("grants", grant("a", "s"), grant("a", "t"))
    posts = make("open_posts", post("t", 8), post("t", 9))
    sites = shifts.shift_sites(data, posts, grants)
    assert rows(sites) == [("a", "s", None, 3, 0), ("a", "t", None, 0, 2)]
    assert rows(shifts.site_shift_totals(data, grants)) == [("a", "s", "Y", 3)]


def test_detail_ignores_client_and_single_site_does_not(make):
    data = make("shifts", shift("s", "A", 9, relevo="R | \tAna "))
    grants = make("grants", grant("a", "s", "c"), grant("a", "s", "other"))
    all_sites = shifts.shift_detail(data, grants)
    assert rows(all_sites, "nombre_asistente", "tipo_de_servicio", "asistio") == [
        ("Ana", "1 Servicio", False)
    ] * 2
    one = shifts.site_shift_detail(data, grants, site="s")
    assert rows(one, "relevo") == [("R | \tAna ",)]
    assert shifts.shift_pages(data, grants).selectExpr("size(turnos) AS n").first().n == 2


def day(site, client, guard, on, hours=10.0, given=5.0, came=1, tvf=None, zone="Z"):
    return dict(
        semana="S1", isoweek=1, ano=2024, instalacion_rol=site, cliente_rol=client, zona=zone,
        empresa="E", rutrol=guard, dia=on, horas_planificadas=hours, horas_entregadas=given,
        asistencia=came, tvf=tvf,
    )


def test_namesake_sites_share_guards_and_count_once(make):
    d = dt.date(2024, 1, 3)
    history = make(
        "history",
        day("s", "c1", "g1", d),
        day("s", "c1", "g2", d, tvf="TE"),
        day("s", "c2", "g2", d, tvf=""),
        day("s", "c2", "g3", d, came=0),
        day("s", "c2", None, d),
        day("t", "c1", "g1", d),
        day("t", "c1", "g1", d - dt.timedelta(days=40)),
    )
    grants = make(
        "grants", grant("a", "s", "c1"), grant("a", "s", "c2"), grant("a", "t", "c1"),
        grant("a", "t", "c1"), grant("b", "s", "c2"),
    )
    weeks = fulfilment.site_week_fulfilment(history, grants, dt.date(2024, 1, 5), 30)
    shown = rows(
        weeks, "email_login", "instalacion_rol", "guardias_planificados", "horas_presupuestadas",
        "asistencias_registradas", "cantidad_turnos_extra", "periodo",
    )
    assert shown == [
        ("a", "s", 3, 50.0, 4, 1, "03/01 - 03/01"),
        ("a", "t", 1, 20.0, 2, 0, "03/01 - 03/01"),
        ("b", "s", 2, 30.0, 2, 0, "03/01 - 03/01"),
    ]
    total = fulfilment.weekly_fulfilment(history, grants, dt.date(2024, 1, 5), 30)
    shown = rows(total, "email_login", "num_instalaciones", "total_registros", "total_ausencias")
    assert shown == [("a", 2, 7, 1), ("b", 1, 3, 1)]


def test_no_hours_planned(make):
    history = make("history", day("s", "c", "g", dt.date(2024, 1, 3), 0.0, None))
    week = fulfilment.weekly_fulfilment(
        history, make("grants", grant("a", "s")), dt.date(2024, 1, 3)
    ).first()
    assert (week.porcentaje_cumplimiento, week.horas_entregadas, week.estado_semaforo) == (0.0, 0.0, "ROJO")


def test_permissions(make):
    perms = make(
        "perms",
        person("a", puede_ver_cobertura=True),
        person("b", puede_ver_cobertura=None),
        person("c", puede_ver_cobertura=True, active=False),
        person("d", puede_ver_cobertura=False, es_admin=True),
    )
    assert rows(scope.permitted(perms, "puede_ver_cobertura")) == [("a",)]
    assert rows(scope.permitted(perms)) == [("a",), ("b",), ("d",)]
    assert rows(scope.permission_profile(perms), "email_login") == [("a",), ("b",), ("d",)]
