"""SQL for checking the registered queries with another engine.

Each text works from the base tables and joins single facts to grants, where
the Spark operators first bring facts down to site grain; so the two agree
only if that is right.
"""

from __future__ import annotations

SITES = "(SELECT count(*) FROM supplier)"
CLIENT = """CASE WHEN s_suppkey % 5 = 0 AND l_linenumber % 2 = 0 THEN 'X' || s_nationkey
            ELSE s_nationkey::VARCHAR END"""

# Stand-in tables as common table expressions, and what each is built on.
TABLES: dict[str, tuple[tuple[str, ...], str]] = {
    "sites": (
        (),
        """SELECT s_suppkey, s_nationkey, n_name, r_name FROM supplier
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""",
    ),
    "urgent": (
        (),
        """SELECT o_orderkey, o_custkey, s_suppkey, o_custkey::VARCHAR AS email_login,
          s_nationkey::VARCHAR AS cliente, s_suppkey::VARCHAR AS instalacion_rol,
          CASE WHEN s_acctbal > 1000 THEN TRUE WHEN s_acctbal > 0 THEN NULL ELSE FALSE END AS ve
        FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey
        WHERE o_orderpriority = '1-URGENT' AND l_linenumber = 1""",
    ),
    "grants": (
        ("urgent",),
        """SELECT email_login, cliente AS cliente_rol, instalacion_rol, ve AS puede_ver FROM urgent
        UNION ALL SELECT email_login, 'X' || cliente, instalacion_rol, ve FROM urgent
          WHERE s_suppkey % 5 = 0 AND o_custkey % 2 = 0
        UNION ALL SELECT email_login, cliente, instalacion_rol, TRUE FROM urgent WHERE o_orderkey % 7 = 0""",
    ),
    "visible": (("grants",), "SELECT * FROM grants WHERE puede_ver"),
    "perms": (
        (),
        """SELECT c_custkey::VARCHAR AS email_login,
          CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ''
               ELSE 'u' || c_custkey END AS firebase_uid,
          c_name AS nombre_completo, c_nationkey::VARCHAR AS cliente_rol,
          CASE WHEN c_mktsegment IN ('HOUSEHOLD', 'MACHINERY') THEN 'CLIENTE'
               WHEN c_mktsegment = 'BUILDING' THEN 'ADMIN' ELSE 'JEFE' END AS rol_id,
          c_mktsegment AS nombre_rol,
          CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment <> 'AUTOMOBILE' END AS puede_ver_cobertura,
          c_acctbal > 2000 AS puede_ver_encuestas,
          c_mktsegment IN ('BUILDING', 'FURNITURE', 'HOUSEHOLD') AS puede_enviar_mensajes,
          c_mktsegment = 'BUILDING' AS puede_ver_empresas,
          c_acctbal > 5000 AS puede_ver_metricas_globales,
          c_mktsegment <> 'HOUSEHOLD' AS puede_ver_trabajadores,
          CASE WHEN c_acctbal >= 0 THEN TRUE END AS puede_ver_mensajes_recibidos,
          c_mktsegment = 'BUILDING' AS es_admin,
          c_mktsegment = 'BUILDING' AND c_acctbal > 5000 AS ver_todas_instalaciones,
          c_acctbal > -500 AS usuario_activo
        FROM customer""",
    ),
    "active": (("perms",), "SELECT * FROM perms WHERE usuario_activo"),
    "may_see": (("active",), "SELECT email_login FROM active WHERE puede_ver_cobertura"),
    "users": (
        (),
        """SELECT c_custkey::VARCHAR AS email_login,
          CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN ''
               ELSE 'u' || c_custkey END AS firebase_uid,
          CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN ''
               ELSE 't' || c_custkey END AS fcm_token,
          TIMESTAMP '2023-12-01 00:00:00' AS ultima_sesion
        FROM customer""",
    ),
    "rollup": (
        ("sites",),
        f"""SELECT s_suppkey::VARCHAR AS instalacion_rol, n_name AS zona,
          {CLIENT} AS cliente_rol, r_name AS empresa,
          nullif(l_returnflag, 'A') AS tipo_de_servicio,
          count(*) AS requeridos,
          count(*) FILTER (l_discount < 0.075 + 0.01 * (l_suppkey % 4)) AS presentes,
          max(l_shipdate) AS refrescado
        FROM lineitem JOIN sites ON s_suppkey = l_suppkey
        GROUP BY ALL""",
    ),
    "devices": (
        (),
        """SELECT s_suppkey::VARCHAR AS nombre,
          unnest(list_filter([
            CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'D' || s_suppkey END,
            CASE WHEN s_suppkey % 4 = 0 THEN 'E' || s_suppkey END,
            CASE WHEN s_suppkey % 7 = 0 THEN CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'D' || s_suppkey END END
          ], lambda n: n IS NOT NULL)) AS numero,
          (SELECT max(l_shipdate) FROM lineitem WHERE l_suppkey = s_suppkey) AS ult_conexion
        FROM supplier WHERE s_acctbal > 3000""",
    ),
    "open_posts": (
        (),
        """SELECT l_suppkey::VARCHAR AS instalacion_rol, l_returnflag AS turno,
          (l_linenumber % 2)::VARCHAR AS jornada,
          TIMESTAMP '2024-01-01 00:00:00' + to_hours(3 * l_linenumber) AS her,
          TIMESTAMP '2024-01-01 08:00:00' + to_hours(3 * l_linenumber) AS hsr
        FROM lineitem WHERE l_linestatus = 'O'""",
    ),
    "posts_per_site": (
        ("open_posts",),
        "SELECT instalacion_rol, count(*) AS ppc FROM open_posts GROUP BY 1",
    ),
    "history": (
        ("sites",),
        f"""SELECT 'S' || extract(week FROM l_shipdate) AS semana,
          extract(week FROM l_shipdate)::INTEGER AS isoweek,
          extract(isoyear FROM l_shipdate)::INTEGER AS ano,
          s_suppkey::VARCHAR AS instalacion_rol, {CLIENT} AS cliente_rol,
          n_name AS zona, r_name AS empresa, l_partkey::VARCHAR AS rutrol,
          CASE l_returnflag WHEN 'N' THEN '' WHEN 'R' THEN 'TE' END AS tvf,
          l_shipdate::DATE AS dia, l_quantity AS planificadas,
          l_quantity - round(l_discount * 100) % 3 AS entregadas,
          (l_discount < 0.075 + 0.01 * (l_suppkey % 4))::INTEGER AS asistencia
        FROM lineitem JOIN sites ON s_suppkey = l_suppkey
        WHERE l_shipdate::DATE BETWEEN DATE '1998-06-30' - 90 AND DATE '1998-06-30'""",
    ),
    "shifts": (
        ("sites",),
        """SELECT s_suppkey::VARCHAR AS instalacion_rol, s_nationkey::VARCHAR AS cliente_rol,
          n_name AS zona, nullif(event_type, 'view') AS empresa,
          'T' || (hour(ts) % 3) AS turno, event_type AS cargo, 'G' || (event_id % 50) AS rutrol,
          'R | ' || event_type || ' | ' || chr(9) || 'P' || event_id || ' ' AS relevo,
          event_id, event_type <> 'error' AS vino,
          CASE WHEN value < 2 THEN NULL WHEN value < 3 THEN '' ELSE event_type END AS tipo,
          CASE WHEN value < 5 THEN NULL WHEN value < 10 THEN '' ELSE 'S' END AS tipo_de_servicio,
          date_trunc('hour', ts) + INTERVAL 450 SECOND AS her,
          CASE WHEN event_type <> 'error' THEN ts END AS entrada,
          CASE WHEN value >= 1 THEN (event_type <> 'error')::INTEGER END AS asistencia
        FROM events JOIN sites ON s_suppkey = user_id""",
    ),
    "shown_shifts": (
        ("shifts",),
        """SELECT *, turno AS codigo_turno, strftime(her, '%H:%M') AS hora_entrada_planificada,
          CASE WHEN vino THEN rutrol END AS rut_asistente,
          'P' || event_id AS nombre_asistente,
          coalesce(asistencia, 0) <> 0 AS asistio,
          CASE WHEN tipo_de_servicio <> '' THEN tipo_de_servicio
               WHEN tipo <> '' THEN tipo ELSE '1 Servicio' END AS servicio,
          CASE WHEN asistencia = 1 AND entrada > her
               THEN 'Retraso: ' || date_diff('minute', her, entrada) || ' minutos'
               WHEN asistencia = 1 THEN 'A tiempo' END AS puntualidad
        FROM shifts""",
    ),
    "single_requests": (
        (),
        f"""SELECT o_orderkey::VARCHAR AS encuesta_id,
          strftime(date_trunc('month', o_orderdate) - to_months((month(o_orderdate) % 2)::INTEGER),
                   '%Y%m') AS periodo,
          s_nationkey::VARCHAR AS cliente_rol, s_suppkey::VARCHAR AS instalacion_rol,
          CASE WHEN o_orderkey % 2 = 0 THEN 'compartida' ELSE 'individual' END AS modo,
          o_custkey::VARCHAR AS email_destinatario,
          CASE WHEN o_orderstatus = 'F' THEN 'completada' ELSE 'pendiente' END AS estado,
          CASE WHEN o_orderstatus = 'F' THEN
            (CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey + 1 END)::VARCHAR
          END AS respondido_por_email,
          'N' || respondido_por_email AS respondido_por_nombre,
          CASE WHEN o_orderkey % 4 = 1 THEN 'E' || o_custkey END AS encuestado_nombre,
          CASE WHEN o_orderstatus = 'F' THEN 'cliente' END AS tipo_respuesta,
          o_orderdate AS fecha_creacion, o_orderdate + INTERVAL 60 DAY AS fecha_limite,
          CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 10 DAY END AS fecha_respuesta
        FROM (SELECT *, o_orderkey % {SITES} AS sitio FROM orders) JOIN supplier ON s_suppkey = sitio""",
    ),
    "requests": (
        ("single_requests",),
        """SELECT * FROM single_requests UNION ALL
        SELECT * REPLACE ('pendiente' AS estado, fecha_creacion + INTERVAL 1 DAY AS fecha_creacion,
          NULL AS respondido_por_email, NULL AS respondido_por_nombre, NULL AS tipo_respuesta,
          NULL AS fecha_respuesta)
        FROM single_requests WHERE encuesta_id::BIGINT % 11 = 0""",
    ),
    "one_request": (
        ("requests",),
        """SELECT * FROM requests
        QUALIFY row_number() OVER (PARTITION BY encuesta_id
          ORDER BY estado <> 'completada', fecha_creacion) = 1""",
    ),
    "questions": (
        (),
        """SELECT p_partkey::VARCHAR AS pregunta_id, p_name AS texto_pregunta,
          p_type AS tipo_respuesta, p_brand AS categoria, p_size AS orden,
          p_partkey % 2 = 0 AS requiere_comentario, p_partkey % 3 = 0 AS obligatoria,
          p_size % 4 <> 0 AS activa
        FROM part WHERE p_size >= 5""",
    ),
    "asks": (
        (),
        """SELECT user_id::VARCHAR AS email_login, (event_id * 3)::VARCHAR AS encuesta_id
        FROM events""",
    ),
    "seen_surveys": (
        ("requests", "visible", "active"),
        """SELECT r.*, v.email_login, a.rol_id IN ('ADMIN', 'JEFE') AS personal
        FROM requests r
        JOIN (SELECT DISTINCT email_login, cliente_rol, instalacion_rol FROM visible) v
          ON v.cliente_rol = r.cliente_rol AND v.instalacion_rol = r.instalacion_rol
        JOIN active a ON a.email_login = v.email_login
        WHERE r.periodo IN ('199806', '199804')
          AND (personal OR r.modo = 'compartida'
               OR (r.modo = 'individual' AND lower(r.email_destinatario) = lower(v.email_login)))""",
    ),
    "shown_answers": (
        ("one_request", "questions"),
        """SELECT r.encuesta_id, r.instalacion_rol, r.periodo, r.modo,
          CASE WHEN r.modo = 'individual' THEN r.email_destinatario END AS solo_para,
          q.pregunta_id, q.texto_pregunta, q.tipo_respuesta,
          l_quantity::INTEGER::VARCHAR AS respuesta_valor,
          CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS comentario, q.orden
        FROM lineitem JOIN one_request r ON r.encuesta_id = l_orderkey::VARCHAR
        JOIN questions q ON q.pregunta_id = l_partkey::VARCHAR
        WHERE r.estado = 'completada'""",
    ),
    "answer_rights": (
        ("asks", "one_request", "active"),
        """SELECT s.email_login, s.encuesta_id, r.* EXCLUDE (encuesta_id),
          CASE WHEN r.encuesta_id IS NULL THEN 'no_encontrada'
               WHEN a.rol_id <> 'ADMIN' AND r.modo = 'individual'
                    AND r.email_destinatario <> s.email_login THEN 'sin_acceso'
               WHEN r.estado <> 'completada' THEN 'sin_responder' ELSE 'ok' END AS acceso
        FROM asks s JOIN active a ON a.email_login = s.email_login
        LEFT JOIN one_request r ON r.encuesta_id = s.encuesta_id""",
    ),
    "submitted": (
        (),
        """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
            l_quantity::INTEGER) AS submission_id,
          CASE WHEN l_quantity = 1 THEN 'X' || l_orderkey ELSE l_orderkey::VARCHAR END AS encuesta_id,
          CASE WHEN l_linenumber <= 5 THEN o_custkey ELSE l_suppkey END::VARCHAR AS email,
          CASE l_returnflag WHEN 'R' THEN 'P' || l_partkey END AS nombre,
          CASE l_returnflag WHEN 'A' THEN NULL WHEN 'N' THEN '' ELSE 'P' || l_partkey END AS dado,
          o_orderdate + to_days(9 * l_linenumber) AS arrival,
          l_partkey::VARCHAR AS pregunta, l_quantity::INTEGER::VARCHAR AS valor,
          l_linestatus AS nota, l_linenumber::VARCHAR AS renglon
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    ),
    # Verdict against the stored state, then again for whatever arrives after
    # the first accepted submission of a pending survey.
    "first_look": (
        ("submitted", "one_request", "active"),
        """SELECT s.*, r.encuesta_id IS NOT NULL AS existe, a.email_login IS NOT NULL AS conocido,
          a.nombre_completo, a.rol_id, r.modo, r.estado, r.email_destinatario, r.fecha_limite,
          r.respondido_por_email, r.encuestado_nombre AS guardado,
          conocido AND existe AND s.arrival <= r.fecha_limite
            AND CASE r.modo WHEN 'compartida' THEN r.estado <> 'completada' AND s.nombre IS NOT NULL
                ELSE r.email_destinatario = s.email
                  AND NOT (r.estado = 'completada' AND r.respondido_por_email = s.email) END AS vale
        FROM submitted s LEFT JOIN one_request r ON r.encuesta_id = s.encuesta_id
        LEFT JOIN active a ON a.email_login = s.email""",
    ),
    "decided": (
        ("first_look",),
        """SELECT *,
          count(*) FILTER (vale AND estado = 'pendiente') OVER (
            PARTITION BY encuesta_id ORDER BY arrival, submission_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS tarde,
          coalesce(vale AND estado = 'pendiente' AND NOT tarde, FALSE) AS cierra,
          CASE WHEN NOT conocido THEN 'usuario_desconocido'
               WHEN NOT existe THEN 'encuesta_desconocida'
               WHEN modo = 'individual' AND email_destinatario <> email THEN 'no_destinatario'
               WHEN modo = 'compartida' AND (estado = 'completada' OR tarde) THEN 'ya_respondida'
               WHEN modo = 'compartida' AND nombre IS NULL THEN 'falta_encuestado'
               WHEN arrival > fecha_limite THEN 'vencida'
               WHEN tarde OR (estado = 'completada' AND respondido_por_email = email)
                 THEN 'ya_respondida_por_usuario'
               ELSE 'aceptada' END AS resultado
        FROM first_look""",
    ),
    "user_contacts": (
        (),
        f"""SELECT o_custkey::VARCHAR AS email_login, ((o_orderkey // 7) % 50)::VARCHAR AS contacto_id,
          (o_orderkey % {SITES})::VARCHAR AS instalacion_rol,
          bool_or(o_orderstatus <> 'P') AS puede_contactar
        FROM orders GROUP BY 1, 2, 3""",
    ),
    "site_contacts": (
        ("user_contacts",),
        """SELECT DISTINCT contacto_id, instalacion_rol, s_nationkey::VARCHAR AS cliente_rol
        FROM user_contacts JOIN supplier ON s_suppkey::VARCHAR = instalacion_rol
        JOIN customer ON c_custkey::VARCHAR = contacto_id
        WHERE c_mktsegment <> 'MACHINERY'""",
    ),
    "contacts": (
        (),
        """SELECT c_custkey::VARCHAR AS contacto_id, c_name AS nombre_contacto,
          '+56' || c_custkey AS telefono, c_mktsegment AS cargo,
          'c' || c_custkey || '@example.org' AS email,
          CASE WHEN c_acctbal > 0 THEN c_custkey::VARCHAR END AS email_usuario_app,
          c_custkey % 4 <> 0 AS activo, c_custkey % 3 <> 0 AS es_usuario_app
        FROM customer""",
    ),
    "reachable": (
        ("active",),
        """SELECT email_login, firebase_uid, nombre_completo, rol_id, cliente_rol
        FROM active WHERE firebase_uid <> ''""",
    ),
    "app_contacts": (
        ("site_contacts", "contacts"),
        """SELECT i.instalacion_rol, c.email_usuario_app AS email_login
        FROM site_contacts i JOIN contacts c USING (contacto_id)
        WHERE c.activo AND c.es_usuario_app""",
    ),
    "participants": (
        ("app_contacts", "active", "grants"),
        """SELECT DISTINCT instalacion_rol, email_login, firebase_uid, nombre_completo, rol_id,
          coalesce(firebase_uid <> '', FALSE) AS con_uid
        FROM (
          SELECT p.instalacion_rol, a.* FROM app_contacts p JOIN active a
            ON a.email_login = p.email_login WHERE a.rol_id <> 'CLIENTE'
          UNION
          SELECT g.instalacion_rol, a.* FROM grants g JOIN active a
            ON a.email_login = g.email_login WHERE a.rol_id = 'CLIENTE'
        )""",
    ),
    "chats": (
        (),
        """SELECT conv_id::VARCHAR AS conversation_id, (conv_id * 1000 + turn)::VARCHAR AS message_id,
          (conv_id % (SELECT count(*) FROM customer))::VARCHAR AS remite, text,
          role <> 'system' AS visible,
          CASE WHEN role <> 'system' THEN
            list_transform(range(conv_id, conv_id + 6), lambda k: 'u' || k) END AS para
        FROM conversations""",
    ),
}


# Tables that a text uses more than once.
MATERIALIZED = {"requests", "one_request", "decided", "answer_rights", "shown_answers"}


def _with(*names: str) -> str:
    """WITH clause for the named tables and all they are built on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = TABLES[name]
        for need in needs:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    kept = lambda n: "AS MATERIALIZED" if n in MATERIALIZED else "AS"
    return "WITH " + ",\n".join(f"{n} {kept(n)} ({TABLES[n][1]})" for n in ordered) + "\n"


def _moment(expression: str, name: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name}"


def _payload(audience: str, email: str, token: str) -> str:
    return f"""m.message_id, {audience} AS audiencia, {email} AS email_login, {token} AS fcm_token,
  'u' || m.remite AS excluye_uid, NOT m.visible AS oculto_a_clientes,
  'Nuevo mensaje de Cliente ' || m.remite AS titulo,
  CASE WHEN length(m.text) > 100 THEN substring(m.text, 1, 100) || '...' ELSE m.text END AS cuerpo,
  m.conversation_id, 'u' || m.remite AS sender_id,
  CASE WHEN m.visible THEN 'true' ELSE 'false' END AS visible_para_cliente"""


_TOLD = """u.fcm_token <> '' AND u.firebase_uid <> 'u' || m.remite
  AND coalesce(p.usuario_activo, TRUE) AND (m.visible OR p.rol_id <> 'CLIENTE')"""


def _band(pct: str) -> str:
    return f"CASE WHEN {pct} >= 95 THEN 'VERDE' WHEN {pct} >= 80 THEN 'AMARILLO' ELSE 'ROJO' END"


FLAGS = (
    "puede_ver_cobertura, puede_ver_encuestas, puede_enviar_mensajes, puede_ver_empresas, "
    "puede_ver_metricas_globales, puede_ver_trabajadores, puede_ver_mensajes_recibidos, es_admin"
)

_VISIBLE_ROLLUP = "FROM rollup c JOIN visible v USING (cliente_rol, instalacion_rol)"
_LOOKUPS = """LEFT JOIN devices d ON d.nombre = instalacion_rol
LEFT JOIN posts_per_site p USING (instalacion_rol)"""


def _by_site(scale: int, counts: bool, number: str) -> str:
    covered = (
        "sum(presentes)::BIGINT AS turnos_cubiertos, "
        "sum(requeridos - presentes)::BIGINT AS turnos_descubiertos,"
        if counts
        else ""
    )
    return (
        _with("rollup", "visible", "devices", "posts_per_site")
        + f"""SELECT v.email_login, instalacion_rol, c.zona, cliente_rol, c.empresa,
  sum(requeridos)::BIGINT AS total_guardias_requeridos,
  sum(presentes)::BIGINT AS guardias_presentes,
  (sum(requeridos) - sum(presentes))::BIGINT AS guardias_ausentes,
  {covered}
  coalesce(round(sum(presentes) / nullif(sum(requeridos), 0) * 100, {scale}), 0.0)
    AS porcentaje_cobertura,
  {_band("porcentaje_cobertura")} AS estado_semaforo,
  coalesce(p.ppc, 0) AS ppc, d.nombre IS NOT NULL AS tiene_faceid,
  {number} AS faceid_numero, {_moment("d.ult_conexion", "faceid_ultima_conexion")}
{_VISIBLE_ROLLUP} {_LOOKUPS}
GROUP BY v.email_login, instalacion_rol, c.zona, cliente_rol, c.empresa, p.ppc, d.nombre,
  d.numero, d.ult_conexion"""
    )


def _hours(rows: str) -> str:
    return f"""round(sum(planificadas), 2) AS horas_presupuestadas,
  round(sum(entregadas), 2) AS horas_entregadas,
  round(sum(planificadas) - sum(entregadas), 2) AS horas_faltantes,
  coalesce(round(sum(entregadas) / nullif(sum(planificadas), 0) * 100, 2), 0.0)
    AS porcentaje_cumplimiento,
  {_band("porcentaje_cumplimiento")} AS estado_semaforo, {rows}"""


_RANGE = "strftime(min(dia), '%d/%m') || ' - ' || strftime(max(dia), '%d/%m') AS periodo"
_SLOT = "strftime(her, '%H:%M') AS hora_entrada, strftime(hsr, '%H:%M') AS hora_salida, " + (
    "strftime(her, '%H:%M') || ' - ' || strftime(hsr, '%H:%M') AS horario"
)
_POSTS = "FROM open_posts JOIN visible USING (instalacion_rol)"

ORACLE: dict[str, str] = {
    "permission_profile": _with("active")
    + f"""SELECT email_login, nombre_completo, cliente_rol, rol_id, nombre_rol, {FLAGS},
  ver_todas_instalaciones FROM active""",
    "permitted_principals": _with("active")
    + "SELECT email_login, 'activo' AS permiso FROM active"
    + "".join(
        f"\nUNION ALL SELECT email_login, '{flag}' FROM active WHERE {flag}"
        for flag in FLAGS.split(", ")
    ),
    "coverage_overall": _with("may_see", "rollup", "visible", "open_posts")
    + f""", live AS (SELECT v.email_login, sum(requeridos)::BIGINT AS r, sum(presentes)::BIGINT AS p,
    max(refrescado) AS u, string_agg(DISTINCT empresa, ',' ORDER BY empresa) AS e
  {_VISIBLE_ROLLUP} GROUP BY 1),
posts AS (SELECT email_login, count(*) AS n {_POSTS} GROUP BY 1)
SELECT email_login, coalesce(r, 0) AS total_turnos_activos, coalesce(p, 0) AS turnos_cubiertos,
  coalesce(r - p, 0) AS turnos_descubiertos,
  coalesce(round(p / nullif(r, 0) * 100, 2), 0.0) AS porcentaje_cobertura_general,
  CASE WHEN coalesce(r, 0) = 0 THEN 'GRIS' ELSE {_band("porcentaje_cobertura_general")} END
    AS estado_semaforo,
  {_moment("u", "ultima_actualizacion")},
  {_moment("u + INTERVAL 5 MINUTE", "proxima_actualizacion")},
  CASE WHEN coalesce(r, 0) = 0 THEN 0 ELSE coalesce(n, 0) END AS total_ppc,
  coalesce(e, '') AS empresas
FROM may_see LEFT JOIN live USING (email_login) LEFT JOIN posts USING (email_login)""",
    "coverage_by_site": _by_site(2, True, "nullif(d.numero, '')"),
    "coverage_by_site_fast": _by_site(1, False, "d.numero"),
    "coverage_by_site_service": _with("rollup", "visible", "devices", "posts_per_site")
    + f"""SELECT v.email_login, instalacion_rol, c.zona, cliente_rol, c.empresa,
  coalesce(nullif(tipo_de_servicio, ''), '1 Servicio') AS tipo_de_servicio,
  requeridos AS total_guardias_requeridos, presentes AS guardias_presentes,
  requeridos - presentes AS guardias_ausentes,
  coalesce(round(presentes / nullif(requeridos, 0) * 100, 1), 0.0) AS porcentaje_cobertura,
  {_band("porcentaje_cobertura")} AS estado_semaforo,
  coalesce(p.ppc, 0) AS ppc, d.nombre IS NOT NULL AS tiene_faceid, d.numero AS faceid_numero,
  {_moment("d.ult_conexion", "faceid_ultima_conexion")}
{_VISIBLE_ROLLUP} {_LOOKUPS}""",
    "coverage_by_site_gated": _with("rollup", "visible", "may_see", "posts_per_site", "devices")
    + f"""SELECT v.email_login, instalacion_rol,
  (sum(requeridos) - sum(presentes))::BIGINT AS guardias_ausentes,
  coalesce(round(sum(presentes) / nullif(sum(requeridos), 0) * 100, 2), 0.0)
    AS porcentaje_cobertura,
  coalesce(max(p.ppc), 0) AS ppc
{_VISIBLE_ROLLUP} JOIN may_see m ON m.email_login = v.email_login
LEFT JOIN posts_per_site p USING (instalacion_rol) LEFT JOIN devices d ON d.nombre = instalacion_rol
GROUP BY v.email_login, instalacion_rol, cliente_rol, c.zona, c.empresa, d.numero, d.ult_conexion""",
    "coverage_by_site_placed": "SELECT *, row_number() OVER (ORDER BY email_login, guardias_ausentes DESC, porcentaje_cobertura, "
    "instalacion_rol, cliente_rol, faceid_numero NULLS FIRST) AS lugar FROM (SELECT email_login, instalacion_rol, "
    "cliente_rol, guardias_ausentes, porcentaje_cobertura, faceid_numero FROM ("
    + _by_site(2, True, "nullif(d.numero, '')")
    + "))",
    "coverage_rollup": _with("shifts")
    + f"""SELECT instalacion_rol, zona, cliente_rol, empresa, tipo_de_servicio,
  count(*) AS total_guardias_requeridos, count(*) FILTER (asistencia = 1) AS guardias_presentes,
  count(*) FILTER (asistencia = 1) AS turnos_cubiertos,
  count(*) - count(*) FILTER (asistencia = 1) AS turnos_descubiertos,
  {_moment("max(entrada)", "ultima_actualizacion")}
FROM shifts GROUP BY instalacion_rol, zona, cliente_rol, empresa, tipo_de_servicio""",
    "shift_lines": _with("shown_shifts")
    + f"""SELECT cliente_rol, instalacion_rol, empresa, turno, {_moment("her", "her")}, codigo_turno,
  cargo, hora_entrada_planificada,
  strftime(shown_shifts.her + INTERVAL 8 HOUR, '%H:%M') AS hora_salida_planificada,
  rutrol AS rut_planificado, rut_asistente, strftime(entrada, '%H:%M') AS hora_entrada_real,
  strftime(entrada + INTERVAL 8 HOUR, '%H:%M') AS hora_salida_real, asistio,
  CASE WHEN vino THEN 'CUBIERTO' ELSE 'DESCUBIERTO' END AS estado_cobertura,
  CASE WHEN cargo = 'purchase' THEN 'TE' END AS turno_extra, tipo,
  CASE WHEN NOT vino THEN 'AUSENTE' END AS motivo_incumplimiento, puntualidad,
  'N' || rutrol AS nombre_planificado, nombre_asistente, servicio AS tipo_de_servicio
FROM shown_shifts""",
    "shift_detail": _with("shown_shifts", "visible")
    + """SELECT v.email_login, instalacion_rol, codigo_turno, hora_entrada_planificada,
  nombre_asistente, asistio, servicio AS tipo_de_servicio, puntualidad
FROM shown_shifts JOIN visible v USING (instalacion_rol)""",
    "shift_pages": _with("shown_shifts", "visible")
    + """, ranked AS (SELECT *, (row_number() OVER (PARTITION BY instalacion_rol
    ORDER BY turno NULLS FIRST, her NULLS FIRST) - 1) // 16 AS pagina FROM shown_shifts)
SELECT v.email_login, instalacion_rol, pagina, count(*) AS total_turnos,
  string_agg(codigo_turno || '@' || hora_entrada_planificada, ',' ORDER BY turno, her) AS inicios
FROM ranked JOIN visible v USING (instalacion_rol) GROUP BY 1, 2, 3""",
    "site_pages": _with("shown_shifts", "open_posts", "visible")
    + """, granted AS (SELECT email_login, instalacion_rol, count(*) AS veces FROM visible GROUP BY 1, 2),
firsts AS (SELECT instalacion_rol, empresa, count(*) OVER (PARTITION BY instalacion_rol) AS t FROM shown_shifts
  QUALIFY row_number() OVER (PARTITION BY instalacion_rol
    ORDER BY turno NULLS FIRST, her NULLS FIRST, empresa NULLS FIRST) = 1),
a AS (SELECT instalacion_rol, (n - 1) // 8 AS pagina, count(*) AS t FROM (SELECT instalacion_rol,
    row_number() OVER (PARTITION BY instalacion_rol ORDER BY turno NULLS FIRST, her NULLS FIRST) AS n FROM shown_shifts)
  GROUP BY 1, 2),
slots AS (SELECT instalacion_rol, turno, jornada, her, hsr, count(*) AS puestos FROM open_posts GROUP BY ALL),
b AS (SELECT *, (row_number() OVER (PARTITION BY instalacion_rol ORDER BY her, hsr, turno, jornada) - 1) // 8 AS pagina
  FROM slots),
posts AS (SELECT instalacion_rol, count(*) AS t FROM open_posts GROUP BY 1),
pages AS (SELECT instalacion_rol, pagina FROM a UNION SELECT instalacion_rol, pagina FROM b)
SELECT g.email_login, p.instalacion_rol, p.pagina, f.empresa, coalesce(f.t, 0) * g.veces AS total_turnos,
  coalesce(o.t, 0) * g.veces AS total_ppc, coalesce(a.t, 0) * g.veces AS turnos_en_pagina,
  coalesce((SELECT string_agg(concat_ws('@', b.turno, b.jornada, strftime(b.her, '%H:%M'), b.puestos * g.veces), ','
    ORDER BY b.her, b.hsr, b.turno, b.jornada) FROM b
    WHERE b.instalacion_rol = p.instalacion_rol AND b.pagina = p.pagina), '') AS horarios
FROM pages p JOIN granted g USING (instalacion_rol) LEFT JOIN a USING (instalacion_rol, pagina)
LEFT JOIN firsts f USING (instalacion_rol) LEFT JOIN posts o USING (instalacion_rol)""",
    "shift_sites": _with("shifts", "open_posts", "visible")
    + """, seen AS (SELECT email_login, instalacion_rol, s.empresa,
    row_number() OVER (PARTITION BY email_login, instalacion_rol
      ORDER BY turno NULLS FIRST, her NULLS FIRST, s.empresa NULLS FIRST) AS n
  FROM shifts s JOIN visible USING (instalacion_rol)),
a AS (SELECT email_login, instalacion_rol, max(CASE WHEN n = 1 THEN empresa END) AS empresa,
    count(*) AS t FROM seen GROUP BY 1, 2),
b AS (SELECT email_login, instalacion_rol, count(*) AS t FROM open_posts
  JOIN visible USING (instalacion_rol) GROUP BY 1, 2)
SELECT email_login, instalacion_rol, a.empresa, coalesce(a.t, 0) AS total_turnos,
  coalesce(b.t, 0) AS total_ppc
FROM a FULL JOIN b USING (email_login, instalacion_rol)""",
    "site_shift_detail": _with("shown_shifts", "visible")
    + """SELECT v.email_login, cliente_rol, instalacion_rol, codigo_turno,
  strftime(entrada + INTERVAL 8 HOUR, '%H:%M') AS hora_salida_real, relevo, rut_asistente,
  puntualidad
FROM shown_shifts JOIN visible v USING (cliente_rol, instalacion_rol)""",
    "site_shift_totals": _with("shifts", "visible")
    + """SELECT email_login, instalacion_rol,
  first(empresa ORDER BY turno, her, empresa) FILTER (empresa IS NOT NULL) AS empresa,
  count(*) AS total_turnos
FROM shifts JOIN visible USING (cliente_rol, instalacion_rol) GROUP BY 1, 2""",
    "weekly_fulfilment": _with("history", "visible")
    + f"""SELECT email_login, semana, isoweek, ano, min(dia)::VARCHAR AS fecha_inicio,
  max(dia)::VARCHAR AS fecha_fin, {_RANGE},
  {_hours('''count(*) AS total_registros, sum(asistencia)::BIGINT AS total_asistencias,
  (count(*) - sum(asistencia))::BIGINT AS total_ausencias,
  count(DISTINCT instalacion_rol) AS num_instalaciones''')}
FROM history JOIN visible USING (cliente_rol, instalacion_rol)
GROUP BY email_login, semana, isoweek, ano""",
    "site_week_fulfilment": _with("history", "visible")
    + f"""SELECT email_login, semana, isoweek, ano, instalacion_rol, zona, empresa, {_RANGE},
  {_hours('''count(DISTINCT rutrol) AS guardias_planificados,
  sum(asistencia)::BIGINT AS asistencias_registradas,
  count(*) FILTER (tvf <> '') AS cantidad_turnos_extra''')}
FROM history JOIN visible USING (cliente_rol, instalacion_rol)
GROUP BY email_login, semana, isoweek, ano, instalacion_rol, zona, empresa""",
    "open_posts_total": _with("may_see", "open_posts", "visible")
    + f"""SELECT m.email_login, count(x.instalacion_rol) AS total_ppc
FROM may_see m LEFT JOIN (SELECT email_login, instalacion_rol {_POSTS}) x
  ON x.email_login = m.email_login GROUP BY 1""",
    "open_posts_by_slot": _with("open_posts", "visible")
    + f"""SELECT email_login, instalacion_rol, turno, {_SLOT}, count(*) AS cantidad_ppc
{_POSTS} GROUP BY email_login, instalacion_rol, turno, her, hsr""",
    "open_posts_by_slot_and_day": _with("open_posts", "visible")
    + f"""SELECT email_login, instalacion_rol, turno, jornada, {_SLOT}, count(*) AS cantidad_ppc
{_POSTS} GROUP BY email_login, instalacion_rol, turno, jornada, her, hsr""",
    "open_posts_by_site": _with("open_posts", "visible")
    + f"""SELECT email_login, instalacion_rol, count(*) AS total_ppc,
  count(DISTINCT (turno, her, hsr)) AS total_horarios {_POSTS} GROUP BY 1, 2""",
    "open_posts_nested": _with("open_posts", "visible")
    + f""", slots AS (SELECT email_login, instalacion_rol, turno, her, hsr, count(*) AS n
  {_POSTS} GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY email_login, instalacion_rol
  ORDER BY her, hsr, turno) - 1 AS n0 FROM slots)
SELECT email_login, instalacion_rol, n0 // 4 AS pagina, (n0 % 4 + 1)::INTEGER AS puesto, turno, strftime(her, '%H:%M') || ' - ' || strftime(hsr, '%H:%M') AS horario,
  n AS cantidad_ppc FROM ranked""",
    "survey_inbox": _with("seen_surveys")
    + f"""SELECT email_login, cliente_rol, instalacion_rol, encuesta_id, periodo, modo, estado,
  email_destinatario, {_moment("fecha_creacion", "fecha_creacion")},
  {_moment("fecha_limite", "fecha_limite")}, respondido_por_email, respondido_por_nombre,
  encuestado_nombre, tipo_respuesta, {_moment("fecha_respuesta", "fecha_respuesta")},
  estado = 'pendiente' AND (modo = 'compartida' OR email_destinatario = email_login)
    AS puede_responder,
  estado = 'completada' AND (personal OR modo = 'compartida' OR email_destinatario = email_login)
    AS puede_ver_respuestas
FROM seen_surveys""",
    "survey_inbox_by_site": _with("seen_surveys")
    + f"""SELECT email_login, instalacion_rol,
  first(cliente_rol ORDER BY modo, fecha_creacion DESC) AS cliente_rol,
  count(*) AS total_encuestas, count(*) FILTER (estado = 'completada') AS respondidas,
  count(*) FILTER (estado = 'pendiente') AS pendientes,
  {_moment("min(fecha_limite) FILTER (estado = 'pendiente')", "fecha_vencimiento_proxima")}
FROM seen_surveys GROUP BY 1, 2""",
    "survey_pages": _with("seen_surveys")
    + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY email_login, instalacion_rol
    ORDER BY modo, fecha_creacion DESC, encuesta_id) - 1 AS n FROM seen_surveys)
SELECT email_login, instalacion_rol, n // 3 AS pagina, (n % 3 + 1)::INTEGER AS puesto, encuesta_id, modo,
  estado, {_moment("fecha_creacion", "fecha_creacion")},
  estado = 'pendiente' AND (modo = 'compartida' OR email_destinatario = email_login)
    AS puede_responder,
  estado = 'completada' AND (personal OR modo = 'compartida' OR email_destinatario = email_login)
    AS puede_ver_respuestas
FROM ranked""",
    "survey_form_headers": _with("asks", "one_request", "grants")
    + f""", form AS (SELECT a.email_login, a.encuesta_id AS pedida, r.*,
    (SELECT bool_or(g.puede_ver) FROM grants g WHERE g.email_login = a.email_login
      AND g.cliente_rol = r.cliente_rol AND g.instalacion_rol = r.instalacion_rol) AS ve
  FROM asks a LEFT JOIN one_request r ON r.encuesta_id = a.encuesta_id)
SELECT email_login, pedida AS encuesta_id,
  CASE WHEN encuesta_id IS NULL THEN 'no_encontrada' WHEN ve THEN 'ok' ELSE 'sin_acceso' END
    AS acceso,
  CASE WHEN ve THEN instalacion_rol END AS instalacion_rol, CASE WHEN ve THEN periodo END AS periodo,
  CASE WHEN ve THEN modo END AS modo, CASE WHEN ve THEN estado END AS estado,
  {_moment("CASE WHEN ve THEN form.fecha_limite END", "fecha_limite")},
  CASE WHEN ve THEN encuestado_nombre END AS encuestado_nombre
FROM form""",
    "survey_form_questions": _with("questions") + "SELECT * EXCLUDE (activa) FROM questions WHERE activa",
    "survey_answers": _with("shown_answers") + "SELECT * FROM shown_answers",
    "survey_answer_access": _with("answer_rights")
    + f"""SELECT email_login, encuesta_id, acceso,
  CASE WHEN acceso = 'ok' THEN periodo END AS periodo,
  CASE WHEN acceso = 'ok' THEN instalacion_rol END AS instalacion_rol,
  CASE WHEN acceso = 'ok' THEN modo END AS modo,
  CASE WHEN acceso = 'ok' THEN respondido_por_nombre END AS respondido_por_nombre,
  CASE WHEN acceso = 'ok' THEN encuestado_nombre END AS encuestado_nombre,
  {_moment("CASE WHEN acceso = 'ok' THEN w.fecha_respuesta END", "fecha_respuesta")}
FROM answer_rights w""",
    "survey_answers_shown": _with("answer_rights", "shown_answers")
    + """SELECT w.email_login, s.* EXCLUDE (solo_para) FROM shown_answers s
JOIN answer_rights w ON w.encuesta_id = s.encuesta_id WHERE w.acceso = 'ok'""",
    "submission_decisions": _with("decided")
    + "SELECT submission_id, encuesta_id, email, resultado, cierra FROM decided",
    "submission_answers": _with("decided")
    + f"""SELECT sha256(submission_id || '|0') AS respuesta_id, encuesta_id, pregunta AS pregunta_id,
  valor AS respuesta_valor, nota AS comentario_adicional, {_moment("arrival", "fecha_respuesta")}
FROM decided WHERE resultado = 'aceptada'
UNION ALL SELECT sha256(submission_id || '|1'), encuesta_id, '0', renglon, NULL,
  {_moment("arrival", "fecha_respuesta")} FROM decided WHERE resultado = 'aceptada'""",
    "submission_rejections": _with("decided")
    + f"""SELECT submission_id, encuesta_id, email, {_moment("d.arrival", "arrival")},
  resultado AS motivo FROM decided d WHERE resultado <> 'aceptada'""",
    "submission_requests": _with("decided", "requests")
    + f"""SELECT r.encuesta_id, r.periodo, r.cliente_rol, r.instalacion_rol, r.modo,
  r.email_destinatario, CASE WHEN d.cierra THEN 'completada' ELSE r.estado END AS estado,
  CASE WHEN d.cierra THEN d.email ELSE r.respondido_por_email END AS respondido_por_email,
  CASE WHEN d.cierra THEN d.nombre_completo ELSE r.respondido_por_nombre END
    AS respondido_por_nombre,
  CASE WHEN d.cierra AND (r.modo = 'compartida' OR d.dado IS NOT NULL) THEN d.nombre
       ELSE r.encuestado_nombre END AS encuestado_nombre,
  CASE WHEN d.cierra THEN (CASE WHEN d.rol_id = 'CLIENTE' THEN 'cliente' ELSE 'org' END)
       ELSE r.tipo_respuesta END AS tipo_respuesta,
  {_moment("r.fecha_creacion", "fecha_creacion")}, {_moment("r.fecha_limite", "fecha_limite")},
  {_moment("CASE WHEN d.cierra THEN d.arrival ELSE r.fecha_respuesta END", "fecha_respuesta")}
FROM requests r LEFT JOIN (SELECT * FROM decided WHERE cierra) d ON d.encuesta_id = r.encuesta_id""",
    "site_contacts": _with("visible", "site_contacts", "contacts")
    + """SELECT v.email_login, i.instalacion_rol, c.contacto_id, c.nombre_contacto AS nombre,
  c.telefono, c.cargo, c.email
FROM visible v JOIN site_contacts i
  ON i.cliente_rol = v.cliente_rol AND i.instalacion_rol = v.instalacion_rol
JOIN contacts c ON c.contacto_id = i.contacto_id WHERE c.activo""",
    "assigned_circles": _with("user_contacts", "site_contacts", "reachable")
    + """SELECT u.contacto_id, u.instalacion_rol, r.*
FROM user_contacts u JOIN reachable r ON r.email_login = u.email_login
WHERE (u.contacto_id, u.instalacion_rol) IN (SELECT contacto_id, instalacion_rol FROM site_contacts)""",
    "co_assigned_contacts": _with("chats", "user_contacts", "site_contacts", "reachable")
    + """SELECT DISTINCT mine.email_login AS solicitante, r.*
FROM user_contacts mine
JOIN site_contacts i ON i.contacto_id = mine.contacto_id
  AND i.instalacion_rol = mine.instalacion_rol
JOIN user_contacts theirs ON theirs.contacto_id = i.contacto_id
  AND theirs.instalacion_rol = i.instalacion_rol AND theirs.email_login <> mine.email_login
JOIN reachable r ON r.email_login = theirs.email_login
WHERE mine.email_login IN (SELECT remite FROM chats)""",
    "site_participants": _with("participants") + "SELECT * FROM participants",
    "participants_across_sites": _with("participants")
    + "SELECT DISTINCT email_login, firebase_uid, nombre_completo, rol_id, con_uid FROM participants",
    "participant_funnel": _with("site_contacts", "app_contacts", "grants", "reachable")
    + """SELECT s.instalacion_rol,
  (SELECT count(*) FROM site_contacts x WHERE x.instalacion_rol = s.instalacion_rol)
    AS filas_contacto,
  (SELECT count(*) FROM grants x WHERE x.instalacion_rol = s.instalacion_rol) AS filas_permiso,
  (SELECT count(DISTINCT x.email_login) FROM app_contacts x
    WHERE x.instalacion_rol = s.instalacion_rol) AS contactos_app,
  (SELECT count(DISTINCT x.email_login) FROM app_contacts x JOIN reachable r
    ON r.email_login = x.email_login AND r.rol_id <> 'CLIENTE'
    WHERE x.instalacion_rol = s.instalacion_rol) AS personal_valido,
  (SELECT count(DISTINCT x.email_login) FROM grants x JOIN reachable r
    ON r.email_login = x.email_login AND r.rol_id = 'CLIENTE'
    WHERE x.instalacion_rol = s.instalacion_rol) AS clientes_validos
FROM (SELECT instalacion_rol FROM site_contacts UNION SELECT instalacion_rol FROM grants) s""",
    "site_samples": _with("site_contacts", "contacts", "perms")
    + """, linked AS (SELECT *, row_number() OVER (PARTITION BY instalacion_rol ORDER BY contacto_id, cliente_rol) AS n
  FROM site_contacts QUALIFY n <= 5),
users AS (SELECT DISTINCT instalacion_rol, contacto_id, email_usuario_app FROM site_contacts JOIN contacts USING (contacto_id)
  WHERE activo AND es_usuario_app),
sampled AS (SELECT *, row_number() OVER (PARTITION BY instalacion_rol ORDER BY contacto_id, email_usuario_app NULLS FIRST) AS n
  FROM users QUALIFY n <= 10)
SELECT instalacion_rol, 'contacto' AS muestra, n, contacto_id, email_usuario_app, cliente_rol, activo, es_usuario_app,
  NULL AS rol_id, NULL AS firebase_uid, c.contacto_id IS NOT NULL AS existe
FROM linked LEFT JOIN contacts c USING (contacto_id)
UNION ALL SELECT instalacion_rol, 'usuario_app', n, contacto_id, email_usuario_app, NULL, NULL, NULL, NULL, NULL, TRUE FROM sampled
UNION ALL SELECT instalacion_rol, 'permisos', n, contacto_id, email_usuario_app, NULL, usuario_activo, NULL, p.rol_id,
  p.firebase_uid, p.email_login IS NOT NULL
FROM sampled LEFT JOIN perms p ON p.email_login = email_usuario_app WHERE n = 1 AND email_usuario_app <> ''""",
    "fan_out_messages": _with("user_contacts", "contacts")
    + f""", wanted AS (
  SELECT o_orderkey, o_custkey::VARCHAR AS email_usuario, c_nationkey::VARCHAR AS cliente_rol,
    o_orderpriority AS mensaje, pos,
    ((o_orderkey + CASE pos WHEN 1 THEN 1 ELSE 0 END) % {SITES})::VARCHAR AS instalacion_rol
  FROM orders JOIN customer ON c_custkey = o_custkey, range(3) t(pos))
SELECT sha256(concat_ws('|', o_orderkey, pos, c.contacto_id, c.telefono, c.nombre_contacto))
    AS mensaje_id,
  w.email_usuario, w.cliente_rol, w.instalacion_rol, c.contacto_id, w.mensaje,
  'pendiente' AS estado, '1998-06-30 12:00:00' AS fecha_envio
FROM wanted w JOIN user_contacts u ON u.email_login = w.email_usuario
  AND u.instalacion_rol = w.instalacion_rol
JOIN contacts c ON c.contacto_id = u.contacto_id WHERE u.puede_contactar AND c.activo""",
    "inbox": f"""SELECT user_id::VARCHAR AS email_login,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id::VARCHAR DESC)::INTEGER AS puesto,
  event_id::VARCHAR AS mensaje_id, 'r' || event_id AS remitente_email,
  event_type AS remitente_nombre, (event_id % 10)::VARCHAR AS instalacion_rol,
  CASE WHEN value > 5 THEN 'Centro' END AS instalacion_comuna, props AS mensaje,
  CASE WHEN event_type = 'error' THEN 'fallido' ELSE 'enviado' END AS estado,
  {_moment("ts", "fecha_envio")},
  {_moment("CASE WHEN event_type = 'view' THEN ts END", "fecha_lectura")},
  event_type = 'view' AS leido
FROM events QUALIFY puesto <= 10""",
    "notification_payloads": _with("chats", "users", "perms")
    + f"""SELECT {_payload("'nombrados'", "u.email_login", "u.fcm_token")}
FROM chats m JOIN users u ON list_contains(m.para, u.firebase_uid)
LEFT JOIN perms p ON p.email_login = u.email_login
WHERE {_TOLD}
UNION ALL SELECT {_payload("'todos'", "NULL", "NULL")} FROM chats m WHERE m.para IS NULL""",
    "notification_recipients": _with("chats", "users", "perms")
    + f"""SELECT {_payload("'todos'", "u.email_login", "u.fcm_token")}
FROM (SELECT * FROM chats WHERE para IS NULL
      AND message_id = (SELECT min(message_id) FROM chats WHERE para IS NULL)) m, users u
LEFT JOIN perms p ON p.email_login = u.email_login
WHERE u.firebase_uid IS NOT NULL AND {_TOLD}""",
    "user_updates": _with("users")
    + f""", news AS (SELECT user_id::VARCHAR AS email_login,
    arg_max('e' || event_id, ts) FILTER (event_type IN ('click', 'purchase')) AS token,
    max(ts) FILTER (event_type IN ('click', 'purchase')) AS sesion,
    arg_max(CASE event_type WHEN 'signup' THEN 'n' || event_id ELSE 'u' || user_id END, ts)
      FILTER (event_type IN ('signup', 'view')) AS uid
  FROM events GROUP BY 1)
SELECT u.email_login, coalesce(uid, firebase_uid) AS firebase_uid,
  coalesce(token, fcm_token) AS fcm_token,
  {_moment("coalesce(sesion, u.ultima_sesion)", "ultima_sesion")}
FROM users u LEFT JOIN news n ON n.email_login = u.email_login""",
    "device_tokens": _with("users")
    + "SELECT email_login, fcm_token, firebase_uid FROM users WHERE fcm_token <> ''",
}

_ONE = "(SELECT min(email_login) FROM visible)"
_SITE = "(SELECT min(instalacion_rol) FROM visible)"
ORACLE |= {
    "coverage_by_site_of_one": _with("rollup", "visible", "posts_per_site", "devices")
    + f"""SELECT v.email_login, instalacion_rol, cliente_rol, sum(presentes)::BIGINT AS guardias_presentes,
  coalesce(max(p.ppc), 0) AS ppc, max(d.nombre) IS NOT NULL AS tiene_faceid
{_VISIBLE_ROLLUP} LEFT JOIN posts_per_site p USING (instalacion_rol) LEFT JOIN devices d ON d.nombre = instalacion_rol
WHERE v.email_login = {_ONE}
GROUP BY v.email_login, instalacion_rol, cliente_rol, c.zona, c.empresa, d.numero, d.ult_conexion""",
    "weekly_fulfilment_of_one": _with("history", "visible")
    + f"""SELECT email_login, ano, isoweek, count(*) AS total_registros,
  count(DISTINCT instalacion_rol) AS num_instalaciones
FROM history JOIN visible USING (cliente_rol, instalacion_rol)
WHERE email_login = {_ONE} GROUP BY email_login, ano, isoweek""",
    "open_posts_of_one_site": _with("open_posts", "visible")
    + f"""SELECT email_login, instalacion_rol, turno,
  strftime(her, '%H:%M') || ' - ' || strftime(hsr, '%H:%M') AS horario, count(*) AS cantidad_ppc
{_POSTS} WHERE instalacion_rol = {_SITE} GROUP BY email_login, instalacion_rol, turno, her, hsr""",
    "participants_of_two_sites": f"""SELECT * FROM ({_with("participants")}SELECT * FROM participants)
WHERE instalacion_rol IN (SELECT DISTINCT instalacion_rol FROM ({_with("site_contacts")}SELECT * FROM site_contacts)
  ORDER BY 1 LIMIT 2)""",
}

# The same reports from stored parts.
ORACLE["coverage_rollup_refreshed"] = ORACLE["coverage_rollup"]
ORACLE["weekly_fulfilment_of_days"] = ORACLE["weekly_fulfilment"]
ORACLE["site_week_fulfilment_of_days"] = ORACLE["site_week_fulfilment"]
