"""The logical tables, derived from the synthetic star schema.

Principals are customers, clients are nations and sites are suppliers.  Blank
and missing values are put in on purpose: the base tables hold none.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ronda import fixed_values as fv
from ronda.functions.time import survey_period

AS_OF = dt.date(1998, 6, 30)
AS_OF_TIME = dt.datetime(1998, 6, 30, 12, 0, 0)
DAYS = 90
INBOX_ROWS = 10
INBOX_STAFF = ("ADMIN", "JEFE")
ANSWER_STAFF = ("ADMIN",)


def _text(name: str) -> Column:
    return F.col(name).cast("string")


class StandIn:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sites(self) -> DataFrame:
        """Supplier with its nation and region names."""
        return (
            self.base("supplier")
            .join(self.base("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(self.base("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("s_suppkey", "s_nationkey", "n_name", "r_name")
        )

    def _site_count(self) -> int:
        return self.base("supplier").count()

    def grants(self) -> DataFrame:
        """A grant for the first line of every urgent order, so grants grow with
        the orders.  Some sites are granted under their second client too, and
        some grants are repeated with another permission."""
        balance = F.col("s_acctbal")
        can_see = F.when(balance > 1000, True).when(balance > 0, F.lit(None)).otherwise(False)
        urgent = self.base("orders").filter(F.col("o_orderpriority") == "1-URGENT")
        first = self.base("lineitem").filter(F.col("l_linenumber") == 1)
        lines = urgent.join(first, F.col("o_orderkey") == F.col("l_orderkey")).join(
            self.base("supplier"), F.col("l_suppkey") == F.col("s_suppkey")
        )
        client = _text("s_nationkey")
        second = (F.col("s_suppkey") % 5 == 0) & (F.col("o_custkey") % 2 == 0)
        grant = lambda who, sees: F.struct(who.alias("cliente_rol"), sees.alias("puede_ver"))
        granted = F.array(
            grant(client, can_see),
            F.when(second, grant(F.concat(F.lit("X"), client), can_see)),
            F.when(F.col("o_orderkey") % 7 == 0, grant(client, F.lit(True))),
        )
        each = lines.withColumn("g", F.explode(granted)).filter(F.col("g").isNotNull())
        return each.select(
            _text("o_custkey").alias("email_login"),
            F.col("g.cliente_rol").alias("cliente_rol"),
            _text("s_suppkey").alias("instalacion_rol"),
            F.col("g.puede_ver").alias("puede_ver"),
        )

    @staticmethod
    def _client(line: Column) -> Column:
        """Every other line of some sites belongs to a second client."""
        other = (F.col("s_suppkey") % 5 == 0) & (line % 2 == 0)
        return F.when(other, F.concat(F.lit("X"), _text("s_nationkey"))).otherwise(_text("s_nationkey"))

    def perms(self) -> DataFrame:
        key, segment, balance = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
        role = (
            F.when(segment.isin("HOUSEHOLD", "MACHINERY"), fv.ROLE_CLIENT)
            .when(segment == "BUILDING", "ADMIN")
            .otherwise("JEFE")
        )
        coverage = F.when(balance < 0, F.lit(None)).otherwise(segment != "AUTOMOBILE")
        return self.base("customer").select(
            key.cast("string").alias("email_login"),
            self._uid().alias("firebase_uid"),
            F.col("c_name").alias("nombre_completo"),
            _text("c_nationkey").alias("cliente_rol"),
            role.alias("rol_id"),
            segment.alias("nombre_rol"),
            coverage.alias("puede_ver_cobertura"),
            (balance > 2000).alias("puede_ver_encuestas"),
            segment.isin("BUILDING", "FURNITURE", "HOUSEHOLD").alias("puede_enviar_mensajes"),
            (segment == "BUILDING").alias("puede_ver_empresas"),
            (balance > 5000).alias("puede_ver_metricas_globales"),
            (segment != "HOUSEHOLD").alias("puede_ver_trabajadores"),
            F.when(balance >= 0, True).alias("puede_ver_mensajes_recibidos"),
            (segment == "BUILDING").alias("es_admin"),
            ((segment == "BUILDING") & (balance > 5000)).alias("ver_todas_instalaciones"),
            (balance > -500).alias("usuario_activo"),
        )

    @staticmethod
    def _uid() -> Column:
        key = F.col("c_custkey")
        named = F.concat(F.lit("u"), key.cast("string"))
        return F.when(key % 7 == 0, F.lit(None)).when(key % 11 == 0, "").otherwise(named)

    def users(self) -> DataFrame:
        key = F.col("c_custkey")
        token = F.concat(F.lit("t"), key.cast("string"))
        return self.base("customer").select(
            key.cast("string").alias("email_login"),
            self._uid().alias("firebase_uid"),
            F.when(key % 5 == 0, F.lit(None)).when(key % 13 == 0, "").otherwise(token).alias(
                "fcm_token"
            ),
            F.lit(dt.datetime(2023, 12, 1)).cast("timestamp").alias("ultima_sesion"),
        )

    def user_updates(self) -> DataFrame:
        kind, event = F.col("event_type"), _text("event_id")
        new_uid = F.concat(F.lit("n"), event)
        same_uid = F.concat(F.lit("u"), _text("user_id"))
        return self.base("events").select(
            _text("user_id").alias("email_login"),
            F.when(kind == "signup", new_uid)
            .when(kind == "view", same_uid)
            .alias("firebase_uid"),
            F.when(kind.isin("click", "purchase"), F.concat(F.lit("e"), event)).alias("fcm_token"),
            F.col("ts").cast("timestamp").alias("momento"),
        )

    @staticmethod
    def _present() -> Column:
        return F.col("l_discount") < F.lit(0.075) + F.lit(0.01) * (F.col("l_suppkey") % 4)

    def rollup(self) -> DataFrame:
        counted = (
            self.base("lineitem")
            .groupBy(
                "l_suppkey",
                F.when(F.col("l_suppkey") % 5 == 0, F.col("l_linenumber") % 2).otherwise(1).alias("linea"),
                F.nullif("l_returnflag", F.lit("A")).alias("servicio"),
            )
            .agg(
                F.count(F.lit(1)).alias("requeridos"),
                F.count_if(self._present()).alias("presentes"),
                F.max("l_shipdate").cast("timestamp").alias("refrescado"),
            )
        )
        return counted.join(self.sites(), F.col("l_suppkey") == F.col("s_suppkey")).select(
            _text("s_suppkey").alias("instalacion_rol"),
            F.col("n_name").alias("zona"),
            self._client(F.col("linea")).alias("cliente_rol"),
            F.col("r_name").alias("empresa"),
            F.col("servicio").alias("tipo_de_servicio"),
            F.col("requeridos").alias("total_guardias_requeridos"),
            F.col("presentes").alias("guardias_presentes"),
            F.col("presentes").alias("turnos_cubiertos"),
            (F.col("requeridos") - F.col("presentes")).alias("turnos_descubiertos"),
            F.col("refrescado").alias("ultima_actualizacion"),
        )

    def devices(self) -> DataFrame:
        key = F.col("s_suppkey")
        last = self.base("lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("ultimo"))
        number = F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("D"), key.cast("string")))
        # A second device at some sites, and one that looks like the first at others.
        numbers = F.array(
            number,
            F.when(key % 4 == 0, F.concat(F.lit("E"), key.cast("string"))),
            F.when(key % 7 == 0, number),
        )
        return (
            self.base("supplier")
            .filter(F.col("s_acctbal") > 3000)
            .join(last, key == F.col("l_suppkey"), "left")
            .select(
                key.cast("string").alias("nombre"),
                F.explode(numbers).alias("numero"),
                F.col("ultimo").cast("timestamp").alias("ult_conexion"),
            )
            .filter(F.col("numero").isNotNull())
        )

    def open_posts(self) -> DataFrame:
        start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,3*l_linenumber)")
        return (
            self.base("lineitem")
            .filter(F.col("l_linestatus") == "O")
            .select(
                _text("l_suppkey").alias("instalacion_rol"),
                F.col("l_returnflag").alias("turno"),
                (F.col("l_linenumber") % 2).cast("string").alias("jornada"),
                start.alias("her"),
            )
            .withColumn("hsr", F.col("her") + F.expr("INTERVAL 8 HOURS"))
        )

    def history(self) -> DataFrame:
        day = F.to_date("l_shipdate")
        flag = F.col("l_returnflag")
        week = F.weekofyear(day)
        extra = F.when(flag == "N", "").when(flag == "R", "TE")
        return (
            self.base("lineitem")
            .join(self.sites(), F.col("l_suppkey") == F.col("s_suppkey"))
            .select(
                F.concat(F.lit("S"), week.cast("string")).alias("semana"),
                _text("s_suppkey").alias("instalacion_rol"),
                self._client(F.col("l_linenumber")).alias("cliente_rol"),
                F.col("n_name").alias("zona"),
                F.col("r_name").alias("empresa"),
                _text("l_partkey").alias("rutrol"),
                extra.alias("tvf"),
                week.alias("isoweek"),
                F.extract(F.lit("YEAROFWEEK"), day).alias("ano"),
                day.alias("dia"),
                F.col("l_quantity").alias("horas_planificadas"),
                (F.col("l_quantity") - F.round(F.col("l_discount") * 100) % 3).alias("horas_entregadas"),
                self._present().cast("int").alias("asistencia"),
            )
        )

    def shifts(self) -> DataFrame:
        kind, event, value = F.col("event_type"), _text("event_id"), F.col("value")
        came = kind != "error"
        start = F.expr("date_trunc('HOUR', ts) + INTERVAL '7:30' MINUTE TO SECOND").cast(
            "timestamp_ntz"
        )
        guard = F.concat(F.lit("G"), (F.col("event_id") % 50).cast("string"))
        relief = F.concat(F.lit("R | "), kind, F.lit(" | \tP"), event, F.lit(" "))
        service = F.when(value < 5, F.lit(None)).when(value < 10, "").otherwise("S")
        return (
            self.base("events")
            .join(self.sites(), F.col("user_id") == F.col("s_suppkey"))
            .select(
                _text("s_suppkey").alias("instalacion_rol"),
                _text("s_nationkey").alias("cliente_rol"),
                F.col("n_name").alias("zona"),
                F.nullif(kind, F.lit("view")).alias("empresa"),
                F.concat(F.lit("T"), (F.hour("ts") % 3).cast("string")).alias("turno"),
                kind.alias("cargo"),
                guard.alias("rutrol"),
                F.concat(F.lit("N"), guard).alias("nombrerol"),
                F.when(came, guard).alias("rutasi"),
                relief.alias("relevo"),
                F.when(came, "CUBIERTO").otherwise("DESCUBIERTO").alias("COB"),
                F.when(kind == "purchase", "TE").alias("tvf"),
                F.when(value < 2, F.lit(None)).when(value < 3, "").otherwise(kind).alias("tipo"),
                service.alias("tipo_de_servicio"),
                F.when(~came, "AUSENTE").alias("motivoppc"),
                start.alias("her"),
                (start + F.expr("INTERVAL 8 HOURS")).alias("hsr"),
                F.when(came, F.col("ts")).alias("entrada"),
                F.when(came, F.col("ts") + F.expr("INTERVAL 8 HOURS")).alias("salida"),
                F.when(value >= 1, came.cast("int")).alias("asistencia"),
            )
        )

    def survey_requests(self) -> DataFrame:
        key, cust = F.col("o_orderkey"), _text("o_custkey")
        done = F.col("o_orderstatus") == "F"
        created = F.col("o_orderdate").cast("timestamp")
        by = F.when(key % 3 == 0, cust).otherwise((F.col("o_custkey") + 1).cast("string"))
        placed = self.base("orders").withColumn("site", key % self._site_count())
        requests = placed.join(
            self.base("supplier").select("s_suppkey", "s_nationkey"),
            F.col("site") == F.col("s_suppkey"),
        ).select(
            key.cast("string").alias("encuesta_id"),
            survey_period(F.to_date("o_orderdate")).alias("periodo"),
            _text("s_nationkey").alias("cliente_rol"),
            _text("s_suppkey").alias("instalacion_rol"),
            F.when(key % 2 == 0, fv.MODE_SHARED).otherwise(fv.MODE_INDIVIDUAL).alias("modo"),
            cust.alias("email_destinatario"),
            F.when(done, fv.STATE_DONE).otherwise(fv.STATE_PENDING).alias("estado"),
            F.when(done, by).alias("respondido_por_email"),
            F.when(done, F.concat(F.lit("N"), by)).alias("respondido_por_nombre"),
            F.when(key % 4 == 1, F.concat(F.lit("E"), cust)).alias("encuestado_nombre"),
            F.when(done, fv.RESPONDER_CLIENT).alias("tipo_respuesta"),
            created.alias("fecha_creacion"),
            (created + F.expr("INTERVAL 60 DAYS")).alias("fecha_limite"),
            F.when(done, created + F.expr("INTERVAL 10 DAYS")).alias("fecha_respuesta"),
        )
        # Some requests are stored twice, the second time a day later and without an answer.
        answer = ("respondido_por_email", "respondido_por_nombre", "tipo_respuesta", "fecha_respuesta")
        again = requests.filter(F.col("encuesta_id").cast("long") % 11 == 0).withColumns(
            {
                "estado": F.lit(fv.STATE_PENDING),
                "fecha_creacion": F.col("fecha_creacion") + F.expr("INTERVAL 1 DAY"),
                **{c: F.lit(None).cast(requests.schema[c].dataType) for c in answer},
            }
        )
        return requests.unionByName(again)

    def questions(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.base("part").filter(F.col("p_size") >= 5).select(
            key.cast("string").alias("pregunta_id"),
            F.col("p_name").alias("texto_pregunta"),
            F.col("p_type").alias("tipo_respuesta"),
            F.col("p_brand").alias("categoria"),
            F.col("p_size").alias("orden"),
            (key % 2 == 0).alias("requiere_comentario"),
            (key % 3 == 0).alias("obligatoria"),
            (F.col("p_size") % 4 != 0).alias("activa"),
        )

    def answers(self) -> DataFrame:
        done = self.base("orders").filter(F.col("o_orderstatus") == "F")
        return (
            self.base("lineitem")
            .join(done, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("respuesta_id"),
                _text("l_orderkey").alias("encuesta_id"),
                _text("l_partkey").alias("pregunta_id"),
                F.col("l_quantity").cast("int").cast("string").alias("respuesta_valor"),
                F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias(
                    "comentario_adicional"
                ),
                F.col("l_shipdate").cast("timestamp").alias("fecha_respuesta"),
            )
        )

    def submissions(self) -> DataFrame:
        line, flag, part = F.col("l_linenumber"), F.col("l_returnflag"), _text("l_partkey")
        survey = _text("l_orderkey")
        unknown = F.concat(F.lit("X"), survey)
        quantity = F.col("l_quantity").cast("int").cast("string")
        given = F.when(flag == "A", F.lit(None)).when(flag == "N", " \t ").otherwise(
            F.concat(F.lit(" P"), part, F.lit(" "))
        )
        answer = F.struct(
            part.alias("pregunta_id"),
            quantity.alias("respuesta_valor"),
            F.col("l_linestatus").alias("comentario"),
        )
        second = F.struct(
            F.lit("0").alias("pregunta_id"),
            line.cast("string").alias("respuesta_valor"),
            F.lit(None).cast("string").alias("comentario"),
        )
        recipient = F.when(line <= 5, _text("o_custkey")).otherwise(_text("l_suppkey"))
        arrival = F.expr("o_orderdate + make_interval(0, 0, 0, 9 * l_linenumber)")
        return (
            self.base("lineitem")
            .join(self.base("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                F.concat_ws("-", survey, line, part, _text("l_suppkey"), quantity).alias(
                    "submission_id"
                ),
                F.when(F.col("l_quantity") == 1, unknown).otherwise(survey).alias("encuesta_id"),
                recipient.alias("email"),
                given.alias("encuestado_nombre"),
                F.array(answer, second).alias("respuestas"),
                arrival.cast("timestamp").alias("arrival"),
            )
        )

    def survey_asks(self) -> DataFrame:
        """Surveys people opened; about half of the ids are unknown."""
        return self.base("events").select(
            _text("user_id").alias("email_login"),
            (F.col("event_id") * 3).cast("string").alias("encuesta_id"),
        )

    def user_contacts(self) -> DataFrame:
        contact = F.expr("o_orderkey div 7") % 50
        may_write = F.bool_or(F.col("o_orderstatus") != "P")
        return (
            self.base("orders")
            .groupBy(
                _text("o_custkey").alias("email_login"),
                contact.cast("string").alias("contacto_id"),
                (F.col("o_orderkey") % self._site_count()).cast("string").alias("instalacion_rol"),
            )
            .agg(may_write.alias("puede_contactar"))
        )

    def site_contacts(self) -> DataFrame:
        nation = self.base("supplier").select(
            _text("s_suppkey").alias("instalacion_rol"), _text("s_nationkey").alias("cliente_rol")
        )
        return (
            self.user_contacts()
            .join(self.contacts().filter("cargo <> 'MACHINERY'").select("contacto_id"), "contacto_id")
            .join(nation, "instalacion_rol")
            .select("contacto_id", "instalacion_rol", "cliente_rol")
            .distinct()
        )

    def contacts(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.base("customer").select(
            key.cast("string").alias("contacto_id"),
            F.col("c_name").alias("nombre_contacto"),
            F.concat(F.lit("+56"), key.cast("string")).alias("telefono"),
            F.col("c_mktsegment").alias("cargo"),
            F.concat(F.lit("c"), key.cast("string"), F.lit("@example.org")).alias("email"),
            F.when(F.col("c_acctbal") > 0, key.cast("string")).alias("email_usuario_app"),
            (key % 4 != 0).alias("activo"),
            (key % 3 != 0).alias("es_usuario_app"),
        )

    def outbound_requests(self) -> DataFrame:
        """An order asks for its own site, the next one, and its own again."""
        n = self._site_count()
        own = (F.col("o_orderkey") % n).cast("string")
        following = ((F.col("o_orderkey") + 1) % n).cast("string")
        sender = self.base("customer").select("c_custkey", _text("c_nationkey").alias("cliente_rol"))
        return (
            self.base("orders")
            .join(sender, F.col("o_custkey") == F.col("c_custkey"))
            .select(
                _text("o_orderkey").alias("solicitud_id"),
                _text("o_custkey").alias("email_usuario"),
                "cliente_rol",
                F.col("o_orderpriority").alias("mensaje"),
                F.array(own, following, own).alias("instalaciones"),
            )
        )

    def inbox_messages(self) -> DataFrame:
        event, kind = _text("event_id"), F.col("event_type")
        return self.base("events").select(
            event.alias("mensaje_id"),
            F.concat(F.lit("r"), event).alias("remitente_email"),
            kind.alias("remitente_nombre"),
            F.lit("C").alias("remitente_cliente"),
            (F.col("event_id") % 10).cast("string").alias("instalacion_rol"),
            F.concat(F.lit("Calle "), event).alias("instalacion_direccion"),
            F.when(F.col("value") > 5, "Centro").alias("instalacion_comuna"),
            F.col("props").alias("mensaje"),
            F.when(kind == "error", "fallido").otherwise("enviado").alias("estado"),
            _text("user_id").alias("destinatario_email_app"),
            F.col("ts").cast("timestamp").alias("fecha_envio"),
            F.when(kind == "view", F.col("ts").cast("timestamp")).alias("fecha_lectura"),
            (kind == "view").alias("leido"),
        )

    def chat_messages(self) -> DataFrame:
        people = self.base("customer").count()
        conv, role = F.col("conv_id"), F.col("role")
        sender = (conv % people).cast("string")
        to = F.transform(
            F.sequence(conv, conv + 5), lambda k: F.concat(F.lit("u"), k.cast("string"))
        )
        return self.base("conversations").select(
            conv.cast("string").alias("conversation_id"),
            (conv * 1000 + F.col("turn")).cast("string").alias("message_id"),
            F.concat(F.lit("u"), sender).alias("sender_id"),
            F.concat(F.lit("Cliente "), sender).alias("sender_name"),
            F.col("text").alias("message_text"),
            (role != "system").alias("visible_para_cliente"),
            F.when(role != "system", to).alias("participant_user_ids"),
        )
