"""One key holds a third of all rows."""

import datetime as dt

import pytest
from literals import rows
from pyspark.sql import functions as F

from ronda.operators import fulfilment, nesting, shifts

DAY = dt.date(2024, 1, 3)


@pytest.fixture
def small_partitions_are_skewed(spark):
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        # A partition is split by map task, of which few would be left here.
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def grants(spark, viewers):
    """A third of all grants are for the hot site."""
    ids = spark.range(viewers, numPartitions=8)
    site = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500))
    return ids.select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("email_login"),
        F.lit("c").alias("cliente_rol"),
        site.alias("instalacion_rol"),
        F.lit(True).alias("puede_ver"),
    )


def history(spark, facts):
    site = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 500))
    return spark.range(facts, numPartitions=8).select(
        F.lit("S1").alias("semana"),
        site.alias("instalacion_rol"),
        F.lit("c").alias("cliente_rol"),
        F.lit("Z").alias("zona"),
        F.lit("E").alias("empresa"),
        (F.col("id") % 1000).cast("string").alias("rutrol"),
        F.lit(None).cast("string").alias("tvf"),
        F.lit(1).alias("isoweek"),
        F.lit(2024).alias("ano"),
        F.lit(DAY).alias("dia"),
        F.lit(8.0).alias("horas_planificadas"),
        F.lit(8.0).alias("horas_entregadas"),
        F.lit(1).alias("asistencia"),
    )


def test_viewers_of_a_hot_site_are_split(spark, small_partitions_are_skewed):
    who, facts = grants(spark, 90_000), history(spark, 60_000)
    weeks = fulfilment.weekly_fulfilment(facts, who, DAY, 1)
    got = weeks.groupBy("total_registros").agg(F.count(F.lit(1)).alias("n"))
    collected = {r.total_registros: r.n for r in got.collect()}
    assert collected[20_000] == 30_000 and sum(collected.values()) == 90_000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin(skew=true)" in plan.split("== Initial Plan ==")[0]


def test_site_facts_leave_the_scan_combined(spark):
    """However hot a site, each task sends one row of it."""
    facts = history(spark, 60_000)
    grouped = facts.groupBy("cliente_rol", "instalacion_rol", *fulfilment.WEEK).count()
    text = grouped._jdf.queryExecution().executedPlan().toString()
    assert text.index("Exchange") < text.index("partial_count")


@pytest.mark.parametrize("page_rows", [8, 4096])
def test_pages_of_a_hot_site(spark, page_rows):
    flat = spark.range(3000, numPartitions=8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 100)).alias("sitio"),
        (F.col("id") % 7).alias("turno"),
        F.col("id").alias("fila"),
    )
    nested = nesting.nest_rows(flat, ["sitio"], ["turno"], "filas", page_rows).cache()
    longest = nested.select(F.max(F.size("filas"))).first()[0]
    assert longest <= page_rows
    whole = nested.select("sitio", F.posexplode("filas").alias("n", "f")).select("sitio", "f.turno", "f.fila")
    assert rows(whole) == rows(flat)
    in_order = {}
    for page in nested.orderBy("sitio", "pagina").collect():
        in_order.setdefault(page.sitio, []).extend((f.turno, f.fila) for f in page.filas)
    assert all(found == sorted(found) for found in in_order.values())
    if page_rows == 4096:
        assert nested.count() == len(in_order)
    nested.unpersist()


def test_pages_do_not_depend_on_partitions(spark):
    found = []
    for partitions in (4, 9):
        flat = spark.range(2000, numPartitions=partitions).select(
            F.lit("s").alias("sitio"),
            F.when(F.col("id") % 5 > 0, F.col("id") % 5).alias("turno"),
            F.col("id").alias("fila"),
        )
        nested = nesting.nest_rows(flat.repartition(partitions, "fila"), ["sitio"], ["turno"], "filas", 64)
        assert "rangepartitioning" not in nested._jdf.queryExecution().executedPlan().toString()
        found.append({r.pagina: [(f.turno, f.fila) for f in r.filas] for r in nested.collect()})
    assert found[0] == found[1]
    assert sorted(found[0]) == list(range(-(-2000 // 64)))
    assert all(len(found[0][k]) == 64 for k in range(2000 // 64))


def test_repeated_grants_repeat_nested_shifts(spark, make):
    start = dt.datetime(2024, 1, 1, 8)
    data = make("shifts", *[dict(instalacion_rol="s", cliente_rol="c", turno="A", her=start, rutrol=str(i)) for i in range(3)])
    grant = dict(email_login="a", cliente_rol="c", instalacion_rol="s", puede_ver=True)
    page = shifts.shift_pages(data, make("grants", grant, grant)).first()
    assert [t.rut_planificado for t in page.turnos] == ["0", "0", "1", "1", "2", "2"]
