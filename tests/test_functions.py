import datetime as dt

import pytest
from pyspark.sql import functions as F

from ronda.functions import kpi, text, time
from ronda.settings import Settings


def one(spark, column, **values):
    names = ", ".join(f"{v} AS {k}" for k, v in values.items())
    return spark.sql(f"SELECT {names}").select(column.alias("x")).first().x


@pytest.mark.parametrize("month", range(1, 13))
@pytest.mark.parametrize("year", [1998, 2024])
def test_survey_periods(spark, year, month):
    running = (year, month) if month % 2 == 0 else (year, month - 1)
    if running[1] == 0:
        running = (year - 1, 12)
    before = (running[0], running[1] - 2) if running[1] > 2 else (running[0] - 1, 12)
    expected = tuple(f"{y:04d}{m:02d}" for y, m in (running, before))
    day = dt.date(year, month, 28)
    assert time.open_periods(day) == expected
    assert one(spark, time.survey_period(F.col("d")), d=f"DATE'{day}'") == expected[0]


def test_window_includes_both_ends(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-06-30')) AS d")
    seen = days.filter(time.within_days(F.col("d"), dt.date(2024, 3, 31), 30))
    ends = seen.agg(F.min("d"), F.max("d"), F.count("d")).first()
    assert tuple(ends) == (dt.date(2024, 3, 1), dt.date(2024, 3, 31), 31)


def test_minutes_are_boundaries(spark):
    minutes = kpi.minute_boundaries("a", "b")
    late = dict(a="timestamp_ntz'2024-01-01 08:59:59'", b="timestamp_ntz'2024-01-01 09:00:00'")
    assert one(spark, minutes, **late) == 1
    same = dict(a="timestamp_ntz'2024-01-01 09:00:01'", b="timestamp_ntz'2024-01-01 09:00:59'")
    assert one(spark, minutes, **same) == 0


@pytest.mark.parametrize(
    "attended, actual, label",
    [
        (1, "09:00:10", "Retraso: 0 minutos"),
        (1, "09:12:00", "Retraso: 12 minutos"),
        (1, "08:59:00", "A tiempo"),
        (0, "09:12:00", None),
        ("NULL", "09:12:00", None),
    ],
)
def test_punctuality(spark, attended, actual, label):
    values = dict(
        asistencia=f"CAST({attended} AS INT)",
        her="timestamp_ntz'2024-01-01 09:00:05'",
        entrada=f"timestamp_ntz'2024-01-01 {actual}'",
    )
    assert one(spark, kpi.punctuality(), **values) == label


def test_attended_without_arrival_is_on_time(spark):
    values = dict(asistencia="1", her="timestamp_ntz'2024-01-01 09:00:00'")
    values["entrada"] = "CAST(NULL AS TIMESTAMP_NTZ)"
    assert one(spark, kpi.punctuality(), **values) == "A tiempo"


@pytest.mark.parametrize(
    "raw, last",
    [("A | B | \\t Ana\\u00a0", "Ana"), ("\\u3000Ana B\\u2028\\n", "Ana B"), ("Ana", "Ana"), ("", ""), ("a | | b", "| b"), ("A |B", "A |B")],
)
def test_last_name(spark, raw, last):
    assert one(spark, text.last_part(F.col("r")), r=f"'{raw}'") == last


def test_service_fallback(spark):
    service = text.service_type(F.col("a"), F.col("b"))
    assert one(spark, service, a="'S'", b="'T'") == "S"
    assert one(spark, service, a="''", b="'T'") == "T"
    assert one(spark, service, a="CAST(NULL AS STRING)", b="''") == "1 Servicio"


def test_clipped(spark):
    for n, shown in ((100, 100), (101, 103)):
        assert len(one(spark, text.clipped(F.col("t")), t=f"repeat('ñ', {n})")) == shown


@pytest.mark.parametrize(
    "part, whole, scale, pct, light",
    [
        (1899, 2000, 2, 94.95, "AMARILLO"),
        (1899, 2000, 1, 95.0, "VERDE"),
        (80, 100, 2, 80.0, "AMARILLO"),
        (79, 100, 2, 79.0, "ROJO"),
        (5, 0, 2, 0.0, "ROJO"),
        ("NULL", 10, 2, 0.0, "ROJO"),
    ],
)
def test_band_follows_rounding(spark, part, whole, scale, pct, light):
    ratio = kpi.percent(F.col("p"), F.col("w"), scale)
    values = dict(p=f"CAST({part} AS BIGINT)", w=f"CAST({whole} AS BIGINT)")
    assert one(spark, ratio, **values) == pct
    assert one(spark, kpi.band(ratio), **values) == light


def test_thresholds_are_settings(spark):
    strict = Settings(green_from=0.99)
    assert one(spark, kpi.band(F.col("p"), strict), p="95.0D") == "AMARILLO"
    spark.conf.set("spark.ronda.green_from", "0.99")
    spark.conf.set("spark.ronda.org_code", "ACME")
    try:
        found = Settings.from_spark(spark)
    finally:
        spark.conf.unset("spark.ronda.green_from")
        spark.conf.unset("spark.ronda.org_code")
    assert found.green_from == 0.99
    assert "JEFE_ACME" in found.inbox_staff_roles and found.staff_label == "acme"
