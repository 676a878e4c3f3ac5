"""Places in a report's order."""

import random

import pytest

from ronda.plans.places import with_places

SCHEMA = "email_login string, instalacion_rol string, guardias_ausentes long, porcentaje_cobertura double, extra string"


def some_rows(seed, n=500):
    rnd = random.Random(seed)
    pick = lambda *values: rnd.choice(values)
    return [(pick("a", "b", None), pick("s", "t", "u", None), pick(0, 1, 2, None), pick(1.5, 2.5, None), pick("x", "y", None)) for _ in range(n)]


def expected(rows):
    """Ascending with nulls first, descending with nulls last."""
    up = lambda v: (v is not None, v if v is not None else 0)
    text = lambda v: (v is not None, v or "")
    order = sorted(rows, key=lambda r: (text(r[0]), (r[2] is None, -(r[2] or 0)), up(r[3]), text(r[1]), text(r[4])))
    return [(*r, k + 1) for k, r in enumerate(order)]


@pytest.mark.parametrize("ranges", [1, 4, 9])
def test_places_do_not_depend_on_ranges_or_partitions(spark, ranges):
    data = some_rows(1)
    for partitions in (1, 5):
        df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
        got = with_places(df, "coverage_by_site", ranges=ranges)
        assert sorted((tuple(r) for r in got.collect()), key=lambda r: r[-1]) == expected(data)


def test_no_window_over_everything(spark):
    df = spark.createDataFrame(some_rows(2), SCHEMA)
    text = with_places(df, "coverage_by_site", ranges=4)._jdf.queryExecution().executedPlan().toString()
    for window in (part for part in text.split("\n") if "Window [" in part):
        assert "_tramo" in window
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_one_row_repeated_and_no_rows(spark):
    data = [("a", "s", 1, 1.0, "x")] * 50
    got = with_places(spark.createDataFrame(data, SCHEMA), "coverage_by_site", ranges=8)
    assert sorted(r.lugar for r in got.collect()) == list(range(1, 51))
    assert with_places(spark.createDataFrame([], SCHEMA), "coverage_by_site").count() == 0
