import numpy as np
import pytest
from oracle_check import compare, oracle_connection
from pyspark.sql import functions as F

from ronda.llm import hard_negatives as hn
from ronda.llm.oracle import ORACLE
from ronda.llm.queries import llm_queries
from ronda.llm.store import prepare_workers

SCHEMA = "vec_id long, label long, vector array<long>, score string, tile string, id string, at string"


@pytest.fixture
def rows(spark):
    prepare_workers(spark)
    return lambda *r: spark.createDataFrame([(*x, "s", "t", "i", "a") for x in r], SCHEMA)


def brute_force(rows, every=50, k=5, m=3):
    first = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            first[i] = min(first.get(i, (label, v)), (label, v))
    dot = lambda a, b: max(-hn.BOUND, min(hn.BOUND, sum(x * y for x, y in zip(a, b))))
    found = set()
    for a, (label, v) in first.items():
        if a % every:
            continue
        ranked = sorted((-dot(v, w), i, other) for i, (other, w) in first.items() if i != a)
        for p, i, _ in [x for x in ranked if x[2] == label][:k]:
            fit = [(s, j) for s, j, other in ranked if other != label and -50 * p <= -100 * s <= -95 * p]
            found |= {(a, i, r + 1, j, -p, -s) for r, (s, j) in enumerate(fit[:m])}
    return found


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (7, 5, 3), (33, 64, 65), (100, 31, 70), (0, 4, 5), (4, 0, 5)])
def test_strassen_is_the_product(shape):
    rng = np.random.default_rng(4)
    a, b = rng.integers(-300, 300, shape[:2]), rng.integers(-300, 300, shape[1:])
    assert (hn.strassen(a, b, 2) == a @ b).all()
    assert (hn.strassen(a.astype(object), b.astype(object), 2) == a @ b).all()


def test_products_beyond_64_bits_are_held_at_the_bounds():
    a = np.array([[2**62, 2**62], [1, -1]])
    assert hn.products(a, np.array([[4, 4], [-4, -4], [1, 1]])).tolist() == [[hn.BOUND, -hn.BOUND, hn.BOUND], [0, 0, 0]]


def test_as_brute_force_in_small_tiles(rows):
    rng = np.random.default_rng(8)
    data = [(i, int(rng.integers(0, 4)), [int(x) for x in rng.integers(-3, 9, int(rng.integers(0, 6)))]) for i in range(300)]
    mined = hn.mined(rows(*data), every=10, anchor_rows=7, tile_rows=11, stripe_tiles=2)
    assert found(mined) == sorted(brute_force(data, 10))
    assert found(hn.mined(rows(*data), every=10)) == sorted(brute_force(data, 10))


def test_nulls_ties_and_repeated_rows(rows):
    data = [
        (0, 1, [4, 4]), (0, 1, [4, 4]), (0, 2, [9, 9]), (None, 1, [4, 4]), (1, None, [4, 4]), (2, 1, None), (3, 1, [4, None]),
        (4, 1, [4, 4]), (5, 1, [4, 4]), (6, 2, [3, 3]), (7, 2, [3, 3]), (8, 3, []), (9, 2, [2**40, 2**40]), (50, 1, [2**40, 2**40]),
        (100, 7, [1, 1]), (-50, 2, [3, 3, 0]),
    ]
    assert found(hn.mined(rows(*data))) == sorted(brute_force(data))


def test_a_third_of_the_rows_share_an_id(rows):
    data = [(100, 1, [5, 5])] * 200 + [(i, i % 2, [5, i % 3]) for i in range(100, 200)]
    assert found(hn.mined(rows(*data), tile_rows=16)) == sorted(brute_force(data))


def test_no_rows(rows):
    for data in ([], [(None, None, None)], [(50, 1, [1])], [(1, 1, [1]), (2, 2, [1])]):
        assert found(hn.mined(rows(*data))) == []


def test_prepared(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [0.5, -0.001], 3), (7, [0.25], 9), (2, [nan], 1), (3, [inf], 1), (4, [None], 1), (5, None, 1), (6, [1.0], None), (8, [], 1)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.label, r.vector) for r in hn.prepared(df).collect()}
    assert got == {1: (3, [128, -1]), 7: (0, [64]), 6: (None, [256]), 8: (1, [])}


def test_no_task_takes_all_candidates_and_no_cross_join(spark, sf_dir):
    rows_ = hn.prepared(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    plan = hn.mined(rows_)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_query_is_its_sql(spark, sf_dir):
    query = llm_queries()["op13_hard_negatives"]
    assert compare(spark, oracle_connection(sf_dir), "op13", query, ORACLE["op13_hard_negatives"], sf_dir) is None
    assert query(spark, sf_dir).where(F.col("rank") > 3).count() == 0
