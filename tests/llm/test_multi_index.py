import numpy as np
import pytest

from ronda.llm import multi_index
from ronda.llm.queries import llm_queries
from ronda.llm.store import prepare_workers

SCHEMA = "vec_id long, embedding array<float>, id long, v string, c1 int, block int"


@pytest.fixture
def vectors(spark):
    prepare_workers(spark)
    return lambda rows: spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def truth(rows, every, k=10):
    """{query: [(id, distance)]}, all rows compared."""
    kept = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)}
    ids = np.array([i for i, _ in sorted(kept)])
    x = np.array([v for _, v in sorted(kept)], np.float32).astype(float)
    out = {}
    for n in np.flatnonzero(ids % every == 0):
        d = np.sqrt(((x - x[n]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != ids[n]][:k]
        out[int(ids[n])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def recall(found, want):
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {q for q in want if want[q]}
    for q, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, len(rows) + 1))
        assert [(r[2], r[1]) for r in rows] == sorted((r[2], r[1]) for r in rows)
    hits = sum(len({i for i, _ in want[q]} & {r[1] for r in got[q]}) for q in got)
    return hits / sum(len(w) for w in want.values()), got


def test_few_rows_are_all_found(vectors):
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(6).tolist()) for i in range(8)]
    share, got = recall(multi_index.search(vectors(rows), every=4).collect(), truth(rows, 4))
    assert share == 1.0 and all(len(r) == 7 for r in got.values())


def test_odd_vectors(vectors):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(5).tolist()) for i in range(60)]
    same = rng.standard_normal(5).tolist()
    rows += [(100 + i, same) for i in range(40)] + [(101, same)]
    rows += [(500, None), (600, [0.0] * 5), (700, [1.0, None, 1.0, 1.0, 1.0]), (800, [float("nan")] * 5)]
    rows += [(900, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (None, same), (1000, [])]
    want = truth([r for r in rows if r[0] != 1000], 20)
    share, got = recall(multi_index.search(vectors(rows), every=20).collect(), want)
    assert share >= 0.9
    assert [r[1] for r in got[100]] == list(range(101, 111)) and {r[2] for r in got[100]} == {0.0}
    assert multi_index.search(vectors([]), every=10).count() == 0
    assert multi_index.search(vectors([(1, None)]), every=1).count() == 0


def test_cells_are_visited_by_summed_distance():
    rng = np.random.default_rng(3)
    index = multi_index.Index(rng.standard_normal((7, 3)), rng.standard_normal((5, 4)), np.ones((7, 5), np.int64), 9)
    v = rng.standard_normal(7)
    cost = lambda i, j: ((index.first[i] - v[:3]) ** 2).sum() + ((index.second[j] - v[3:]) ** 2).sum()
    order = [cost(i, j) for i, j in index.traverse(v)]
    assert len(order) == 35 and order == sorted(order)
    assert sum(open_.sum() for open_ in index.plan(v).values()) == 9


def test_query_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    share, got = recall(llm_queries()["op8_multi_index"](spark, sf_dir).collect(), truth([tuple(r) for r in rows], 100))
    assert share >= 0.9
    for q, found in got.items():
        exact = dict(truth([tuple(r) for r in rows], 100, k=len(rows))[q])
        assert all(abs(exact[i] - d) < 1e-12 for _, i, d in found)
