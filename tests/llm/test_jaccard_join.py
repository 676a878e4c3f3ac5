import random
import re

import numpy as np
import pytest

from ronda.llm import jaccard_join
from ronda.llm.queries import llm_queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
from ronda.llm.store import prepare_workers


def brute_force(rows, words=5, percent=80):
    """{id: (size, component)} by comparing all pairs of texts."""
    sets = {}
    for i, text in rows:
        found = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        shingles = {tuple(found[k : k + words]) for k in range(len(found) - words + 1)}
        sets[i] = shingles or ({tuple(found)} if found else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def corpus(seed, groups, copies):
    """Groups of drifting copies, a passage in every text, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7)))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(groups):
        text = [word() for _ in range(rng.randint(5, 150))] + passage
        for _ in range(copies):
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = word()
            rows.append((rng.randrange(10**9), " ".join(text)))
    rows += [(rng.randrange(10**9), " ".join(word() for _ in range(rng.randint(0, 80)))) for _ in range(40)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(docs, seed):
    rows = corpus(seed, 12, 12)
    assert found(jaccard_join.near_duplicate_groups(docs(*rows))) == brute_force(rows)


def test_against_all_pairs_in_small_blocks(docs, monkeypatch):
    """One large group, with every shingle shared by many and few members in a block."""
    rows = corpus(3, 2, 70)
    for name, value in (("BLOCK", 16), ("SHARED_LEAST", 2), ("BLOCK_ELEMENTS", 64), ("BROADCAST_ROWS", 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    assert found(jaccard_join.near_duplicate_groups(docs(*rows))) == brute_force(rows)


def test_odd_documents(odd):
    rows = jaccard_join.near_duplicate_groups(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert by_id[3] == [(4, 3), (4, 3)] and by_id[5] == [(4, 3)]
    assert by_id[8] == [(0, 8)] and by_id[9] == [(0, 9)] and by_id[7] == [(0, 7)]
    assert sorted(by_id[None]) == [(0, None), (1, None)]
    assert by_id[4] == [(2, 4)] and by_id[6] == [(1, 6)] and by_id[2] == [(1, 2)]
    assert jaccard_join.near_duplicate_groups(odd.limit(0)).count() == 0


def test_bounds_never_reject_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 5, 400, 700, 3000):
        x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        for change in (0, n // 20, n // 9):
            y = np.unique(np.concatenate([x[change:], rng.integers(0, 1 << 62, change, dtype=np.uint64)]))
            a, b = (jaccard_join._rows_of_bits([jaccard_join._bitmap(s)]) for s in (x, y))
            width = min(a.shape[1], b.shape[1])
            for w in (width, 16):
                apart = np.bitwise_count(jaccard_join._folded(a, w) ^ jaccard_join._folded(b, w)).sum()
                assert apart <= len(np.setxor1d(x, y))


def test_query_against_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert found(llm_queries()["op10_jaccard_join"](spark, sf_dir)) == brute_force([tuple(r) for r in docs])


def test_open_tiles_give_out_members_and_joining_links_only(spark, docs):
    """A crowd of texts that are all nearly alike, on either side of the bound."""
    prepare_workers(spark)
    rnd = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        own = list(base)
        for at in rnd.sample(range(0, 120, 6), rnd.choice([1, 2, 3, 4])):
            own[at] = f"x{k}y{at}"
        rows.append((k, " ".join(own)))
    assert found(jaccard_join.near_duplicate_groups(docs(*rows))) == brute_force(rows)


def test_links_of_a_task_are_fewer_than_its_members(spark):
    sets = [np.sort(np.unique(np.append(np.arange(1, 90 + k, dtype=np.uint64) * np.uint64(2654435761), np.uint64(k)))) for k in range(20)]
    sigs = [jaccard_join._signature(x) for x in sets]
    still = spark.createDataFrame([(1, s, s, len(x)) for s, x in zip(sigs, sets)], "key long, sig long, root long, size int")
    held = spark.createDataFrame([(s, bytearray(x.tobytes())) for s, x in zip(sigs, sets)], "sig long, members binary")
    assert jaccard_join._joining(still, held, 80, 2).count() == len(sets) - 1


def test_tiles_leave_no_members_whose_sizes_or_places_rule_out_all_pairs(docs):
    """Unlike texts that share a passage, each half as long again as the one before."""
    rnd = random.Random(5)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([f"t{k}w{rnd.random()}" for _ in range(int(40 * 1.5**k))] + passage)) for k in range(8)]
    none = np.zeros(0, np.uint64)
    elements = jaccard_join._elements(docs(*rows), "doc_id", "text", 5, 80, none)
    assert elements.groupBy("key").count().where("count >= 3").count()
    assert jaccard_join._tiles(elements, 80, none, 4).where(f"kind = {jaccard_join.MEMBER}").count() == 0


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_similar_sets_are_left_in_the_tile_of_their_first_common_element(percent):
    rng = np.random.default_rng(percent)
    tried = 0
    for _ in range(400):
        n = rng.integers(1, 300)
        gone, new = rng.integers(0, 1 + n * (100 - percent) // 100, 2)
        x = np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 1 << 62, new, dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if not len(y) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        tried += 1
        shared = np.unique(rng.permutation(np.concatenate([x, y]))[: rng.integers(0, len(x) + len(y))])
        a, b = (list(jaccard_join._head(s, shared, percent)) for s in (x, y))
        first = next(e for e in a if e in b)
        size = np.array([len(x), len(y)])
        reach = jaccard_join._reach(size, 256 * np.array([a.index(first), b.index(first)]) // size, percent)
        assert (reach >= size[::-1]).all()
    assert tried > 50


def test_members_left_against_all_pairs():
    rng = np.random.default_rng(8)
    for _ in range(300):
        n = rng.integers(1, 40)
        rows = sorted(zip(rng.integers(0, 3, n).tolist(), rng.integers(1, 90, n).tolist(), rng.integers(0, 60, n).tolist(), strict=True))
        group, size, late = (np.array(c) for c in zip(*rows, strict=True))
        lead, reach = jaccard_join._leaders(group, size, 80), jaccard_join._reach(size, late, 80)
        want = np.zeros(n, bool)
        for i in range(n):
            for j in range(i + 1, n):
                if group[i] == group[j] and lead[j] != i and size[j] <= reach[i] and size[i] <= reach[j]:
                    want[[i, j]] = True
        assert (jaccard_join._left(group, size, reach, lead != np.arange(n), 80) == want).all()


def test_crowds_of_like_sizes_against_all_pairs(docs, monkeypatch):
    """Drifting copies and unlike texts of like sizes that share passages, without salted keys."""
    monkeypatch.setattr(jaccard_join, "SHARED_LEAST", 1000)
    rnd = random.Random(21)
    passages = [[f"p{k}q{j}" for j in range(8)] for k in range(12)]
    rows = []
    for g in range(14):
        text = [f"g{g}w{k}" for k in range(rnd.randint(40, 70))]
        for at in sorted(rnd.sample(range(len(text)), 4), reverse=True):
            text[at:at] = rnd.choice(passages)
        for _ in range(9):
            text = list(text)
            for _ in range(rnd.randint(0, 2)):
                text[rnd.randrange(len(text))] = f"x{rnd.random()}"
            rows.append((len(rows), " ".join(text)))
    assert found(jaccard_join.near_duplicate_groups(docs(*rows))) == brute_force(rows)
