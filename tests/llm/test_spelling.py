import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ronda.llm import spelling
from ronda.llm.queries import llm_queries
from ronda.llm.store import prepare_workers


def words_of(rows, least=6, often=5, every=None):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc}:{run}".encode())
            if every and doc is not None and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= often}


def neighbours(words):
    """Pairs one edit apart, by all words with one code point taken out."""
    found = {w: set() for w in words}
    holes, gone = {}, {}
    for w in words:
        for k in range(len(w)):
            holes.setdefault((k, w[:k], w[k + 1 :]), []).append(w)
            gone.setdefault(w[:k] + w[k + 1 :], set()).add(w)
    for same in holes.values():
        for w in same:
            found[w] |= {x for x in same if x != w}
    for w in words:
        for x in gone.get(w, ()):
            found[w].add(x)
            found[x].add(w)
    return found


def brute_force(rows, times=5, **how):
    counts = words_of(rows, **how)
    near = neighbours(counts)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items())


def found(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_index_counts_substrings_from_either_side():
    rng = np.random.default_rng(2)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(2, 9))) for _ in range(300)})
    text = "$" + "$".join(words) + "$"
    index = spelling.Vocabulary(words).index
    for pattern in ("a", "ab", "cab", "$ab", "ba$", "abcab"):
        codes = ["$abc".index(c) for c in pattern]
        for middle in range(len(pattern)):
            state = index.everything(1)
            for c in codes[middle:]:
                state = index.extended(state, np.array([c]), spelling.RIGHT)
            for c in codes[:middle][::-1]:
                state = index.extended(state, np.array([c]), spelling.LEFT)
            times = sum(text.startswith(pattern, k) for k in range(len(text)))
            assert state[0, 2] == times
            starts = sorted(index.suffixes[state[0, 0] : state[0, 0] + times])
            assert starts == [k for k in range(len(text)) if text.startswith(pattern, k)]


@pytest.mark.parametrize("block", [7, 4096])
def test_near_words_as_brute_force(spark, block):
    prepare_workers(spark)
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abé"), rng.integers(2, 8))) for _ in range(400)})
    df = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n long")
    got = [(r.word, r.other) for r in spelling.near_words(df, block).collect()]
    assert sorted(got) == sorted((w, x) for w, near in neighbours(words).items() for x in near)


def test_groups_as_brute_force(docs):
    rng = np.random.default_rng(5)
    base = ["wonderful", "wonderfull", "wondrful", "wonderfuls", "Wonderful", "colour", "colours", "colouur", "color s", "ÉCOLES", "écoles", "École×s", "aaaaaa", "aaaaaaa", "baaaaa"]
    rows = [(int(rng.integers(0, 900)), " ".join(rng.choice(base, 60, p=np.arange(1, 16) / 120))) for _ in range(40)]
    for every in (None, 3, 199):
        assert found(spelling.variant_groups(docs(*rows), edit_every=every)) == brute_force(rows, every=every)


def test_forms_are_followed_to_the_root(docs):
    rows = [(1, "abcdef " * 5 + "abcdeg " * 25 + "abcdgg " * 125 + "abcggg " * 625)]
    assert found(spelling.variant_groups(docs(*rows))) == brute_force(rows)
    assert {r[2] for r in found(spelling.variant_groups(docs(*rows)))} == {"abcggg"}


def test_many_words_share_a_half(docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [f"shared{a}{b}" for a in letters[:12] for b in letters] + ["sharea", "sharedaaa"]
    rows = [(7, " ".join(words * 5) + " sharedab" * 40)]
    assert found(spelling.variant_groups(docs(*rows), block_rows=16)) == brute_force(rows)


def test_odd_rows(docs, odd):
    assert found(spelling.variant_groups(odd)) == []
    rows = [(None, "without an id " * 5), (3, None), (4, ""), (5, "z" * 2_000 + " "), *[(6, "y" * 300 + " " + "y" * 299)] * 6, (None, "WITHOUT without " * 9)]
    assert found(spelling.variant_groups(docs(*rows), edit_every=2)) == brute_force(rows, every=2)
    assert found(spelling.variant_groups(docs())) == []


def test_long_texts_are_counted_whole(docs, monkeypatch):
    rows = [(1, "letters " * 50 + "lettres")]
    assert found(spelling.variant_groups(docs(*rows))) == [("letters", None, "letters", 50, 0, None)]


def test_query_as_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(llm_queries()["op11_spelling"](spark, sf_dir)) == brute_force(rows, every=199)
