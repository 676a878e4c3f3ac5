import os
import subprocess
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ronda.llm import quality, toxicity
from ronda.llm.store import prepare_workers


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def bad_words():
    """Texts of made-up words; a toxic one holds a bad word or an inflection of a bad stem somewhere."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 9)))
    texts, labels = [], []
    for k in range(400):
        text = [word() for _ in range(rng.integers(5, 150))]
        if k % 2:
            bad = rng.choice(["Moron.", "xqzu" + word(), "SCUM"])
            text.insert(rng.integers(0, len(text)), bad)
        texts.append(" ".join(text))
        labels.append(k % 2)
    return texts, np.array(labels)


def test_network_learns_words_and_stems(bad_words):
    texts, labels = bad_words
    net = toxicity.train(texts[:300], labels[:300])
    score = np.zeros(100)
    for begin, _, words in toxicity.read_words(pa.array(texts[300:])):
        logit = net.logits(words)
        best = toxicity._best_of(words.rows, logit)
        score[words.rows[best] + begin] = net.probability(logit[best])
    assert ((score >= 0.5) == labels[300:]).mean() >= 0.95


def test_gradients_against_differences():
    net, rng = toxicity.Network(), np.random.default_rng(0)
    _, _, words = next(toxicity.read_words(pa.array(["one two three four five six", "seven eight", "nine " * 70])))
    pick, target = np.arange(len(words.windows)), np.array([1.0, 0.0] * 9, np.float32)[: len(words.windows)]
    for k in net.dense:
        net.dense[k] = net.dense[k].astype(np.float64)
    net.word, net.gram = net.word.astype(np.float64), net.gram.astype(np.float64)

    class Kept:
        def random(self, n):
            return np.ones(n)

    loss, grads, _ = net.gradients(words, pick, target, Kept())
    for name in net.dense:
        flat = net.dense[name].reshape(-1)
        at = int(rng.integers(len(flat)))
        before = flat[at]
        flat[at] = before + 1e-3
        up = net.gradients(words, pick, target, Kept())[0]
        flat[at] = before - 1e-3
        down = net.gradients(words, pick, target, Kept())[0]
        flat[at] = before
        assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[at]) < 2e-3


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 48, 49, 200):
        _, _, words = next(toxicity.read_words(pa.array(["w " * n])))
        covered = {f + k for f in words.first for k in range(toxicity.WINDOW) if f + k < n}
        assert covered == set(range(n))
        assert all(b - a == toxicity.STRIDE for a, b in zip(words.first, words.first[1:], strict=False))


def test_odd_documents(odd):
    net = toxicity.Network()
    found = toxicity.scored(odd, net)
    rows = found.collect()
    assert len(rows) == odd.count() and found.columns[:3] == ["doc_id", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.score == 0.0 and r.worst_word is None for r in rows if r.doc_id in (7, 8, 9))
    assert len({r.score for r in rows if r.doc_id in (3, 5)}) == 1
    assert toxicity.scored(odd.limit(0), net).count() == 0


BESIDE = """
import numpy as np, pyarrow as pa
from ronda.llm import toxicity
rng, net = np.random.default_rng(3), toxicity.Network()
texts = [" ".join(f"w{k}" for k in rng.integers(0, 300, n)) for n in (*range(1, 50), 130, 700)]
score = lambda some: toxicity._scores(net, pa.array(some))[0].tolist()
for at, text in enumerate(texts):
    beside = texts[at + 1 :] + texts[:at]
    found = {score(beside[:k] + [text] + beside[k:n])[k] for n in (0, 1, 2, 4, 50) for k in {0, n // 2, n}}
    assert len(found) == 1, found
"""


def test_scores_do_not_depend_on_the_texts_beside():
    """With the products of a processor that rounds rows by their place, where the library has them."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run(
        [sys.executable, "-c", BESIDE], env=os.environ | {"OPENBLAS_CORETYPE": "Haswell", "PYTHONPATH": root}, capture_output=True, text=True, check=False
    )
    assert done.returncode == 0, done.stderr


def test_fit_without_usable_labels(spark, odd):
    labels = spark.createDataFrame([(3, 1, None), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(odd, toxicity.fit(odd, labels)).count() == odd.count()
    assert quality.scored(odd, quality.fit(odd, labels)).count() == odd.count()


def test_quality_is_fitted_without_texts_on_the_driver(spark, docs, monkeypatch):
    """The driver takes features of the sample, the same that its texts have."""
    told = [i for i in range(300) if not held_out(i)]
    texts = {i: f"needle {i}\n" * (i % 7 + 1) + "good words " * (i % 2 * 20) for i in range(300)}
    own = docs(*texts.items())
    labels = spark.createDataFrame([(i, i % 2) for i in told], "doc_id long, quality int")
    taken, fitted = [], []
    for name in ("toArrow", "collect", "toPandas", "toLocalIterator"):
        real = getattr(type(own), name)
        monkeypatch.setattr(type(own), name, lambda self, *a, real=real, **b: taken.append(real(self, *a, **b)) or taken[-1])
    monkeypatch.setattr(quality, "cotrain", lambda *found: fitted.append(found))
    quality.fit(own, labels)
    assert taken and not any("needle" in str(x.to_pydict() if isinstance(x, pa.Table) else x) for x in taken)
    column = pa.array([texts[i] for i in told])
    content, metadata, label, _ = fitted[0]
    assert label.tolist() == [i % 2 for i in told]
    assert np.array_equal(content, quality.content_view(column))
    sizes = np.array([len(texts[i]) for i in told], float)
    assert np.array_equal(metadata, quality.metadata_view(column, ["en"] * len(told), ["src0"] * len(told), sizes))


def test_quality_of_odd_documents(odd):
    model = quality.Model(*(quality.View(np.zeros(n), np.ones(n), np.ones(n + 1)) for n in (110, 72)), np.ones(3))
    found = quality.scored(odd, model)
    assert found.count() == odd.count()
    assert all(0 <= r.score <= 1 and r.keep == (r.score >= 0.5) for r in found.collect())
    assert quality.scored(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("label", ["toxic", "quality"])
def test_held_out_accuracy(spark, label):
    """On rows that were never fitted on."""
    prepare_workers(spark)
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    tested = docs.where(toxicity.held_out()).join(labels.select("doc_id"), "doc_id", "left_semi")
    if label == "toxic":
        found = {r.doc_id: r.predicted for r in toxicity.scored(tested, toxicity.fit(docs, labels)).collect()}
    else:
        found = {r.doc_id: int(r.keep) for r in quality.scored(tested, quality.fit(docs, labels)).collect()}
    right = [found[r.doc_id] == r[label] for r in labels.collect() if r.doc_id in found]
    assert all(held_out(i) for i in found) and len(right) > 500
    assert np.mean(right) >= 0.97


def test_a_huge_text_and_plenty_of_one_label_leave_the_rare_label_whole(spark, docs):
    """Characters are bounded per label, and a text that does not fit is passed over."""
    ids = [i for i in range(4000) if not held_out(i)]
    rare, huge, plenty = ids[:20], ids[20], ids[21:2000]
    rows = [(i, "r" * 100) for i in rare] + [(huge, "h" * 50_000)] + [(i, "p" * 100) for i in plenty]
    labels = spark.createDataFrame([(i, int(i in rare)) for i, _ in rows], "doc_id long, toxic int")
    sample = toxicity.labelled_sample(docs(*rows), labels, "toxic", "doc_id", "text", 2000, 20_000).collect()
    assert {r._id for r in sample if r._label == 1} == set(rare)
    assert len([r for r in sample if r._label == 0]) == 200 and huge not in {r._id for r in sample}


def test_pseudo_labels_come_from_all_unlabelled_rows(spark, docs):
    """The surest of all rows are given, by either view, and none of them twice."""
    own = docs(*((i if i % 2 else None, f"text {i} " * (i % 9 + 1)) for i in range(7005)), (1, None)).repartition(5)
    told = spark.createDataFrame([(i,) for i in (1, 3, 5, 7, 9)], "doc_id long")
    more = quality.Unlabelled(own, told, "doc_id", "text")
    read = more.rows.collect()
    assert len(read) == 7000 and more.take == quality.MOST_GIVEN
    rng, views = np.random.default_rng(1), []
    for name in ("content", "metadata"):
        x = np.array([r[name] for r in read])
        views.append(quality.View(x.mean(0), x.std(0) + 1, rng.standard_normal(x.shape[1] + 1) * 20))
    given = [set(), set()]
    for _ in range(3):
        found = more.surest(views, given)
        for k, name in enumerate(("content", "metadata")):
            logit = views[k].logit(np.array([r[name] for r in read]))
            for y in (0, 1):
                rows = [f[1] for f in found if f[0] == k and f[2] == y]
                surety = sorted(
                    (s for r, s in zip(read, logit if y else -logit, strict=True) if r.row not in given[k] and s > quality.SURE), reverse=True
                )
                at = {r.row: i for i, r in enumerate(read)}
                got = sorted(((1 if y else -1) * logit[at[i]] for i in rows), reverse=True)
                assert len(set(rows)) == len(rows) and np.allclose(got, surety[: more.take], atol=1e-3)
            given[k].update(f[1] for f in found if f[0] == k)
    assert given[0] and given[1]


def test_names_with_a_common_ending_are_told_apart():
    buckets = {quality._bucket(f"{c}.example.com") for c in "abcdefghijklmnopqrstuvwxyz"}
    assert len(buckets) > 10
