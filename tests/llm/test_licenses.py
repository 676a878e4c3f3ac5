import re
import time

from ronda.llm import licenses
from ronda.llm.queries import llm_queries

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {tuple(p.split()): label for p, label in licenses.BASE.items()}


def base(text):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    places, labels = [], set()
    for k in range(len(words)):
        for phrase, label in PHRASES.items():
            if tuple(words[k : k + len(phrase)]) == phrase:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def check(found, rows):
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in found), key=repr)
    assert got == sorted(((i, *base(t)) for i, t in rows), key=repr)
    for r in found:
        labels = r.labels.split(",") if r.labels else []
        assert labels == sorted(set(labels)) and set(filter(None, r.base_labels.split(","))) <= set(labels)
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels)


def scan(df):
    return licenses.digests(licenses.license_scan(df)).collect()


def test_there_are_hundreds_of_rules():
    known = licenses.rules()
    assert len(known) >= 300 and all(re.compile(r[3]) for r in known)


def spelled(tree):
    """Every string that a parsed pattern of literals, sets, branches and optional parts matches."""
    out = [""]
    for kind, value in tree:
        match str(kind):
            case "LITERAL":
                tails = [chr(value)]
            case "IN":
                tails = [chr(c) for _, c in value]
            case "BRANCH":
                tails = [t for branch in value[1] for t in spelled(branch)]
            case "SUBPATTERN":
                tails = spelled(value[3])
            case "MAX_REPEAT":
                assert value[:2] == (0, 1)
                tails = ["", *spelled(value[2])]
            case other:
                raise AssertionError(other)
        out = [a + b for a in out for b in tails]
    return out


def test_every_alternative_of_a_family_contains_its_keyword():
    for _, keyword, name in licenses.FAMILIES:
        for one in spelled(re._parser.parse(name)):
            assert keyword in f" {one} ", (keyword, one)


def test_expat_without_the_word_mit(docs):
    row = scan(docs((1, "Licensed under the Expat license.")))[0]
    assert row.labels == "mit"


def test_places_of_base_phrases(docs):
    rows = [
        (1, "MIT License mit license, MIT-License"),
        (2, "the GNU General Public License and the Apache License"),
        (3, "mit licenses are no mit licence"),
        (4, "license"),
        (5, "Apache\n\tLicense; général public license general public license"),
        (6, "mit license " * 3000),
    ]
    check(scan(docs(*rows)), rows)


def test_odd_documents(odd):
    check(scan(odd), [tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert scan(odd.limit(0)) == []


def test_contained_detections_are_suppressed(docs):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "SPDX-License-Identifier: GPL-3.0-only"),
        (3, "GNU Lesser General Public License version 2.1"),
        (4, "das war mit 4 leuten in apache"),
        (5, "code is BSD 3-clause and docs are CC BY-SA 4.0"),
    ]
    spans = {r.doc_id: list(r.spans) for r in scan(docs(*rows))}
    assert spans[1] == ["apache:0:8"]
    assert spans[2] == ["gpl:0:7"]
    assert [s.split(":")[0] for s in spans[3]] == ["lgpl"]
    assert spans[4] == []
    assert {s.split(":")[0] for s in spans[5]} == {"bsd", "cc-by-sa"}


def test_survivors_against_all_pairs(docs):
    text = "the mit license or apache license version 2 0 gpl 2 licensed under the gpl version 3 or later cc by sa 4 0 " * 3
    row = licenses.license_scan(docs((1, text))).first()
    found = [(s.start, s.stop, s.rule.level) for s in row.spans]
    assert found
    for a in found:
        for b in found:
            inside = b is not a and b[0] <= a[0] and a[1] <= b[1] and b[2] <= a[2]
            assert not inside or (a[0], a[1]) == (b[0], b[1]) and a is b


def test_many_detections_in_one_text_take_linear_time(docs):
    """Forty thousand of them, far from the square of their number; the chunks hand on what a long one suppresses."""
    def seconds(n):
        rows = [(1, "mit license " * n)]
        start = time.monotonic()
        check(scan(docs(*rows)), rows)
        return time.monotonic() - start

    seconds(10)
    short, long = seconds(10_000), seconds(40_000)
    assert long < 5 * short + 5


def test_only_latin_capitals_are_lowered(docs):
    """The Kelvin sign is no k."""
    assert [r.n_words for r in scan(docs((1, "\u212a \u00c9 K")))] == [3]
    assert licenses.license_scan(docs((1, "Wor\u212a under the E\u00c9 MIT License"))).first().spans[0].rule.label == "mit"


def test_query(spark, sf_dir):
    found = llm_queries()["op9_licenses"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    check(found.collect(), [tuple(r) for r in rows])
