import hashlib

import pytest
import xxhash
from pyspark.sql import functions as F

from ronda.llm import fingerprints as fp
from ronda.llm.queries import llm_queries


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def signed(text):
    """The hash that orders texts of one id."""
    return (xxhash.xxh64_intdigest((text or "").encode(), seed=42) ^ (1 << 63)) - (1 << 63)


def expected(rows):
    """(id, n_chars, edited sha, near edited, near next) in the order of the contract."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    out = []
    for k, (i, text) in enumerate(order):
        text, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + nxt[:third]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), near(text, edited), near(text, nxt)))
    return out


def check(found, rows, most=0.15):
    want = sorted(expected(rows), key=repr)
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found), key=repr)
    assert [w[:3] for w in want] == [g[:3] for g in got]
    for w, g in zip(want, got, strict=True):
        assert abs(w[3] - g[3]) <= most and abs(w[4] - g[4]) <= most


def test_odd_documents(odd):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    found = fp.fingerprints(odd)
    check(found.collect(), rows)
    assert fp.fingerprints(odd.limit(0)).count() == 0
    check(fp.fingerprints(odd.limit(1)).collect(), rows[:1])
    same = [tuple(r.sketch) for r in found.where("doc_id in (3, 5)").collect()]
    assert len(set(same)) == 1


def test_only_null_ids(docs):
    rows = [(None, "b c d"), (None, "a b c d e f")]
    check(fp.fingerprints(docs(*rows)).collect(), rows)


def largest_range(found):
    return found.groupBy("bucket", "sub").count().agg(F.max("count")).first()[0]


@pytest.mark.parametrize("hot", [None, 7])
def test_hot_ids_are_divided(docs, hot):
    rows = [(hot if k % 3 else k, f"text {k} of {k % 5} words and some more of them") for k in range(600)]
    table = docs(*rows)
    check(fp.fingerprints(table).collect(), rows)
    assert largest_range(fp.with_next(table, "doc_id", "text")) < 150  # 400 rows have the hot id


def test_equal_rows_are_held_once(docs, monkeypatch):
    rows = [(None, "the same text in very many rows") for _ in range(300)] + [(k % 4, f"text {k}") for k in range(40)]
    rows += [(2, "twice and more") for _ in range(200)]
    monkeypatch.setattr(fp, "COPIES", 16)
    table = docs(*rows)
    check(fp.fingerprints(table).collect(), rows)
    assert largest_range(fp.with_next(table, "doc_id", "text")) < 60


def test_ranges_follow_the_size(docs):
    table = docs(*[(k, f"w{k} " * 50) for k in range(500)])
    few, many = (fp.with_next(table, "doc_id", "text", size) for size in (1 << 30, 2_000))
    assert many.rdd.getNumPartitions() > 4 * few.rdd.getNumPartitions()
    assert largest_range(many) < 20


def test_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    found = llm_queries()["op3_fingerprints"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    check(found.collect(), [tuple(r) for r in rows])


@pytest.fixture
def sketched(spark):
    texts = [(k % 3, " ".join(f"w{(k * 37 + j) % 900}" for j in range(700))) for k in range(12)]
    return spark.createDataFrame(texts, "g int, text string").withColumn("w", fp.words(F.col("text")))


def test_parts_merge_into_the_whole(sketched):
    parts = sketched.select("g", fp.sketch("w").alias("sketch"))
    merged = {r.g: list(r.sketch) for r in fp.merged_by(parts, "g").collect()}
    for g in range(3):
        union = sorted({h for r in parts.where(F.col("g") == g).collect() for h in r.sketch})[: fp.K]
        assert merged[g] == union


def test_estimates(spark):
    a = " ".join(f"w{j}" for j in range(3000))
    b = " ".join(f"w{j}" for j in range(1500))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(fp.words(F.col("a")).alias("wa"), fp.words(F.col("b")).alias("wb"))
    df = df.select(fp.sketch("wa").alias("a"), fp.sketch("wb").alias("b"))
    r = df.select(
        fp.distinct_shingles(F.col("a")).alias("n"), fp.resemblance(F.col("a"), F.col("b")).alias("r"),
        fp.containment(F.col("b"), F.col("a")).alias("c"), fp.containment(F.col("a"), F.col("b")).alias("d"),
    ).first()
    assert abs(r.n - 2996) < 500 and abs(r.r - 0.5) < 0.12 and r.c > 0.8 and abs(r.d - 0.5) < 0.12
