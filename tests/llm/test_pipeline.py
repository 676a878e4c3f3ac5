import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_jaccard_join import brute_force

from ronda.llm import quality, toxicity
from ronda.llm.queries import BYTE_TOKENIZER, table
from tokenizers import Tokenizer

SF_DIR = "/root/testdata/sf0.01"


def test_stages_have_effect_and_keep_columns(spark):
    docs = table(spark, SF_DIR, "documents")
    labels = table(spark, SF_DIR, "labels")
    before = {r.doc_id: r for r in docs.collect()}
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "toxicity", "near_duplicates", "packing"]
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, kept[-1], SF_DIR)
        assert out.schema.simpleString() == docs.schema.simpleString()
        rows = out.collect()
        assert all(before[r.doc_id] == r for r in rows) and len({r.doc_id for r in rows}) == len(rows)
        kept.append(spark.createDataFrame(rows, docs.schema))
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    good = {r.doc_id for r in quality.scored(docs, quality.fit(docs, labels)).where("keep").collect()}
    assert ids[1] == good & ids[0]
    mild = toxicity.scored(kept[1], toxicity.fit(kept[1], labels)).where("predicted = 0").select("doc_id").collect()
    assert ids[2] == {r.doc_id for r in mild}
    groups = brute_force([(r.doc_id, r.text) for r in kept[2].collect()])
    assert ids[3] == {i for i, (_, root) in groups.items() if i == root}
    assert len(ids[0]) > len(ids[1]) > len(ids[2]) > len(ids[3]) > 0.5 * len(ids[0])


def test_rows_without_an_id_stay(spark, odd):
    out = corpus_pipeline.one_of_each_group(spark, odd.drop("id", "sig"), SF_DIR)
    found = sorted((r.doc_id for r in out.collect()), key=repr)
    assert found == sorted([None, None, 1, 2, 3, 4, 6, 7, 8, 9], key=repr)


def test_rows_are_decided_one_by_one(spark, monkeypatch):
    """Rows without an id pass no filter for it, and rows that share one do not follow each other."""
    docs = table(spark, SF_DIR, "documents").limit(300)
    schema = docs.schema
    rows = [tuple(r) for r in docs.collect()]
    at = schema.names.index("doc_id")
    named = {"null": None, "shared": 7}
    model = quality.fit(docs, table(spark, SF_DIR, "labels"))
    net = toxicity.fit(docs, table(spark, SF_DIR, "labels"))
    monkeypatch.setattr(quality, "fit", lambda *_: model)
    monkeypatch.setattr(toxicity, "fit", lambda *_: net)
    text = schema.names.index("text")
    for stage, good in (
        (corpus_pipeline.good_quality, quality.scored(docs, model).where("keep")),
        (corpus_pipeline.not_toxic, toxicity.scored(docs, net).where("predicted = 0")),
    ):
        ids = {r.doc_id for r in good.collect()}
        want = sorted(r[text] or "" for r in rows if r[at] in ids)
        assert 0 < len(want) < len(rows)
        for i in named.values():
            same = spark.createDataFrame([(*r[:at], i, *r[at + 1 :]) for r in rows], schema)
            assert sorted(r.text or "" for r in stage(spark, same, SF_DIR).collect()) == want


def test_groups_of_rows_without_and_with_shared_ids(docs, spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    kept = corpus_pipeline.one_of_each_group(spark, docs((7, a), (7, b), (5, b), (None, b), (None, c), (None, c)).drop("id", "sig"), SF_DIR)
    assert sorted((repr(r.doc_id), r.text) for r in kept.collect()) == sorted([("7", a), ("5", b), ("None", c)])


def test_run_packs_what_is_left(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    library = Tokenizer.from_file(BYTE_TOKENIZER)
    texts = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    total = {r.doc_id: (r.n, r.t) for r in out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()}
    assert 0 < len(total) < len(texts)
    for i, (n, t) in list(total.items())[:200]:
        assert n == t == len(library.encode(texts[i], add_special_tokens=False).ids) + 1


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_no_documents(spark, stage):
    docs = table(spark, SF_DIR, "documents").limit(0)
    assert stage(spark, docs, SF_DIR).count() == 0
