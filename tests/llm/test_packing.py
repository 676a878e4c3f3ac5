import itertools
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ronda.llm import packing
from ronda.llm.queries import BYTE_TOKENIZER, llm_queries


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTE_TOKENIZER)


def test_curve_visits_every_point_by_steps_of_one():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = packing.hilbert_key(points, bits)
        assert sorted(keys.tolist()) == list(range(1 << (dims * bits)))
        assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def check(pieces, rows, library, length=1024):
    """Every id lies in one piece, pieces of a sequence are gapless, and only the last sequence is not full."""
    whole = {}
    for i, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        whole.setdefault(i, []).append(ids.tobytes())
    got, sequences = {}, {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert len(p.ids) == 4 * p.length
    for i, texts in whole.items():
        assert len(b"".join(b for _, b in sorted(got[i]))) == sum(map(len, texts))
        if len(texts) == 1:
            assert b"".join(b for _, b in sorted(got[i])) == texts[0]
    assert set(got) == set(whole)
    fill = {}
    for s, parts in sequences.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        fill[s] = at
    assert all(n == length for s, n in fill.items() if s != max(fill))


def test_odd_documents(odd, library):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    check(packing.packed(odd, BYTE_TOKENIZER).collect(), rows, library)
    check(packing.packed(odd, BYTE_TOKENIZER, length=7).collect(), rows, library, 7)
    assert packing.packed(odd.limit(0), BYTE_TOKENIZER).count() == 0


def test_long_runs_of_white_space(docs, library, monkeypatch):
    blank = " " * 1_200_000
    rows = [(1, blank + "a"), (2, "x" + "\n" * 1_200_000 + "1"), (3, "a b " + blank)]
    check(packing.packed(docs(*rows), BYTE_TOKENIZER).collect(), rows, library)
    # The same cut at short runs, where the pattern itself can be asked.
    with open(BYTE_TOKENIZER, encoding="utf-8") as f:
        definition = f.read()
    monkeypatch.setattr(packing, "LONG_RUN", re.compile(packing.LONG_RUN.pattern.replace("10000", "2")))
    encode, rng = packing.byte_bpe(definition), np.random.default_rng(5)
    parts = [" ", "  ", "\n", "\t ", "\u3000", "\x1c", "\xa0 ", "a", "B1", "!", "'s", "<|endoftext|>", "\u00e9"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, rng.integers(1, 9)))
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_copies_lie_next_to_each_other(docs):
    base = [f"w{k} " * 20 for k in range(60)]
    rows = [(100 * k + c, "".join(base[k : k + 3])) for k in range(40) for c in range(3)]
    pieces = packing.packed(docs(*rows), BYTE_TOKENIZER, length=4096).orderBy("sequence_id", "offset").collect()
    order = [p.doc_id // 100 for p in pieces if p.start == 0]
    assert sum(a == b for a, b in zip(order, order[1:], strict=False)) >= 60


def test_query(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in llm_queries()["op4_packing"](spark, sf_dir).collect():
        ids = [*library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 0]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
