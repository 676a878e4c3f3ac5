import base64
import gzip
import hashlib
import zlib

import pyarrow.fs
import pytest
from pyspark.sql import functions as F

from ronda.llm import warc
from ronda.llm.queries import llm_queries
from ronda.llm.store import new_path, prepare_workers


@pytest.fixture
def pages(spark):
    prepare_workers(spark)
    rows = [(i, f"http://h/{i} x\n", f"<p>{i}</p>" * (i % 50 + 1)) for i in range(60)]
    rows += [(100, None, "same"), (90, "u", "same"), (95, "u", "same"), (200, "u", None), (150, "u", "")]
    rows += [(None, "u", "same"), (None, "u", "alone"), (90, "u", "same"), (300, "u", "\x1f" + "é" * 200_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("x") for c in ("id", "digest", "bytes", "salt", "file", "place")})


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        lead = first.get(html or "")
        response = lead is None or i == lead
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((i, len(payload), digest, "response" if response else "revisit", None if response else lead))
    return sorted(out, key=repr)


def test_round_trip_without_payloads(pages):
    """The same records; payloads stay in the tasks that read them."""
    whole, bare = warc.round_trip(pages), warc.round_trip(pages, payloads=False)
    assert bare.columns == [c for c in whole.columns if c != "payload"]
    shown = [c for c in bare.columns if c not in ("file", "place")]
    assert sorted(map(str, whole.select(*shown).collect())) == sorted(map(str, bare.select(*shown).collect()))


def test_round_trip(pages):
    found = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    rows = pages.select("page_id", "url", "html").collect()
    assert sorted(map(tuple, found), key=repr) == expected([tuple(r) for r in rows])
    assert warc.round_trip(pages.limit(0)).count() == 0
    least = warc.round_trip(pages, least_bytes=1).where("page_id = 200").first()
    assert least.record_type == "response"


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_records_are_owned_once(spark, pages, split):
    records = warc.with_revisits(pages, "page_id", "url", "html", 0).coalesce(2)
    archives = warc.write_archives(records, new_path(spark, "warc"))
    read = warc.read_archives(archives, split).select("page_id", "payload").collect()
    want = sorted(repr(r.page_id) for r in pages.collect())
    assert sorted(repr(r.page_id) for r in read) == want


def test_archives_are_plain_gzip(spark, pages):
    archives = warc.write_archives(warc.with_revisits(pages, "page_id", "url", "html", 0), new_path(spark, "warc"))
    total = 0
    for row in archives.collect():
        fs, name = pyarrow.fs.FileSystem.from_uri(row.file)
        with fs.open_input_file(name) as f:
            data = f.read()
        assert len(data) == row.bytes
        total += gzip.decompress(data).count(b"WARC/1.1\r\n")
    assert total == pages.count()


class Source:
    """A file in memory."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def seek(self, place):
        self.at = place

    def read(self, n):
        out = self.data[self.at : self.at + n]
        self.at += len(out)
        return out


def test_an_archive_inside_a_record_is_not_taken_for_records():
    """The payload is itself an archive and is stored without compression, so its members are whole."""
    inner = b"".join(warc.record(i, "u", b"inner" * 50, "D", None) for i in range(30))
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    plain = zlib.decompress(warc.record(1, "u", inner, "D", None), 31)
    outer = packer.compress(plain) + packer.flush()
    tail = warc.record(2, "u", b"after", "D", None)
    data = outer + tail
    members = warc.Members(Source(data), len(data))
    for start in range(1, len(outer), 500):
        assert members.first(start, len(data)) == len(outer)


def test_a_damaged_archive_is_an_error(spark, tmp_path):
    prepare_workers(spark)
    good = warc.record(1, "u", b"payload", base64.b32encode(hashlib.sha1(b"payload").digest()).decode(), None)
    path = tmp_path / "a.warc.gz"
    path.write_bytes(good[:-6] + b"xxxxxx")
    archives = spark.createDataFrame([(f"file://{path}", len(good))], "file string, bytes long")
    with pytest.raises(Exception, match="no whole record"):
        warc.read_archives(archives).count()


@pytest.mark.parametrize("split", [1000, 1 << 20])
def test_urls_longer_than_any_header_bound(spark, split):
    """One in every third record, and those are not lost with the records before them."""
    prepare_workers(spark)
    rows = [(i, "http://h/" + ("\x01" * 30_000 if i % 6 else "u" * 90_000) if i % 3 == 0 else "u", f"text {i}" * 99) for i in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    archives = warc.write_archives(warc.with_revisits(pages, "page_id", "url", "html", 0), new_path(spark, "warc"))
    found = warc.read_archives(archives, split).select("page_id", "url").collect()
    assert sorted(map(tuple, found)) == [(i, u.replace("\x01", "%01")) for i, u, _ in rows]


def test_lost_records_are_an_error(spark, tmp_path):
    """A broken record in the second range hides those before it there."""
    prepare_workers(spark)
    digest = base64.b32encode(hashlib.sha1(b"payload").digest()).decode()
    members = [warc.record(i, "u", b"payload", digest, None) for i in range(9)]
    places = [sum(map(len, members[:i])) for i in range(9)]
    members[7] = members[7][:-6] + b"xxxxxx"
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(members))
    row = (f"file://{path}", sum(map(len, members)), 9, places)
    archives = spark.createDataFrame([row], "file string, bytes long, records long, places array<long>")
    with pytest.raises(Exception, match="records instead of"):
        warc.read_archives(archives, places[4]).count()


def test_ranges_of_the_query_begin_inside_records(spark, sf_dir):
    """So its records are found by the magic bytes of gzip, and every range is searched."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    prepare_workers(spark)
    archives = warc.write_archives(warc.with_revisits(pages, "page_id", "url", "html", 0), new_path(spark, "warc"))
    found = warc.ranges(archives).collect()
    assert found and all(r.start < r.stop <= r.bytes for r in found)
    assert any(r.start > 0 and r.start not in r.places for r in found)
    for row in archives.collect():
        of_file = sorted((r.start, r.stop) for r in found if r.file == row.file)
        assert len(of_file) >= min(4, row.bytes) and of_file[0][0] == 0 and of_file[-1][1] == row.bytes
        assert all(a[1] == b[0] for a, b in zip(of_file, of_file[1:], strict=False))


def test_records_too_large_to_hold_are_decoded_again(monkeypatch):
    monkeypatch.setattr(warc, "HELD_BYTES", 500)
    data = b"".join(warc.record(i, "u", b"payload" * (i * 9), "D", None) for i in range(9))
    members = warc.Members(Source(data), len(data))
    place = members.first(0, len(data))
    assert place == 0 and 0 < len(members.held) < 9
    found = 0
    while place < len(data):
        content, place = members.at(place)
        found += content.count(b"WARC/1.1\r\n")
    assert found == 9 and not members.held


def test_query(spark, sf_dir):
    found = llm_queries()["op2_warc"](spark, sf_dir).collect()
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()
    assert sorted(map(tuple, found), key=repr) == expected([tuple(r) for r in rows])
