"""WARC archives: written as one gzip member per record, read back by byte ranges.

A reading task takes a range of a file, looks for the magic bytes of gzip in
it, and accepts a place as the beginning of a record only if a WARC record can
be decoded there and whole members follow one another from it to the end of
the range.  It owns the records that begin inside its range.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ronda.llm.store import new_path, partitions, stored

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 256 << 20  # a task begins a new archive beyond this size
SPLIT_BYTES = 32 << 20
LEAST_RANGES = 4  # of an archive, so that small ones are read by several tasks too
READ_BYTES = 1 << 18
FIRST_BYTES = 1 << 13  # read of a record at first; each further read is twice as long
HELD_BYTES = 16 << 20  # records decoded while a range is searched and kept until they are read; others are decoded again
ROW_BYTES = 1024  # of a record besides its payload, counted in the length of a batch
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32, from its hexadecimal digits in parts of five bytes."""
    parts = [
        F.translate(
            F.lpad(F.conv(F.substring(F.sha1(payload), at, 10), 16, 32), 8, "0"),
            "0123456789ABCDEFGHIJKLMNOPQRSTUV",
            "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
        )
        for at in (1, 11, 21, 31)
    ]
    return F.concat(*parts)


def with_revisits(pages: DataFrame, id_col: str, url_col: str, text_col: str, least_bytes: int) -> DataFrame:
    """(id, url, payload, digest, refers_to): refers_to is null for a response.

    Of equal payloads of ``least_bytes`` or more, rows with the smallest id are
    responses and the others revisit it, those without id too.  Payloads are
    compared by digest and length, and a payload that many pages share is
    joined in salted shares.
    """
    payload = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    own = own.withColumn("digest", base32_sha1(F.col("payload"))).withColumn("bytes", F.octet_length("payload"))
    own = own.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int"))
    firsts = (
        own.where(F.col("bytes") >= least_bytes)
        .groupBy("digest", "bytes")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select("digest", "bytes", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    return own.join(firsts, ["digest", "bytes", "salt"], "left").select(
        "id", "url", "payload", "digest", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def _urn(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _page(urn: str | None) -> int | None:
    name = "" if urn is None else urn.rpartition(":")[2].rstrip(">")
    return None if name in ("", "none") else int(name)


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP header without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(records: DataFrame, path: str) -> DataFrame:
    """Writes (id, url, payload, digest, refers_to) to archives in ``path``: (file, bytes, records, places).

    ``places`` are the bytes at which the records begin.  Every attempt of a task writes files of its own; the returned table, stored
    when the tasks have ended, names those of the attempts that counted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        out, name, done, places = None, "", 0, array("q")
        told = []
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                if out is None:
                    name, done, places = f"{uuid.uuid4().hex}.warc.gz", 0, array("q")
                    out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                member = record(*(x.as_py() for x in row))
                out.write(member)
                places.append(done)
                done += len(member)
                if done >= FILE_BYTES:
                    out.close()
                    told.append((name, done, places))
                    out = None
        if out is not None:
            out.close()
            told.append((name, done, places))
        names, sizes, begins = zip(*told, strict=True) if told else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{path}/{n}" for n in names], pa.string()),
                pa.array(sizes, pa.int64()),
                pa.array([len(x) for x in begins], pa.int64()),
                pa.array([np.frombuffer(x, np.int64) for x in begins], pa.list_(pa.int64())),
            ],
            ["file", "bytes", "records", "places"],
        )

    rows = records.select("id", "url", "payload", "digest", "refers_to")
    return stored(rows.mapInArrow(run, "file string, bytes long, records long, places array<long>"), "archives")


class Members:
    """Gzip members of a file, decoded at any place."""

    def __init__(self, source: pyarrow.NativeFile, size: int):
        self.source, self.size = source, size
        self.held: dict[int, tuple[bytes, int]] = {}

    def at(self, place: int) -> tuple[bytes, int] | None:
        """(content, end) of the whole member of one WARC record at ``place``; None if there is none."""
        return self.held.pop(place, None) or self._decoded(place)

    def _decoded(self, place: int) -> tuple[bytes, int] | None:
        unpacker, out, read, length = zlib.decompressobj(31), [], place, FIRST_BYTES
        try:
            while not unpacker.eof and read < self.size:
                self.source.seek(read)
                data = self.source.read(length)
                length = min(2 * length, READ_BYTES)
                out.append(unpacker.decompress(data))
                if read == place and not out[0].startswith(b"WARC/1."):
                    return None
                read += len(data)
        except zlib.error:
            return None
        content = b"".join(out)
        if not unpacker.eof or not _whole(content):
            return None
        return content, read - len(unpacker.unused_data)

    def candidates(self, start: int, end: int) -> Iterator[int]:
        """Places of the magic bytes that begin in a range."""
        tail, place = b"", start
        while place < end + len(MAGIC) - 1 and place < self.size:
            self.source.seek(place)
            data = tail + self.source.read(min(READ_BYTES, end + len(MAGIC) - 1 - place))
            base, found = place - len(tail), data.find(MAGIC)
            while found >= 0:
                yield base + found
                found = data.find(MAGIC, found + 1)
            place = base + len(data)
            tail = data[-(len(MAGIC) - 1) :]

    def first(self, start: int, end: int) -> int | None:
        """The first place of a range from which whole members lead to its end; holds what it decoded on the way."""
        broken: set[int] = set()
        for place in self.candidates(start, end):
            at, path, room = place, [], HELD_BYTES
            self.held.clear()
            while at < end and at < self.size and at not in broken:
                path.append(at)
                member = self._decoded(at)
                if member is None:
                    broken.update(path)
                    break
                if len(member[0]) <= room:
                    self.held[at] = member
                    room -= len(member[0])
                at = member[1]
            if at not in broken:
                return place
        return None


def _head(content: bytes) -> tuple[dict[str, str], int]:
    """(fields in lower case, where the block begins); no fields if the header does not end."""
    end = content.find(b"\r\n\r\n")
    if end < 0:
        return {}, 0
    fields = {}
    for line in content[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def _whole(content: bytes) -> bool:
    fields, begin = _head(content)
    length = fields.get("content-length", "")
    return length.isdigit() and len(content) == begin + int(length) + 4 and content.endswith(b"\r\n\r\n")


def ranges(archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(file, bytes, start, stop, places) of equal ranges of at most ``split_bytes``, four or more an archive."""
    step = F.least(F.lit(split_bytes).cast("long"), F.ceil(F.col("bytes") / LEAST_RANGES))
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, step))
    begins = F.col("places") if "places" in archives.columns else F.lit(None).cast("array<long>")
    rows = archives.where("bytes > 0").select("file", "bytes", step.alias("step"), starts.alias("start"), begins.alias("places"))
    return rows.select("file", "bytes", "start", F.least(F.col("start") + F.col("step"), "bytes").alias("stop"), "places")


def read_archives(archives: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the archives in (file, bytes), by ``ranges`` of at most ``split_bytes``.

    Returns (file, place, record_type, page_id, url, refers_to, payload_digest,
    payload_bytes, payload); payload is null for a revisit.  Without ``payloads``
    they are read and checked all the same, and that column is left out.  A response whose
    payload does not have its digest is an error, and so is a first range that
    does not begin with a whole record.  Where ``archives`` has the places of the
    records, so is a range in which other than these many are found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, start, stop, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = pyarrow.fs.FileSystem.from_uri(file)
                with fs.open_input_file(name) as source:
                    yield from _owned(Members(source, size), file, start, stop, count, schema)

    schema = _RECORD if payloads else _RECORD.remove(_RECORD.get_field_index("payload"))
    inside = F.filter("places", lambda p: (p >= F.col("start")) & (p < F.col("stop")))
    count = F.when(F.col("places").isNotNull(), F.size(inside))
    parts = ranges(archives, split_bytes).select("file", "bytes", "start", "stop", count.alias("count"))
    dealt = parts.repartition(4 * partitions(archives.sparkSession), "file", "start")
    return dealt.mapInArrow(run, ", ".join(f"{f.name} {_DDL[f.type]}" for f in schema))


_RECORD = pa.schema(
    [
        ("file", pa.string()),
        ("place", pa.int64()),
        ("record_type", pa.string()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("refers_to", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_DDL = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def _owned(
    members: Members, file: str, start: int, end: int, count: int | None, schema: pa.Schema = _RECORD
) -> Iterator[pa.RecordBatch]:
    place = members.first(start, end)
    if start == 0 and place != 0:
        raise ValueError(f"no whole record at byte 0 leads to byte {end} of {file}")
    rows, held, found = [], 0, 0
    while place is not None and place < end:
        member = members.at(place)
        if member is None:
            raise ValueError(f"no whole record at byte {place} of {file}")
        row = _parsed(member[0])
        if "payload" not in schema.names:
            row["payload"] = None
        rows.append({"file": file, "place": place, **row})
        held, found = held + len(row["payload"] or b"") + ROW_BYTES, found + 1
        place = member[1]
        if held > 4 << 20:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
            rows, held = [], 0
    if count is not None and found != count:
        raise ValueError(f"{found} records instead of {count} begin in bytes {start} to {end} of {file}")
    yield pa.RecordBatch.from_pylist(rows, schema=schema)


def _parsed(content: bytes) -> dict:
    fields, begin = _head(content)
    block = content[begin:-4]
    http, at = _head(block)
    digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
    payload = block[at:] if kind == "response" else None
    if payload is not None and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not have its digest")
    return {
        "record_type": kind,
        "page_id": _page(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "refers_to": _page(fields.get("warc-refers-to")),
        "payload_digest": digest,
        "payload_bytes": int(http["content-length"]),
        "payload": payload,
    }


def round_trip(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "html",
    least_bytes: int = 0,
    payloads: bool = True,
) -> DataFrame:
    """Writes a record per page to archives in the shared folder and reads them back.

    A null text is an empty payload, a null url leaves its field out; rows that
    repeat the smallest id of a payload are responses; a page without id is read
    back without one; an empty table has no archives and no records; other
    columns are ignored.
    """
    path = new_path(pages.sparkSession, "warc")
    written = write_archives(with_revisits(pages, id_col, url_col, text_col, least_bytes), path)
    return read_archives(written, payloads=payloads)
