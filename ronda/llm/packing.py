"""Packing of documents into training sequences along a space-filling curve.

A document's token ids are hashed into a vector, the vector is projected to a
few dimensions, and its place on a Hilbert curve through them is the sort key.
Documents are laid end to end in that order and the line is cut every
``length`` ids: neighbours on the curve share sequences, and no sequence but
the last one is padded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ronda.llm.store import partitions, stored

BUCKETS = 256  # width of the hashed vector
DIMS, BITS = 4, 12  # projected dimensions and bits of each
TIE_BITS = 15  # below the curve's key: a hash of the id spreads copies that share a key
SEPARATOR = 0
PART = 2000  # texts worked on together

# The pattern that byte-level BPE splits a text with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Runs of the pattern's white space that are cut out before a text is split.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and its byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def byte_bpe(definition: str) -> Callable[[str], list[int]]:
    """Encoder of a byte-level BPE tokenizer file, whose ids are in the order of its merges."""
    import tiktoken

    told = json.loads(definition)
    symbols = byte_symbols()
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    ranks = {bytes(symbols[c] for c in t): i for t, i in told["model"]["vocab"].items() if t not in special}
    coder = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def short(text: str) -> list[int]:
        if any(s in text for s in special):
            return coder.encode(text, allowed_special="all")
        return coder.encode_ordinary(text)

    def encode(text: str) -> list[int]:
        # A long run of white space is one piece but for its last character, or all of it before a special token or
        # the end.  The pattern's engine would overflow its stack on it.
        out, done = [], 0
        for run in LONG_RUN.finditer(text):
            end = run.end()
            if end < len(text) and not text.startswith(tuple(special), end):
                end -= 1
            out += short(text[done : run.start()]) + coder._encode_single_piece(text[run.start() : end])
            done = end
        return out + short(text[done:]) if done else short(text)

    return encode


def hilbert_key(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of each point (integers of ``bits`` bits per dimension) on the Hilbert curve.

    Coordinates are undone to Gray code from the highest bit down (Skilling's
    construction), and their bits are interleaved.
    """
    x = [points[:, k].astype(np.int64).copy() for k in range(points.shape[1])]
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for k in range(dims):
            high = (x[k] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[k]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[k] = x[k] ^ swap if k else x[k]
        q >>= 1
    for k in range(1, dims):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - 1, 0)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for k in range(dims):
            key = (key << 1) | (((x[k] ^ turn) >> b) & 1)
    return key


class Curve:
    """Keys of documents given as token ids."""

    def __init__(self, vocabulary: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bucket = rng.integers(0, BUCKETS, vocabulary)
        self.sign = rng.choice([-1.0, 1.0], vocabulary)
        self.project = rng.standard_normal((BUCKETS, DIMS))

    def keys(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(counts)), counts)
        flat = np.bincount(row * BUCKETS + self.bucket[ids], self.sign[ids], len(counts) * BUCKETS)
        vector = flat.reshape(len(counts), BUCKETS)
        vector = np.sign(vector) * np.sqrt(np.abs(vector))
        vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-12)
        place = 1 / (1 + np.exp(-2 * (vector @ self.project)))
        return hilbert_key(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def tokenised(docs: DataFrame, tokenizer: str, id_col: str, text_col: str) -> DataFrame:
    """(id, ids, n, key) per document; ids in 32 bits each, little-endian, the separator last."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(definition.value)
        told = json.loads(definition.value)
        curve = Curve(1 + max(*told["model"]["vocab"].values(), *(t["id"] for t in told["added_tokens"])))
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                found = [np.array([*encode(t.as_py() or ""), SEPARATOR], "<u4") for t in part.column(1)]
                counts = np.array([len(x) for x in found], np.int64)
                ends = np.cumsum(counts)
                flat = np.concatenate(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.Array.from_buffers(
                            pa.large_binary(), len(found), [None, pa.py_buffer(np.append(0, 4 * ends).astype(np.int64)), pa.py_buffer(flat)]
                        ).cast(pa.binary()),
                        pa.array(counts),
                        pa.array(curve.keys(flat, counts)),
                    ],
                    ["id", "ids", "n", "key"],
                )

    own = docs.select(F.col(id_col).cast("long").alias("id"), text_col)
    return own.mapInArrow(run, "id long, ids binary, n long, key long")


def laid_out(lengths: DataFrame, spread: int) -> DataFrame:
    """(row, begin): where each row of (row, id, n, key) begins on the line of all documents.

    Rows are sorted by range and summed up within each range; the sums of the
    ranges, one number each, are added up apart.
    """
    tie = F.pmod(F.xxhash64("id", "row"), F.lit(1 << TIE_BITS))
    keyed = lengths.withColumn("place", F.shiftleft("key", TIE_BITS).bitwiseOR(tie))
    dealt = keyed.repartitionByRange(spread, "place").sortWithinPartitions("place", "id", "row").select("row", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            begin = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(begin), batch.column(1)],
                ["row", "part", "local", "n"],
            )

    local = stored(dealt.mapInArrow(run, "row long, part int, local long, n long"), "lines")
    sums = sorted(tuple(r) for r in local.groupBy("part").agg(F.sum("n")).collect())  # one row per partition
    base, done = [], 0
    for part, n in sums:
        base.append((part, done))
        done += n
    bases = local.sparkSession.createDataFrame(base, "part int, base long")
    return local.join(F.broadcast(bases), "part").select("row", (F.col("base") + F.col("local")).alias("begin"))


def packed(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024
) -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset) per piece of a document.

    ``tokenizer`` is the file of a byte-level BPE; ``ids`` holds a piece's ids in
    32 bits each, little-endian.  A null text is an empty one, whose only id is
    the separator; rows that repeat an id, and rows whose id is null, are packed
    each for itself; an empty table gives no pieces; other columns are ignored.
    """
    spark = docs.sparkSession
    whole = stored(tokenised(docs, tokenizer, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "ids")
    begins = laid_out(whole.select("row", "id", "n", "key"), 2 * partitions(spark))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, begin = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            first, last = begin // length, (begin + n - 1) // length
            times = last - first + 1
            row = np.repeat(np.arange(len(n)), times)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            lo = np.maximum(sequence * length, begin[row])
            hi = np.minimum((sequence + 1) * length, (begin + n)[row])
            ids = batch.column(1)
            start = lo - begin[row]
            whole_ids = [memoryview(x.as_buffer()) for x in ids]
            pieces = [bytes(whole_ids[r][4 * s : 4 * e]) for r, s, e in zip(row, start, hi - begin[row], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row)),
                    pa.array(start),
                    pa.array(hi - lo),
                    pa.array(pieces, pa.binary()),
                    pa.array(n[row]),
                    pa.array(sequence),
                    pa.array(lo - sequence * length),
                ],
                ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    placed = whole.join(begins.hint("shuffle_hash"), "row").select("id", "ids", "n", "begin")
    out = placed.mapInArrow(
        run, "id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    )
    return out.withColumnRenamed("id", id_col)
