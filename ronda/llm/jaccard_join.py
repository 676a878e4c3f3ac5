"""N-gram Jaccard join: size-banded tiles, bitmap bounds, exact intersection.

Documents are sets of hashed word shingles.  Two sets with a Jaccard
similarity of ``percent`` / 100 or more share one of the first
``n - ceil(percent n / 100) + 1`` elements of each set, in any order that all
sets agree on; here shingles that many documents share come last, the others
in order of their hash.  Sets that share such an element and have sizes within
the same band form a tile.  What two sets have in common begins at the first
element that they share, so its place in both bounds the overlap: a tile leaves
out the pairs of which it cannot be the first.  The bit counts of two hashed
bitmaps bound the overlap too; pairs that pass are intersected exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ronda.llm.components import connected_components
from ronda.llm.store import partitions, stored
from ronda.llm.texts import LOWER, SPACE, Hashes, chunks, mix, rows_of, spans

COARSE_BITS = 1024, 4096  # least and most of the bitmaps that all candidates are held against; one for each element between
FINE_BITS = 2  # bits for each element, at least, of those that large sets are held against then
SHARED_PART = 0.001  # a shingle in this part of a task's documents counts as shared by many
SHARED_LEAST = 8
SHARED_MOST = 250_000  # longest list sent to all tasks; the list only changes the order
BLOCK = 1024  # members of a tile that one step compares
BLOCK_ELEMENTS = 1 << 22  # elements that these have about, so that long texts make smaller blocks
SALTS = 16
BROADCAST_ROWS = 1_000_000  # ids sent to all tasks at most; beyond that they are joined by shuffle

_FACTORS = np.random.default_rng(31).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def shingle_hashes(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, row by row."""
    for first, end, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends = spans(~SPACE[data], offsets)
        hashed = Hashes(data).of(starts, ends)
        bounds = np.searchsorted(starts, offsets)
        count = len(hashed)
        rolled = np.zeros(max(0, count - words + 1), np.uint64)
        for k in range(words):
            rolled += hashed[k : k + len(rolled)] * _FACTORS[k]
        rolled = mix(rolled)
        for i in range(end - first):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= words:
                yield np.unique(rolled[lo : hi - words + 1])
            elif hi > lo:
                short = np.append(hashed[lo:hi] * _FACTORS[: hi - lo], _FACTORS[62:63] * np.uint64(hi - lo))
                yield mix(short.sum(dtype=np.uint64, keepdims=True))
            else:
                yield hashed[:0]


def _signature(members: np.ndarray) -> int:
    """One number for a set: equal sets have equal numbers."""
    total = mix(members + np.uint64(len(members))).sum(dtype=np.uint64, keepdims=True)
    return int(mix(total).view(np.int64)[0])


def _bitmap(members: np.ndarray) -> bytes:
    """Parity of the members that fall on each bit: two bitmaps differ in no more bits than the sets in members."""
    bits = max(COARSE_BITS[0], 1 << int(FINE_BITS * len(members) - 1).bit_length())
    parity = np.bincount((members >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def _rows_of_bits(bitmaps: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bitmaps), np.uint64).reshape(len(bitmaps), -1)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps brought down to ``width`` words; parities of bits that meet are added."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _coarse(bitmap: bytes) -> bytes:
    """At half the width of a fine one, within the bounds."""
    bits = int(np.clip(8 * len(bitmap) // FINE_BITS, *COARSE_BITS))
    return _folded(_rows_of_bits([bitmap]), bits // 64).tobytes()


def _possible(n: np.ndarray, m: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of n and m elements, of which at least ``apart`` are not shared, can reach the similarity."""
    most = (n + m - apart) // 2
    return 100 * most >= percent * (n + m - most)


def _needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def _head(members: np.ndarray, shared: np.ndarray, percent: int) -> np.ndarray:
    """The elements of which similar sets share one, in the order that all sets agree on."""
    size = len(members) - _needed(len(members), percent) + 1
    if not len(shared):
        return members[:size]
    common = _within(shared, members)
    rare = members[~common]
    return rare[:size] if len(rare) >= size else np.concatenate([rare, members[common][: size - len(rare)]])


def _reach(size: np.ndarray, late: np.ndarray, percent: int) -> np.ndarray:
    """Size of the largest set that one of ``size`` elements can be similar to, if ``late`` 256ths of these or more
    come before the first that both have: the overlap ends with the rest."""
    rest = size + (-late * size // 256)
    return (100 + percent) * rest // percent - size


def shared_shingles(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """Hashes of shingles that many documents of some task share, at most ``SHARED_MOST``.

    Every document is read.  Tasks send only what is frequent among their own
    documents, and counts are added up before the most frequent are taken.  The
    list decides the order of elements and nothing else: results are the same
    for any list.
    """

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, counts, docs_seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for batch in batches:
            sets = list(shingle_hashes(batch.column(0), words))
            docs_seen += len(sets)
            found, times = np.unique(np.concatenate(sets), return_counts=True) if sets else (kept[:0], counts[:0])
            often = times >= max(2, SHARED_PART * len(sets) / 2)
            both, where = np.unique(np.concatenate([kept, found[often]]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, times[often]]), len(both)).astype(np.int64)
            kept = both
            if len(kept) > 4 * SHARED_MOST:
                top = np.sort(np.argpartition(-counts, SHARED_MOST)[:SHARED_MOST])
                kept, counts = kept[top], counts[top]
        often = counts >= max(SHARED_LEAST, SHARED_PART * docs_seen)
        yield pa.RecordBatch.from_arrays([pa.array(kept[often].view(np.int64)), pa.array(counts[often])], ["h", "times"])

    counted = docs.select(text_col).mapInArrow(frequent, "h long, times long").groupBy("h").agg(F.sum("times").alias("times"))
    top = counted.orderBy(F.desc("times"), "h").limit(SHARED_MOST).select("h").toPandas()["h"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


_FEATURES = "sig long, size int, coarse binary, fine binary"


def featurised(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(id, sig, size, coarse, fine) per document.

    Sets that a task met before carry no bitmaps, and small ones no fine bitmap,
    which would be the coarse one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            sigs, sizes, coarse, fine = [], [], [], []
            named = batch.column(0).is_valid().to_pylist()
            for members, has_id in zip(shingle_hashes(batch.column(1), words), named, strict=True):
                sizes.append(len(members))
                sig = _signature(members) if len(members) else None
                sigs.append(sig)
                if sig is None or not has_id or sig in met:
                    coarse.append(None)
                    fine.append(None)
                else:
                    met.add(sig)
                    bitmap = _bitmap(members)
                    coarse.append(_coarse(bitmap))
                    fine.append(bitmap if len(bitmap) > COARSE_BITS[0] // 8 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sigs, pa.int64()), pa.array(sizes, pa.int32()), *(pa.array(x, pa.binary()) for x in (coarse, fine))],
                ["id", "sig", "size", "coarse", "fine"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), text_col).mapInArrow(run, "id long, " + _FEATURES)


def _elements(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, shared: np.ndarray) -> DataFrame:
    """(salt, key, size_late, sig) for every element of every head; only shared shingles are salted.

    ``size_late`` holds the size of the set and, in its last 8 bits, in how many
    256ths of the set the element comes.  The columns are in the order that
    packs best: what rows of one set have in common comes in one piece.  Heads
    are made from the texts once more rather than stored.  A set that a task
    met before gives nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            heads, sigs, sizes = [np.zeros(0, np.uint64)], [], []
            for members in shingle_hashes(batch.column(0), words):
                sig = _signature(members) if len(members) else None
                if sig is not None and sig not in met:
                    met.add(sig)
                    heads.append(_head(members, shared, percent))
                    sigs.append(sig)
                    sizes.append(len(members))
            times = np.array([len(h) for h in heads[1:]], np.int64)
            key = np.concatenate(heads)
            sig = np.repeat(np.array(sigs, np.int64), times)
            salt = np.where(_within(shared, key), sig % SALTS, 0).astype(np.int32)
            size = np.repeat(np.array(sizes, np.int64), times)
            place = np.arange(len(key)) - np.repeat(np.cumsum(times) - times, times)
            size_late = size * 256 + 256 * place // size
            yield pa.RecordBatch.from_arrays(
                [pa.array(salt), pa.array(key.view(np.int64)), pa.array(size_late), pa.array(sig)],
                ["salt", "key", "size_late", "sig"],
            )

    texts = docs.where(F.col(id_col).isNotNull()).select(text_col)
    return texts.mapInArrow(run, "salt int, key long, size_late long, sig long")


_TILE = "kind int, key long, a long, b long, size int"
PAIR, LEADER, MEMBER = 0, 1, 2


def _leaders(group: np.ndarray, size: np.ndarray, percent: int) -> np.ndarray:
    """Row of the leader of each row; rows are sorted by group and size.

    The first of a group leads all whose size is within the band that it
    begins; the first beyond it begins the next band.
    """
    at = np.arange(len(group))
    fresh = np.ones(len(group), bool)
    fresh[1:] = group[1:] != group[:-1]
    lead = np.maximum.accumulate(np.where(fresh, at, 0))
    while True:
        outside = percent * size.astype(np.int64) > 100 * size[lead].astype(np.int64)
        if not outside.any():
            return lead
        first = outside.copy()
        first[1:] &= ~(outside[:-1] & (lead[1:] == lead[:-1]))
        lead = np.where(outside, np.maximum.accumulate(np.where(first, at, 0)), lead)


def _largest(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Largest of values[begin:end] for each pair of bounds, -1 where there is none."""
    found, length = np.full(len(begin), -1), end - begin
    width, largest = 1, values  # of the values from each on, as many as width
    while (length >= width).any():
        at = np.flatnonzero((length >= width) & (length < 2 * width))
        found[at] = np.maximum(largest[begin[at]], largest[end[at] - width])
        largest = np.maximum(largest[:-width], largest[width:])
        width *= 2
    return found


def _left(group: np.ndarray, size: np.ndarray, reach: np.ndarray, led: np.ndarray, percent: int) -> np.ndarray:
    """Whether a row has a partner within the reach of both that is not its leader, nor led by it.

    Rows are sorted by group and size.  All partners of a leader that are
    larger are led by it, so the smaller row of such a pair is led itself.
    """
    row, begin = np.arange(len(group)), group << 32
    at = begin + size
    end = np.searchsorted(at, begin + np.minimum(reach, (1 << 32) - 1), "right")
    least = np.searchsorted(at, begin - (-percent * size // 100), "left")
    as_larger = _largest(np.where(led, reach, -1), least, np.minimum(row, end)) >= size
    return as_larger | (led & (_largest(reach, row + 1, end) >= size))


def _within(sorted_values: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(sorted_values, values), len(sorted_values) - 1)
    return sorted_values[at] == values


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns of sorted rows, cut only where the first ``keys`` columns change."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        same = np.logical_and.reduce([x == x[-1] for x in now[:keys]])
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if not cut and kept and any(x[0] != y[-1] for x, y in zip(now[:keys], kept[-1][:keys], strict=True)):
            yield [np.concatenate(x) for x in zip(*kept, strict=True)]
            kept = []
        if cut:
            yield [np.concatenate(x) for x in zip(*kept, [x[:cut] for x in now], strict=True)]
            kept = []
        kept.append([x[cut:] for x in now])
    if kept:
        yield [np.concatenate(x) for x in zip(*kept, strict=True)]


def _tiles(elements: DataFrame, percent: int, shared: np.ndarray, spread: int) -> DataFrame:
    """Pairs with the leader of their tile, leaders of salted keys, and members that are left with other pairs.

    A pair of similar sets is left in the tile of the first element that both
    have, or is one with a leader there.  The tile of a salted key is in parts,
    so that all its members are left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for salt, key, size_late, sig in runs(batches, 2):
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1]) & (sig[1:] == sig[:-1])
            key, salt, size, late, sig = key[~again], salt[~again], size_late[~again] >> 8, size_late[~again] & 255, sig[~again]
            turn = np.zeros(len(key), bool)
            turn[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1])
            group = np.cumsum(turn)
            lead = _leaders(group, size, percent)
            led = lead != np.arange(len(key))
            hot = _within(shared, key.view(np.uint64))
            left = hot.copy()
            many = np.flatnonzero((np.bincount(group)[group] >= 3) & ~hot)
            left[many] = _left(group[many], size[many], _reach(size[many], late[many], percent), led[many], percent)
            parts = [(PAIR, led, sig[lead]), (LEADER, hot & ~led, sig), (MEMBER, left, sig)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(int(m.sum()), kind, np.int32) for kind, m, _ in parts])),
                    pa.array(np.concatenate([key[m] for _, m, _ in parts])),
                    pa.array(np.concatenate([a[m] for _, m, a in parts])),
                    pa.array(np.concatenate([sig[m] for _, m, _ in parts])),
                    pa.array(np.concatenate([size[m] for _, m, _ in parts]).astype(np.int32)),
                ],
                ["kind", "key", "a", "b", "size"],
            )

    dealt = elements.repartition(spread, "key", "salt").sortWithinPartitions("key", "salt", "size_late", "sig")
    return dealt.mapInArrow(run, _TILE)


def _pairs(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and bitmaps allow the similarity, with the ids that stand for them.

    All pairs are held against the coarse bitmaps, and what is left of the large
    sets, which fill these, against the fine ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in (4, 5))
            keep = percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)
            maps = [batch.column(k).to_pylist() for k in (6, 7)]
            widths = [np.array([len(x or b"") for x in m], np.int64) for m in maps]
            for wa, wb in {*zip(*(w[keep].tolist() for w in widths), strict=True)}:
                if not wa or not wb:
                    continue
                at = np.flatnonzero(keep & (widths[0] == wa) & (widths[1] == wb))
                pair = [_folded(_rows_of_bits([m[i] for i in at]), min(wa, wb) // 8) for m in maps]
                apart = np.bitwise_count(pair[0] ^ pair[1]).sum(1, dtype=np.int64)
                keep[at] = _possible(na[at], nb[at], apart, percent)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(keep))

    for bitmap in ("coarse", "fine"):
        sides = [
            nodes.select(F.col("sig").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "size")), F.col(bitmap).alias(f"map_{s}"))
            for s in ("a", "b")
        ]
        met = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b")
        pairs = met.select("a", "b", "rep_a", "rep_b", "size_a", "size_b", "map_a", "map_b").mapInArrow(
            run, "a long, b long, rep_a long, rep_b long"
        )
        pairs = stored(pairs, "bounded")
    return pairs


def _members(wanted: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(sig, members) of the sets named by ``wanted`` (rep, sig), from the texts of the documents that stand for them."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(_signature(m), m.tobytes()) for m in shingle_hashes(batch.column(0), words) if len(m)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _ in found], pa.int64()), pa.array([m for _, m in found], pa.binary())], ["sig", "members"]
            )

    reps = wanted.select(F.col("rep").alias("_rep"))
    if wanted.count() <= BROADCAST_ROWS:
        reps = F.broadcast(reps)
    own = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    texts = own.join(reps, F.col("_id") == F.col("_rep"), "left_semi").select("_text")
    return stored(texts.mapInArrow(sets, "sig long, members binary"), "members").dropDuplicates(["sig"])


def _linked(candidates: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """Candidates whose exact intersection reaches the similarity: (a, b)."""
    ends = candidates.select(F.col("rep_a").alias("rep"), F.col("a").alias("sig")).union(candidates.select("rep_b", "b"))
    members = _members(stored(ends.distinct(), "wanted"), docs, id_col, text_col, words)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    with_a = candidates.select("a", "b").join(members.select(F.col("sig").alias("a"), F.col("members").alias("of_a")), "a")
    with_b = with_a.join(members.select(F.col("sig").alias("b"), F.col("members").alias("of_b")), "b")
    return with_b.select("a", "b", "of_a", "of_b").mapInArrow(exact, "a long, b long")


def _candidates(n: np.ndarray, root: np.ndarray, part: np.ndarray | None, maps: list[bytes], percent: int) -> tuple[np.ndarray, ...]:
    """(i, j, apart) of the pairs that sizes and bitmaps allow, among rows sorted by size and so by the width of their
    bitmaps; of different components, and of different parts if parts are given."""
    found = [(np.zeros(0, np.int64),) * 3]
    widths = np.array([len(m) // 8 for m in maps])
    bits = {}
    for width in np.unique(widths):
        at = np.flatnonzero((widths >= width) & (widths <= 2 * width))
        wide = [_folded(_rows_of_bits([maps[k] for k in at[widths[at] == w]]), width) for w in np.unique(widths[at])]
        bits[width] = at[0], np.concatenate(wide)
    ends = np.searchsorted(n, 100 * n // percent, "right")  # first row that is too large for each
    for i in range(len(n) - 1):
        others = np.arange(i + 1, ends[i])
        ok = root[others] != root[i]
        if part is not None:
            ok &= part[others] != part[i]
        others = others[ok]
        if len(others):
            first, own = bits[widths[i]]
            apart = np.bitwise_count(own[others - first] ^ own[i - first]).sum(1, dtype=np.int64)
            met = _possible(n[others], n[i], apart, percent)
            found.append((np.full(met.sum(), i), others[met], apart[met]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _blocks(columns: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Begin and end of the rows of each (key, lo, hi)."""
    turn = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:3]])) + 1
    yield from zip([0, *turn], [*turn, len(columns[0])], strict=True)


def _find(above: list[int], k: int) -> int:
    """Representative of k in a union-find."""
    while above[k] != k:
        above[k] = above[above[k]]
        k = above[k]
    return k


def _in_blocks(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (key, sig, ...) once for each pair (lo, hi) of blocks of their key that holds their own block, ``mine``."""
    mine = F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")
    dealt = rows.join(blocks, "key").withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in rows.columns if c != "key"]
    return dealt.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", *rest)


def _block_count(n: Column, elements: Column) -> Column:
    return F.ceil(F.greatest(n / BLOCK, elements / BLOCK_ELEMENTS)).cast("int").alias("blocks")


def _still_open(members: DataFrame, roots: DataFrame, nodes: DataFrame, percent: int, spread: int) -> DataFrame:
    """(a, b): of all pairs of members (key, b, size) of a tile that are not connected and that sizes and bitmaps allow,
    enough to join the same sets as all of them do.

    Tiles are cut into blocks by hash and every pair of blocks is compared, so
    that no task meets more than two blocks of a tile at a time.  Tiles of the
    same members are one.  A pair of blocks gives fewer pairs than members.
    Bitmaps are sent for members of tiles that are open, and for no others.
    """
    named = members.join(roots.withColumnRenamed("node", "b"), "b", "left").select(
        "key", F.col("b").alias("sig"), F.coalesce("root", "b").alias("root"), "size"
    )
    named = stored(named, "tiles")
    open_keys = (
        named.groupBy("key")
        .agg(
            F.min("root").alias("lo"),
            F.max("root").alias("hi"),
            F.count("*").alias("n"),
            F.sum("size").alias("elements"),
            F.bit_xor(F.xxhash64("sig")).alias("x"),
            F.bit_xor(F.xxhash64("sig", F.lit(1))).alias("y"),
        )
        .where("lo <> hi")
        .groupBy("n", "elements", "x", "y")
        .agg(F.min("key").alias("key"))
    )
    open_keys = stored(open_keys.select("key", _block_count(F.col("n"), F.col("elements"))), "open")
    bits = nodes.select("sig", F.coalesce("fine", "coarse").alias("bits"))
    dealt = _in_blocks(named, open_keys).join(bits, "sig").select("key", "lo", "hi", "mine", "sig", "root", "size", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs(batches, 3):
            _, lo, hi, mine, sig, root, size, bits = columns
            joined = []
            for s, e in _blocks(columns):
                order = s + np.argsort(size[s:e], kind="stable")
                part = mine[order] if lo[s] != hi[s] else None
                i, j, _ = _candidates(size[order].astype(np.int64), root[order], part, [bits[k] for k in order], percent)
                above = list(range(e - s))
                for u, v in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = _find(above, u), _find(above, v)
                    if x != y:
                        above[x] = y
                        joined.append((sig[order[u]], sig[order[v]]))
            a, b = np.array(joined, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    by = ["key", "lo", "hi"]
    met = dealt.repartition(spread, *by).sortWithinPartitions(*by, "sig")
    return stored(met.mapInArrow(run, "a long, b long").distinct(), "still_open")


def _joining(open_sets: DataFrame, members: DataFrame, percent: int, spread: int) -> DataFrame:
    """(a, b): links that join components among the sets (key, sig, root, size) of each key, by exact intersection.

    Keys are cut into blocks like tiles.  A pair that is joined already, by its
    components or by links found before in the same task, is not intersected;
    so there are fewer links than sets in a pair of blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in runs(batches, 3):
            _, lo, hi, mine, sig, root, held = columns
            links = []
            for s, e in _blocks(columns):
                sets = [np.frombuffer(held[k], np.uint64) for k in range(s, e)]
                sizes = np.array([len(x) for x in sets], np.int64)
                order = np.argsort(sizes, kind="stable")
                sets = [sets[k] for k in order]
                part = mine[s:e][order] if lo[s] != hi[s] else None
                _, own = np.unique(root[s:e][order], return_inverse=True)
                i, j, apart = _candidates(sizes[order], own, part, [_bitmap(x) for x in sets], percent)
                above = list(range(int(own.max()) + 1))
                for k in np.argsort(apart, kind="stable"):
                    u, v = _find(above, int(own[i[k]])), _find(above, int(own[j[k]]))
                    if u == v:
                        continue
                    x, y = sets[i[k]], sets[j[k]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        above[u] = v
                        links.append((sig[s + order[i[k]]], sig[s + order[j[k]]]))
            a, b = np.array(links, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    by = ["key", "lo", "hi"]
    counts = open_sets.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("elements"))
    blocks = counts.select("key", _block_count(F.col("n"), F.col("elements")))
    dealt = _in_blocks(open_sets.select("key", "sig", "root"), blocks).join(members, "sig")
    dealt = dealt.select(*by, "mine", "sig", "root", "members")
    return dealt.repartition(spread, *by).sortWithinPartitions(*by, "sig").mapInArrow(run, "a long, b long").distinct()


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80
) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of ``docs``.

    A text, in lower case (A-Z), is a set of ``words`` consecutive words; with
    fewer words, the whole sequence; a null or empty text is the empty set and
    is linked with nothing.  Sets link when 100 |both| >= percent |either|.
    component_id is the smallest id that links reach; rows that repeat an id
    are members of that id's group by their own text.  A null id keeps its row
    and its n_shingles, links with nothing, and has a null component_id.
    Shingles are compared by 64-bit hashes.  Other columns are ignored.
    """
    spark = docs.sparkSession
    spread = 2 * partitions(spark)
    shared = shared_shingles(docs, text_col, words)
    featured = stored(featurised(docs, id_col, text_col, words), "sets")
    nodes = stored(
        featured.where("sig is not null and id is not null")
        .groupBy("sig")
        .agg(F.min("id").alias("rep"), F.max("size").alias("size"), F.max("coarse").alias("coarse"), F.max("fine").alias("fine")),
        "nodes",
    )
    tiles = stored(_tiles(_elements(docs, id_col, text_col, words, percent, shared), percent, shared, spread), "tiles")
    leaders = tiles.where(F.col("kind") == LEADER).select(
        F.lit(0).alias("salt"), "key", (F.col("size").cast("long") * 256).alias("size_late"), F.col("a").alias("sig")
    )
    between = _tiles(leaders, percent, shared[:0], spread).where(F.col("kind") == PAIR)
    tried = stored(
        tiles.where(F.col("kind") == PAIR).union(between).select(*_pairs(F.col("a"), F.col("b"))).distinct(), "tried"
    )
    known = _bounded(tried, nodes, percent)
    links = stored(_linked(known, docs, id_col, text_col, words, percent), "linked")
    roots = connected_components(links)
    members = tiles.where(F.col("kind") == MEMBER).select("key", "b", "size")
    # What is open after the leaders.  Sets that pairs allowed by the bitmaps connect, over all tiles, are compared once,
    # so that a set is sent once and not for every tile that it shares with another.
    still_open = _still_open(members, roots, nodes, percent, spread)
    if still_open.limit(1).count():
        open_sets = connected_components(still_open).select(F.col("node").alias("sig"), F.col("root").alias("key"))
        known_roots = roots.select(F.col("node").alias("sig"), "root")
        open_sets = (
            open_sets.join(known_roots, "sig", "left")
            .join(nodes.select("sig", "rep", "size"), "sig")
            .select("key", "sig", F.coalesce("root", "sig").alias("root"), "rep", "size")
        )
        open_sets = stored(open_sets, "open_sets")
        held = _members(open_sets.select("rep", "sig"), docs, id_col, text_col, words)
        links = stored(links.union(_joining(open_sets, held, percent, spread)), "linked")
        roots = connected_components(links)
    roots = roots.withColumnRenamed("node", "sig")
    named = nodes.select("sig", "rep").join(roots, "sig", "left").select("sig", "rep", F.coalesce("root", "sig").alias("root"))
    named = stored(named, "named")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = stored(named.join(least, "root").select("sig", "component_id"), "classes")
    return featured.select("id", "sig", "size").join(classes, "sig", "left").select(
        F.col("id").alias(id_col),
        F.col("size").cast("long").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"),
    )

