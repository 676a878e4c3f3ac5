"""Hard-negative mining: exact integer products of tiles by Strassen, and heaps that merge.

Vectors are integers.  Anchors and candidates are cut into tiles; a task meets
one tile of anchors and, one after another, the candidate tiles of one stripe.
The products of two tiles come from Strassen's recursion on int64 matrices
that are padded with zeros to even sides at every level; it adds and
subtracts integers only, so scores are exact.  What a task keeps of them are
heaps of the best rows for each anchor, or for each window of an anchor, and
heaps of several tasks are merged by score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ronda.llm.store import partitions, stored

LEAF = 32  # sides up to which a product is taken directly
ANCHOR_ROWS = 512
TILE_ROWS = 2048
STRIPE_TILES = 8  # candidate tiles that one task meets for a tile of anchors
BOUND = 2**63 - 1  # scores are held within this, both ways

_TILE = "tile long, ids binary, labels binary, width int, vectors binary"


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _even(x: np.ndarray) -> np.ndarray:
    """Padded with zeros to even sides."""
    rows, columns = x.shape
    return np.pad(x, ((0, rows % 2), (0, columns % 2))) if rows % 2 or columns % 2 else x


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """a @ b for integer matrices, with seven products of halves instead of eight.

    Works modulo 2**64 on int64, as its additions do: right wherever the
    product itself fits, and for matrices of Python integers always.
    """
    if min(*a.shape, b.shape[1]) <= leaf:
        return a @ b if a.dtype == object or not a.size or not b.size else np.einsum("ij,kj->ik", a, np.ascontiguousarray(b.T))
    rows, columns = a.shape[0], b.shape[1]
    a, b = _even(a), _even(b)
    i, j, k = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :k], b[:j, k:], b[j:, :k], b[j:, k:]
    m1 = strassen(a11 + a22, b11 + b22, leaf)
    m2 = strassen(a21 + a22, b11, leaf)
    m3 = strassen(a11, b12 - b22, leaf)
    m4 = strassen(a22, b21 - b11, leaf)
    m5 = strassen(a11 + a12, b22, leaf)
    m6 = strassen(a21 - a11, b11 + b12, leaf)
    m7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * k), a.dtype)
    out[:i, :k] = m1 + m4 - m5 + m7
    out[:i, k:] = m3 + m5
    out[i:, :k] = m2 + m4
    out[i:, k:] = m1 - m2 + m3 + m6
    return out[:rows, :columns]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``; the narrower is padded with zeros."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    largest = [max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0 for x in (a, b)]
    if largest[0] * largest[1] * width <= BOUND:
        return strassen(a, b.T)
    exact = strassen(a.astype(object), b.T.astype(object))
    return np.clip(exact, -BOUND, BOUND).astype(np.int64)


def best(scores: np.ndarray, allowed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``most`` largest allowed scores of each row; of equal ones the first columns."""
    held = np.where(allowed, scores, -BOUND - 1)
    left = allowed.sum(1)
    rows, columns = [], []
    at = np.arange(len(scores))
    for _ in range(min(most, scores.shape[1])):
        at = at[left[at] > 0]
        if not len(at):
            break
        column = held[at].argmax(1)
        held[at, column] = -BOUND - 1
        left[at] -= 1
        rows.append(at)
        columns.append(column)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(columns)


def _rows_of(column: pa.Array) -> np.ndarray:
    """Lists of integers as the rows of a matrix; shorter ones are padded with zeros."""
    ends = np.asarray(column.offsets, np.int64)
    values, widths = column.values.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends)
    matrix = np.zeros((len(widths), int(widths.max(initial=0))), np.int64)
    matrix[np.arange(matrix.shape[1])[None, :] < widths[:, None]] = values[ends[0] : ends[-1]]
    return matrix


def tiles(rows: DataFrame, count: int) -> DataFrame:
    """Rows (id, label, vector) as ``count`` matrices, numbered from 0, each sorted by id.

    Ids are unique, so their hashes deal them out evenly.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def tile(part: pa.Table) -> pa.RecordBatch:
            matrix = _rows_of(part.column(3).combine_chunks())
            columns = [[part.column(0)[0].as_py()], *([np.asarray(part.column(k), np.int64).tobytes()] for k in (1, 2)), [matrix.shape[1]], [matrix.tobytes()]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tile", "ids", "labels", "width", "vectors"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            kept = now if kept is None else pa.concat_tables([kept, now])
            number = kept.column(0).to_numpy()
            begins = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1)]
            for s, e in zip(begins, begins[1:], strict=False):
                yield tile(kept.slice(s, e - s))
            kept = kept.slice(begins[-1])
        if kept is not None:
            yield tile(kept)

    numbered = rows.select(tile_of("id", count).alias("tile"), "id", "label", "vector")
    dealt = numbered.repartition(partitions(rows.sparkSession), "tile").sortWithinPartitions("tile", "id")
    return stored(dealt.mapInArrow(run, _TILE), "tiles")


def tile_of(id_col: str, count: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(count).cast("long"))


def _matrix(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
    return ids, labels, np.frombuffer(row["vectors"], np.int64).reshape(len(ids), row["width"])


Heaps = list[np.ndarray]


def _met(
    anchors: DataFrame,
    anchor_tiles: int,
    candidates: DataFrame,
    stripes: int,
    visit: Callable[[tuple, list[dict] | None, tuple], Heaps],
    merge: Callable[[Heaps, Heaps], Heaps],
    names: list[str],
) -> DataFrame:
    """Every tile of anchors with every candidate tile: what ``merge`` keeps of what ``visit`` finds, per stripe.

    A tile of anchors goes to each stripe, a candidate tile to each tile of
    anchors, so that a task holds one of either at a time.
    """
    columns = ["tile", "ids", "labels", "width", "vectors"]
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    own = anchors.select(F.col("tile").alias("at"), every(stripes).alias("stripe"), F.lit(0).alias("kind"), *columns, "asked")
    none = F.lit(None).cast(anchors.schema["asked"].dataType)
    other = candidates.select(every(anchor_tiles).alias("at"), F.pmod("tile", F.lit(stripes)).alias("stripe"), F.lit(1).alias("kind"), *columns, none.alias("asked"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found, key = None, None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if key != (row["at"], row["stripe"]):
                    if found is not None:
                        yield _batch(found, names)
                    key, own, found = (row["at"], row["stripe"]), None, None
                if not row["kind"]:
                    own = (_matrix(row), row["asked"])
                elif own is not None:
                    more = visit(*own, _matrix(row))
                    found = more if found is None else merge(found, more)
        if found is not None:
            yield _batch(found, names)

    by = ["at", "stripe"]
    dealt = own.unionByName(other).repartition(partitions(anchors.sparkSession), *by)
    return dealt.sortWithinPartitions(*by, "kind", "tile").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def _first(columns: list[np.ndarray], keys: int, most: int) -> list[np.ndarray]:
    """The ``most`` rows of each key with the largest scores, ties by smaller id; columns are keys, score, id."""
    *by, score, other = columns
    order = np.lexsort((other, -score, *by[::-1]))
    columns = [c[order] for c in columns]
    begins = np.ones(len(order), bool)
    if len(order):
        begins[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns[:keys]])
    at = np.arange(len(order))
    kept = at - np.maximum.accumulate(np.where(begins, at, 0)) < most
    return [c[kept] for c in columns]


def mined(
    rows: DataFrame,
    every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    window: tuple[int, int] = (50, 95),
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "vector",
    anchor_rows: int = ANCHOR_ROWS,
    tile_rows: int = TILE_ROWS,
    stripe_tiles: int = STRIPE_TILES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``vector_col`` holds integers (array of long).  Anchors are the rows whose
    id is divisible by ``every``.  An anchor's positives are its first
    ``positives`` other rows of the same label by inner product, ties by
    smaller id.  For each of them come the first ``negatives`` rows of another
    label whose score lies between ``window`` percent of the positive's.

    Rows without id, label or vector, or with a null component take no part.
    Rows that share an id are one row: the smallest by label, then by vector.
    Shorter vectors are padded with zeros.  Scores beyond 64 bits are held at
    the bounds of 64 bits.  An empty table, and anchors without positives or
    without rows in the window, give no rows.  Other columns are ignored.
    """
    named = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("vector")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.coalesce(~F.exists("vector", lambda x: x.isNull()), F.lit(False)))
    single = stored(
        named.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector"), "vectors"
    )
    size = single.count()
    chosen = single.where(F.col("id") % every == 0)
    anchor_tiles, candidate_tiles = (max(1, -(-n // m)) for n, m in ((chosen.count(), anchor_rows), (size, tile_rows)))
    candidates = tiles(single, candidate_tiles)
    anchors = tiles(chosen, anchor_tiles)
    stripes = -(-candidate_tiles // stripe_tiles)

    def same_label(own: tuple, _: list[dict] | None, other: tuple) -> Heaps:
        ids, labels, vectors = own
        their, their_labels, theirs = other
        found: list[list[np.ndarray]] = [[], [], []]
        for label in np.intersect1d(labels, their_labels):
            mine, at = np.flatnonzero(labels == label), np.flatnonzero(their_labels == label)
            scores = products(vectors[mine], theirs[at])
            i, j = best(scores, ids[mine][:, None] != their[at][None, :], positives)
            for part, x in zip(found, (ids[mine[i]], scores[i, j], their[at[j]]), strict=True):
                part.append(x)
        return [np.concatenate([np.zeros(0, np.int64), *x]) for x in found]

    merged = lambda keys, most: lambda a, b: _first([np.concatenate(x) for x in zip(a, b, strict=True)], keys, most)
    asked = F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in ("anchor", "score", "other")]))
    nothing = F.when(F.lit(False), asked).alias("asked")
    near = _met(
        anchors.select("*", nothing), anchor_tiles, candidates, stripes, same_label, merged(1, positives), ["anchor", "score", "other"]
    )
    order = W.partitionBy("anchor").orderBy(F.desc("score"), "other")
    first = stored(near.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), "positives")

    # What the anchors of a tile ask for, beside the tile.
    windows = first.groupBy(tile_of("anchor", anchor_tiles).alias("tile")).agg(
        F.collect_list(F.struct("anchor", "score", "other")).alias("asked")
    )
    low, high = window

    def in_window(own: tuple, asked: list[dict] | None, other: tuple) -> Heaps:
        ids, labels, vectors = own
        their, their_labels, theirs = other
        found = [[np.zeros(0, np.int64)] for _ in range(5)]
        if not asked:
            return [x[0] for x in found]
        anchor, score, positive = (np.array([a[c] for a in asked], np.int64) for c in ("anchor", "score", "other"))
        scores = products(vectors, theirs)
        at = np.searchsorted(ids, anchor)
        # 100 s >= low p and 100 s <= high p, in Python's integers.
        least = np.array([max(-BOUND, -((-low * p) // 100)) for p in score.tolist()], np.int64)
        most = np.array([min(BOUND, high * p // 100) for p in score.tolist()], np.int64)
        block = max(1, (1 << 20) // max(1, len(their)))
        for s in range(0, len(asked), block):
            rows_, mine = at[s : s + block], scores[at[s : s + block]]
            ok = (labels[rows_][:, None] != their_labels[None, :]) & (mine >= least[s : s + block, None]) & (mine <= most[s : s + block, None])
            i, j = best(mine, ok, negatives)
            k = s + i
            for x, v in zip(found, (anchor[k], positive[k], score[k], mine[i, j], their[j]), strict=True):
                x.append(v)
        return [np.concatenate(x) for x in found]

    hard = _met(
        anchors.join(windows, "tile"),
        anchor_tiles,
        candidates,
        stripes,
        in_window,
        merged(3, negatives),
        ["anchor", "positive", "p_score", "score", "other"],
    )
    order = W.partitionBy("anchor", "positive").orderBy(F.desc("score"), "other")
    return hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("rank").cast("int").alias("rank"),
        F.col("other").alias("negative_id"),
        F.col("p_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def prepared(embeddings: DataFrame, relabel_every: int = 7, classes: int = 10, scale: int = 256) -> DataFrame:
    """Rows of ``embeddings`` for :func:`mined`: floored components, and another label where the id is divisible.

    Vectors with a component that is null, not finite, or beyond 64 bits when
    it is scaled take no part.
    """
    within = lambda x: F.coalesce(F.abs(x.cast("double")) * scale < F.lit(2.0**63), F.lit(False))
    wrong = F.col("vec_id") % relabel_every == 0
    label = F.when(wrong, (F.col("label") + 1) % classes).otherwise(F.col("label"))
    usable = embeddings.where(F.col("embedding").isNotNull() & F.forall("embedding", within))
    return usable.select("vec_id", label.alias("label"), quantised("embedding", scale).alias("vector"))
