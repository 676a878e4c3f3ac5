"""Approximate nearest neighbours: an inverted multi-index over two vector halves.

Each half is quantised by its own centroids, and a cell is a pair of them.  A
query visits cells in the order of their summed distances, taken from a heap,
until they hold enough entries; entries of visited cells are ranked by their
exact Euclidean distance.  How many entries are enough is measured: true
neighbours of a few sampled queries tell how far a search has to go.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ronda.llm.jaccard_join import runs
from ronda.llm.store import partitions, stored

FITTED_ON = 15_000  # vectors that centroids are fitted on, in the order of a hash of their id
MOST_CENTROIDS = 64  # of each half
PROBES = 100  # sampled queries whose true neighbours are found to set the number of entries visited
RECALL = 0.96  # recall over the sampled queries that the number must reach
BLOCK = 2048  # entries that a step compares with


@dataclass
class Index:
    """Centroids of both halves, entries per cell, and how many entries a search visits."""

    first: np.ndarray
    second: np.ndarray
    counts: np.ndarray  # (centroids of the first half, of the second half)
    visited: int

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _nearest(vectors[:, :half], self.first), _nearest(vectors[:, half:], self.second)

    def traverse(self, vector: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cells in the order of the summed distance of both halves."""
        half = self.first.shape[1]
        d = [((c - v) ** 2).sum(1) for c, v in ((self.first, vector[:half]), (self.second, vector[half:]))]
        order = [np.argsort(x, kind="stable") for x in d]
        heap, seen = [(d[0][order[0][0]] + d[1][order[1][0]], 0, 0)], {(0, 0)}
        while heap:
            _, i, j = heapq.heappop(heap)
            yield int(order[0][i]), int(order[1][j])
            for k, m in ((i + 1, j), (i, j + 1)):
                if k < len(order[0]) and m < len(order[1]) and (k, m) not in seen:
                    seen.add((k, m))
                    heapq.heappush(heap, (d[0][order[0][k]] + d[1][order[1][m]], k, m))

    def plan(self, vector: np.ndarray) -> dict[int, np.ndarray]:
        """Cells to visit: by centroid of the first half, which of the second half."""
        out: dict[int, np.ndarray] = {}
        met = 0
        for i, j in self.traverse(vector):
            out.setdefault(i, np.zeros(len(self.second), bool))[j] = True
            met += int(self.counts[i, j])
            if met >= self.visited:
                break
        return out


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(1) - 2 * x @ centroids.T, axis=1)


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    distinct = np.unique(x, axis=0)
    found = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        own = _nearest(x, found)
        size = np.bincount(own, minlength=len(found))
        sums = np.stack([np.bincount(own, x[:, c], len(found)) for c in range(x.shape[1])], axis=1)
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], found)
    return found


def valid_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): vectors that take part, each repeated row once.

    Left out: null ids; null, empty and zero vectors; vectors with a null, NaN
    or infinite component; vectors of another length than most have.
    """
    v = F.col(vector_col).cast("array<double>")
    own = rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    own = own.where(finite & F.exists("v", lambda x: x != 0))
    lengths = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return own.where(F.size("v") == (lengths[0] if lengths else 0)).dropDuplicates(["id", "v"])


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _closest(ids: np.ndarray, vectors: np.ndarray, squares: np.ndarray, query: np.ndarray, open_: np.ndarray, k: int):
    """The k nearest of the open entries: (distance, id), ties to the smaller id."""
    at = np.flatnonzero(open_)
    if len(at) > k:
        rough = squares[at] - 2 * (vectors[at] @ query)
        slack = 1e-9 * (1 + float(query @ query) + float(squares[at].max()))
        at = at[rough <= np.partition(rough, k - 1)[k - 1] + slack]
    distance = np.sqrt(((vectors[at] - query) ** 2).sum(1))
    best = np.lexsort((ids[at], distance))[:k]
    return distance[best], ids[at][best]


def _true_neighbours(entries: DataFrame, probes: list, dims: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, v) of the true neighbours of a bounded number of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in probes]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            squares = (vectors**2).sum(1)
            place = {int(i): p for p, i in enumerate(ids)}
            for n, (own, query) in enumerate(probes):
                found = _closest(ids, vectors, squares, query, ids != own, k)
                best[n] = sorted([*best[n], *((d, int(i), vectors[place[int(i)]].tolist()) for d, i in zip(*found, strict=True))], key=lambda r: r[:2])[:k]
        rows = [(probes[n][0], i, float(d), v) for n, found in enumerate(best) for d, i, v in found]
        yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "vec_id", "score", "v"), r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("v", pa.list_(pa.float64()))])
    near = entries.select("id", "v").mapInArrow(run, "query_id long, vec_id long, score double, v array<double>")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return near.withColumn("nth", nth).where(F.col("nth") <= k).drop("nth")


def build(entries: DataFrame, k: int) -> tuple[Index, DataFrame] | None:
    """Fits the index to (id, v) and files every row: (index, entries with c1 and c2).  None without rows."""
    sample = entries.orderBy(F.xxhash64("id"), "id").limit(FITTED_ON).collect()
    if not sample:
        return None
    x, rng = np.array([r["v"] for r in sample]), np.random.default_rng(5)
    dims = x.shape[1]
    half, k0 = max(1, dims // 2), int(np.clip(np.sqrt(len(x)) / 2, 1, MOST_CENTROIDS))
    halves = [_centroids(x[:, :half], k0, rng), _centroids(x[:, half:], k0, rng) if dims > half else np.zeros((1, 0))]
    index = Index(halves[0], halves[1], np.zeros((len(halves[0]), len(halves[1])), np.int64), 0)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c1, c2 = index.cells(_matrix(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(c1.astype(np.int32)), pa.array(c2.astype(np.int32))], ["id", "v", "c1", "c2"])

    filed = stored(entries.select("id", "v").mapInArrow(file, "id long, v array<double>, c1 int, c2 int"), "entries")
    for c1, c2, n in filed.groupBy("c1", "c2").count().collect():  # at most MOST_CENTROIDS squared
        index.counts[c1, c2] = n
    probes = [(r["id"], np.array(r["v"])) for r in sample[:PROBES]]
    vectors = dict(probes)
    needed = []
    for own, _, _, v in _true_neighbours(filed, probes, dims, k).collect():  # PROBES * k rows
        cell = tuple(int(c[0]) for c in index.cells(np.array([v])))
        met = 0
        for i, j in index.traverse(vectors[own]):
            met += int(index.counts[i, j])
            if (i, j) == cell:
                break
        needed.append(met)
    index.visited = int(np.quantile(needed, RECALL, method="higher")) if needed else int(index.counts.sum())
    return index, filed


def search(rows: DataFrame, every: int, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest entries found for each query.

    Queries are the rows whose id is divisible by ``every``; all rows are
    candidates but those of the query's own id.  See ``valid_vectors`` for rows that take no part.  Ties go to the smaller id.
    """
    spark = rows.sparkSession
    entries = stored(valid_vectors(rows, id_col, vector_col), "vectors")
    built = build(entries, k)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index, filed = built
    dims = index.first.shape[1] + index.second.shape[1]
    blocks = np.maximum(1, -(-index.counts.sum(1) // BLOCK)).tolist()
    width = len(index.second)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            out = []
            for own, v in zip(ids.tolist(), vectors, strict=True):
                for c1, open_ in index.plan(v).items():
                    bits = np.packbits(open_).tobytes()
                    out.extend((c1, b, 1, own, v.tobytes(), -1, bits) for b in range(blocks[c1]))
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=schema)

    names = ("c1", "block", "kind", "id", "v", "c2", "open")
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    schema = pa.schema(list(zip(names, types, strict=True)))
    ddl = "c1 int, block int, kind int, id long, v binary, c2 int, open binary"

    def entry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column(0).to_numpy(), _matrix(batch.column(1), dims)
            c1 = batch.column(2).to_numpy()
            block = batch.column(4).to_numpy() % np.array(blocks)[c1] if len(c1) else c1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(2),
                    pa.array(block.astype(np.int32)),
                    pa.array(np.zeros(len(ids), np.int32)),
                    batch.column(0),
                    pa.array([v.tobytes() for v in vectors], pa.binary()),
                    batch.column(3),
                    pa.array([None] * len(ids), pa.binary()),
                ],
                schema=schema,
            )

    dealt = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("dealt")
    asked = filed.where(F.col("id") % every == 0).select("id", "v")
    both = asked.mapInArrow(plan, ddl).unionByName(filed.select("id", "v", "c1", "c2", dealt).mapInArrow(entry, ddl))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c1, block, kind, ids, v, c2, open_ in runs(batches, 2):
            turn = np.flatnonzero((c1[1:] != c1[:-1]) | (block[1:] != block[:-1])) + 1
            out: list[tuple] = []
            for s, e in zip([0, *turn], [*turn, len(c1)], strict=True):
                m = s + int((kind[s:e] == 0).sum())
                if m == s or m == e:
                    continue
                vectors = np.frombuffer(b"".join(v[s:m]), np.float64).reshape(-1, dims)
                squares, own, cell = (vectors**2).sum(1), ids[s:m], c2[s:m]
                for q in range(m, e):
                    seen = np.unpackbits(np.frombuffer(open_[q], np.uint8))[:width].astype(bool)[cell] & (own != ids[q])
                    if seen.any():
                        d, i = _closest(own, vectors, squares, np.frombuffer(v[q], np.float64), seen, k)
                        out.extend(zip([ids[q]] * len(d), i, d, strict=True))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                ["query_id", "vec_id", "score"],
            )

    spread = 4 * partitions(spark)
    near = (
        both.repartition(spread, "c1", "block")
        .sortWithinPartitions("c1", "block", "kind", "id")
        .mapInArrow(compare, "query_id long, vec_id long, score double")
    )
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    best = near.distinct().withColumn("rank", nth.cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
