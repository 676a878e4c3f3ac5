"""Quality classifier: co-training of a content view and a metadata view.

One view reads the text, the other what is known about the page without
reading it (language, source, length, layout).  In each round either view
labels the unlabelled documents it is surest of for the other one.  Both are
calibrated on rows neither was fitted on, and their calibrated logits are
combined into the probability that a document is good.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ronda.llm.store import stored
from ronda.llm.texts import LOWER, SPACE, Hashes, chunks, mix, rows_of, spans
from ronda.llm.toxicity import held_out, labelled_sample

SAMPLE_PER_LABEL = 3000  # labelled documents fitted on, per label
SAMPLE_CHARS = 12_000_000  # and their characters, per label
ROUNDS = 5
CONFIDENT = 0.1  # share of the unlabelled documents that a view labels in a round
MOST_GIVEN = 300  # and at most so many of them per class
SURE = float(np.log(0.98 / 0.02))  # logit from which a view may label
BUCKETS = 32
CLASSES = 10
WIDTHS = CLASSES * CLASSES + 10, 8 + 2 * BUCKETS  # features of the content and the metadata view

_CLASS = np.full(256, 9, np.uint8)  # other ASCII symbols
_CLASS[:32] = 8
_CLASS[SPACE] = 0
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[ord(c) for c in ".,;:?-'\"()"]] = 5
_CLASS[[ord(c) for c in "|<>{}[]/\\_="]] = 6
_CLASS[[ord(c) for c in "!#$%&*@^~+"]] = 7


def content_view(column: pa.Array) -> np.ndarray:
    """Features of the words and characters of each text.

    Shares and pairs of character classes, repeated words and shingles, word
    lengths; the largest share of symbols, capitals and repeats of any line.
    """
    out = []
    for begin, end, data, offsets in chunks(column):
        n, size = end - begin, np.diff(offsets)
        kind = _CLASS[data].astype(np.int64)
        row = np.repeat(np.arange(n), size)
        pairs = np.zeros((n, CLASSES * CLASSES))
        if len(data) > 1:
            inside = row[1:] == row[:-1]
            code = (row[1:] * CLASSES + kind[:-1])[inside] * CLASSES + kind[1:][inside]
            pairs = np.bincount(code, minlength=n * CLASSES * CLASSES).reshape(n, -1)
        pairs = np.log1p(1000 * pairs / np.maximum(size, 1)[:, None])
        starts, ends = spans(~SPACE[data], offsets)
        word_row = rows_of(starts, offsets)
        words = np.bincount(word_row, minlength=n)
        hashed = Hashes(LOWER[data]).of(starts, ends)
        per_word = np.maximum(words, 1)
        length = np.bincount(word_row, ends - starts, n) / per_word
        repeat = np.zeros(len(hashed), bool)
        repeat[1:] = (hashed[1:] == hashed[:-1]) & (word_row[1:] == word_row[:-1])
        distinct = np.bincount(_distinct_rows(word_row, hashed), minlength=n) / per_word
        runs = np.zeros(max(0, len(hashed) - 3), np.uint64)
        for k in range(4):
            runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + len(runs)]
        whole = word_row[: len(runs)] == word_row[3:] if len(runs) else np.zeros(0, bool)
        run_row = word_row[: len(runs)][whole]
        of_runs = np.maximum(np.bincount(run_row, minlength=n), 1)
        fresh = np.bincount(_distinct_rows(run_row, runs[whole]), minlength=n) / of_runs
        # Lines: runs of bytes without a line end.
        line_s, line_e = spans(data != 10, offsets)
        line_row, line_size = rows_of(line_s, offsets), np.maximum(line_e - line_s, 1)
        lines = [np.zeros(n) for _ in range(5)]
        long = line_size >= 30
        marks = [kind == 2, kind == 6, kind == 7, kind == 3]
        shares = [_sum_between(m, line_s, line_e) / line_size for m in marks]
        at = np.searchsorted(line_s, starts, "right") - 1 if len(line_s) else np.zeros(0, np.int64)
        in_line = np.maximum(np.bincount(at, minlength=len(line_s)), 1)
        shares.append(np.bincount(at, repeat, len(line_s)) / in_line if len(at) else np.zeros(len(line_s)))
        for most, share in zip(lines, shares, strict=True):
            np.maximum.at(most, line_row[long], share[long])
        out.append(
            np.column_stack(
                [
                    pairs,
                    np.log1p(length),
                    np.bincount(word_row, repeat, n) / per_word,
                    distinct,
                    np.log1p(per_word) * distinct,
                    fresh,
                    *lines,
                ]
            )
        )
    return np.concatenate(out) if out else np.zeros((0, WIDTHS[0]))


def _distinct_rows(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The row of each distinct (row, value)."""
    if not len(row):
        return row
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    first = np.ones(len(r), bool)
    first[1:] = (r[1:] != r[:-1]) | (v[1:] != v[:-1])
    return r[first]


def _sum_between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1)
    np.cumsum(flags, out=total[1:])
    return total[ends] - total[starts]


def metadata_view(column: pa.Array, lang: list, source: list, n_chars: np.ndarray) -> np.ndarray:
    """Features of a page apart from its words: language, source, length, layout of lines."""
    n = len(column)
    size, lines, longest, mean = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for begin, end, data, offsets in chunks(column):
        s, e = spans(data != 10, offsets)
        row = rows_of(s, offsets)
        size[begin:end] = np.diff(offsets)
        lines[begin:end] = np.bincount(row, minlength=end - begin)
        most = np.zeros(end - begin)
        np.maximum.at(most, row, e - s)
        longest[begin:end] = most
        mean[begin:end] = np.bincount(row, e - s, end - begin) / np.maximum(lines[begin:end], 1)
    chars = np.where(np.isfinite(n_chars) & (n_chars > 0), n_chars, 0.0)
    hot = np.zeros((n, 2 * BUCKETS))
    for k, values in enumerate((lang, source)):
        for i, value in enumerate(values):
            hot[i, k * BUCKETS + _bucket(value)] = 1
    numbers = np.column_stack(
        [np.log1p(size), np.log1p(chars), np.log1p(lines), np.log1p(longest), np.log1p(mean), size / np.maximum(chars, 1).clip(1), np.log1p(size) ** 2, np.log1p(mean) ** 2]
    )
    return np.concatenate([numbers, hot], axis=1)


def _bucket(value: object) -> int:
    code = 0 if value is None else 1 + zlib.crc32(str(value).encode())
    return int(mix(np.array([code], np.uint64))[0] % BUCKETS)


@dataclass
class View:
    """A logistic model of one view."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def logit(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.mean) / self.scale, -8, 8)
        return x @ self.weight[:-1] + self.weight[-1]

    def calibrated(self, features: np.ndarray) -> np.ndarray:
        return self.slope * self.logit(features) + self.offset


@dataclass
class Model:
    content: View
    metadata: View
    combine: np.ndarray  # weights of both calibrated logits, and an offset

    def probabilities(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.content.calibrated(content), self.metadata.calibrated(metadata)
        both = self.combine[0] * a + self.combine[1] * b + self.combine[2]
        return _sigmoid(a), _sigmoid(b), _sigmoid(both)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic fit by Newton steps; the last is the offset."""
    x1 = np.column_stack([x, np.ones(len(x))])
    penalty = np.append(np.full(x.shape[1], ridge), 1e-6)
    beta = np.zeros(x1.shape[1])
    for _ in range(25):
        p = _sigmoid(x1 @ beta)
        g = x1.T @ (w * (p - y)) + penalty * beta
        step = np.linalg.solve((x1 * (w * (p * (1 - p) + 1e-6))[:, None]).T @ x1 + np.diag(penalty + 1e-9), g)
        beta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _view(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale < 1e-9, 1.0, scale)
    beta = _logistic(np.clip((x - mean) / scale, -8, 8), y, w, 1.0)
    return View(mean, scale, beta)


class Unlabelled:
    """Both views of all documents without a label, worked out once and kept in the shared folder."""

    def __init__(self, docs: DataFrame, told: DataFrame, id_col: str, text_col: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = [_lists(x.astype(np.float32)) for x in _features(batch, 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "content", "metadata"])

        # Features are joined and not texts, since one of both is exchanged where there are many labels.
        kind = docs.schema[id_col].dataType.simpleString()
        own = docs.where(F.col(text_col).isNotNull()).select(id_col, text_col, "lang", "source", "n_chars")
        views = own.mapInArrow(run, f"id {kind}, content array<float>, metadata array<float>")
        bare = views.join(told.select(F.col(id_col).alias("id")).hint("merge"), "id", "left_anti").drop("id")
        self.rows = stored(bare.withColumn("row", F.monotonically_increasing_id()), "views")
        self.take = min(MOST_GIVEN, int(CONFIDENT * self.rows.count() / 2))

    def surest(self, views: list[View], given: list[set[int]]) -> list[tuple[int, int, float, np.ndarray, np.ndarray]]:
        """(view, row, label, content, metadata): of all rows, the surest of each view and class not given by it yet."""
        if not self.take:
            return []
        take = self.take
        known = [np.array(sorted(g), np.int64) for g in given]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {(k, y): (np.zeros(0), np.zeros(0, np.int64)) for k in (0, 1) for y in (0, 1)}
            for batch in batches:
                row = batch.column(2).to_numpy()
                for k in (0, 1):
                    logit = views[k].logit(_matrix(batch.column(k), WIDTHS[k]))
                    fresh = ~np.isin(row, known[k])
                    for y in (0, 1):
                        surety = logit if y else -logit
                        at = np.flatnonzero(fresh & (surety > SURE))
                        surety, rows = np.append(best[k, y][0], surety[at]), np.append(best[k, y][1], row[at])
                        first = np.lexsort((rows, -surety))[:take]
                        best[k, y] = surety[first], rows[first]
            for (k, y), (surety, rows) in best.items():
                n = len(rows)
                columns = [pa.array(np.full(n, k, np.int32)), pa.array(np.full(n, y, np.int32)), pa.array(surety), pa.array(rows)]
                yield pa.RecordBatch.from_arrays(columns, ["view", "label", "surety", "row"])

        found = self.rows.mapInArrow(run, "view int, label int, surety double, row long")
        local = stored(found, "surest")
        top = [
            r
            for k in (0, 1)
            for y in (0, 1)
            for r in local.where((F.col("view") == k) & (F.col("label") == y)).orderBy(F.desc("surety"), "row").limit(take).collect()
        ]
        ids = self.rows.sparkSession.createDataFrame([(i,) for i in {r.row for r in top}], "row long")
        read = self.rows.join(F.broadcast(ids), "row", "left_semi").collect()  # at most 4 * MOST_GIVEN rows
        features = {r.row: (np.array(r.content), np.array(r.metadata)) for r in read}
        return [(r.view, r.row, float(r.label), *features[r.row]) for r in top]


def _lists(features: np.ndarray) -> pa.Array:
    values = pa.array(features.ravel())
    return pa.FixedSizeListArray.from_arrays(values, features.shape[1]).cast(pa.list_(values.type))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def cotrain(content: np.ndarray, metadata: np.ndarray, label: np.ndarray, more: Unlabelled, rounds: int = ROUNDS) -> Model:
    """Fits both views in rounds; every fourth labelled row is kept for calibration."""
    fold = np.arange(len(label)) % 4 == 3
    if len(set(label[~fold].tolist())) < 2 or len(set(label[fold].tolist())) < 2:
        fold = np.zeros(len(label), bool)
    views = [content, metadata]
    named: list[set[int]] = [set(), set()]  # rows that each view has labelled
    x, y, w = [v[~fold] for v in views], [label[~fold]] * 2, [np.ones((~fold).sum())] * 2
    for done in range(rounds + 1):
        fitted = [_view(x[k], y[k], w[k]) for k in (0, 1)]
        found = more.surest(fitted, named) if done < rounds else []
        for k in (0, 1):
            own = [f for f in found if f[0] == k]
            named[k].update(f[1] for f in own)
            if own:  # what one view is sure of is given to the other
                x[1 - k] = np.concatenate([x[1 - k], [f[4 - k] for f in own]])
                y[1 - k] = np.append(y[1 - k], [f[2] for f in own])
                w[1 - k] = np.append(w[1 - k], np.full(len(own), 0.3))
        if not found:
            break
    check = fold if fold.any() else np.ones(len(label), bool)
    for k in (0, 1):
        beta = _logistic(fitted[k].logit(views[k][check])[:, None], label[check], np.ones(check.sum()), 0.01)
        fitted[k].slope, fitted[k].offset = float(beta[0]), float(beta[1])
    both = np.column_stack([fitted[k].calibrated(views[k][check]) for k in (0, 1)])
    return Model(fitted[0], fitted[1], _logistic(np.clip(both, -30, 30), label[check], np.ones(check.sum()), 0.01))


def _features(batch: pa.RecordBatch, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Both views of a batch whose columns from ``first`` on are text, lang, source, n_chars."""
    text, lang, source, chars = (batch.column(first + k) for k in range(4))
    numbers = np.array(chars.cast(pa.float64()).to_pylist(), dtype=float)
    return content_view(text), metadata_view(text, lang.to_pylist(), source.to_pylist(), numbers)


def _labelled(docs: DataFrame, sample: DataFrame, id_col: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, content, metadata) of a sample (_id, _label, _text) in the order of ids; tasks read the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_lists(x) for x in _features(batch, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "label", "content", "metadata"])

    named = docs.select(F.col(id_col).alias("_id"), "lang", "source", "n_chars")
    named = named.join(F.broadcast(sample.select("_id")), "_id", "left_semi").dropDuplicates(["_id"])  # bounded by the sample
    own = sample.join(F.broadcast(named), "_id").select("_id", "_label", "_text", "lang", "source", "n_chars")
    kind = own.schema["_id"].dataType.simpleString()
    found = own.mapInArrow(run, f"id {kind}, label int, content array<double>, metadata array<double>").toArrow().sort_by("id").combine_chunks()
    label, *views = (found[c].combine_chunks() for c in ("label", "content", "metadata"))
    return label.to_numpy().astype(float), *(_matrix(v, w) for v, w in zip(views, WIDTHS, strict=True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on a bounded sample of the labelled rows that are not held out, and on all rows with text but no label.

    The driver takes the features of the sample, some 1.5 kB a row, and never the texts.
    """
    sample = labelled_sample(docs, labels, "quality", id_col, text_col, SAMPLE_PER_LABEL, SAMPLE_CHARS)
    told = labels.where(F.col("quality").isin(0, 1))
    y, content, metadata = _labelled(docs, sample, id_col)
    if len(set(y.tolist())) < 2:
        empty = lambda x: View(np.zeros(x.shape[1]), np.ones(x.shape[1]), np.zeros(x.shape[1] + 1))
        return Model(empty(content), empty(metadata), np.array([0.0, 0.0, -5.0 if len(y) and y[0] == 0 else 5.0]))
    return cotrain(content, metadata, y, Unlabelled(docs, told, id_col, text_col))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, content_score, metadata_score, score, keep) for every row of ``docs``.

    Scores are probabilities that the document is good; keep is score >= 0.5.
    A null text counts as an empty one, null metadata as a value of its own;
    rows that repeat an id are scored one by one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, both = model.probabilities(*_features(batch, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(both >= 0.5)],
                ["id", "content_score", "metadata_score", "score", "keep"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col, "lang", "source", "n_chars").mapInArrow(
        run, f"id {kind}, content_score double, metadata_score double, score double, keep boolean"
    )
    return out.withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``scored`` keeps, with all columns; each row is decided by itself."""
    read = [docs.columns.index(c) for c in (text_col, "lang", "source", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = model.probabilities(*_features(batch.select(read), 0))[2]
            yield batch.filter(pa.array(both >= 0.5))

    return docs.mapInArrow(run, docs.schema)
