"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text is cut into overlapping windows of words.  Each word enters the network
as a word vector beside the sum of the vectors of its byte n-grams, over the root of their number (both from
hashed tables); states of both directions are pooled by attention into one
logit per window, and the most toxic window decides the text.  Labels are per
text, so training picks the window that stands for a toxic text anew in every
epoch.  The network is written and trained in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ronda.llm.store import stored
from ronda.llm.texts import Hashes, chunks, mix, rows_of, spans

WINDOW, STRIDE = 32, 16
WORD_ROWS, GRAM_ROWS, WIDTH, STATE = 1 << 16, 1 << 16, 8, 10
GRAMS = (3, 4, 5)
BLOCK = 4096
DROPPED = 0.7  # share of word vectors left out in a training step, so that n-grams carry what unseen words share
SAMPLE_PER_LABEL = 1200  # labelled texts fitted on, per label
SAMPLE_CHARS = 8_000_000  # and their characters, per label

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Words:
    """Windows over the words of a chunk of texts; word 0 is the padding."""

    windows: np.ndarray  # (windows, WINDOW) of distinct words
    rows: np.ndarray  # text of each window
    first: np.ndarray  # first word of each window within its text
    word: np.ndarray  # row of each distinct word in the word table
    gram: np.ndarray  # rows of all n-grams, word by word
    gram_starts: np.ndarray  # where those of each distinct word begin; one more at the end


def read_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    """(first row, end row, Words) by chunks of texts."""
    for begin, end, data, offsets in chunks(pc.utf8_lower(column)):
        starts, ends = spans(_WORD[data], offsets)
        hashes = Hashes(data)
        hashed = hashes.of(starts, ends)
        distinct, seen, each = np.unique(hashed, return_index=True, return_inverse=True)
        s, e = starts[seen], ends[seen]
        # N-grams anywhere in a word, and those that begin it once more under numbers of their own.
        counts = [np.maximum(e - s - n + 1, 0) for n in GRAMS] + [(e - s >= n).astype(np.int64) for n in GRAMS]
        at = np.zeros(len(distinct) + 1, np.int64)
        np.cumsum(np.sum(counts, axis=0), out=at[1:])
        gram = np.zeros(at[-1], np.int64)
        done = np.zeros(len(distinct), np.int64)
        for k, (n, count) in enumerate(zip(GRAMS * 2, counts, strict=True)):
            step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            place = np.repeat(s, count) + step
            value = mix(hashes.of(place, place + n) + np.uint64(k >= len(GRAMS)))
            gram[np.repeat(at[:-1] + done, count) + step] = (value & np.uint64(GRAM_ROWS - 2)).astype(np.int64) + 1
            done += count
        words = np.bincount(rows_of(starts, offsets), minlength=end - begin) if len(starts) else np.zeros(end - begin, np.int64)
        per_text = np.where(words > 0, 1 + np.maximum(0, -(-(words - WINDOW) // STRIDE)), 0)
        rows = np.repeat(np.arange(end - begin), per_text)
        first = (np.arange(len(rows)) - np.repeat(np.cumsum(per_text) - per_text, per_text)) * STRIDE
        base = np.cumsum(words) - words
        place = first[:, None] + np.arange(WINDOW)
        inside = place < words[rows][:, None]
        flat = np.minimum(base[rows][:, None] + place, max(0, len(starts) - 1))
        windows = np.where(inside, each[flat] + 1, 0) if len(starts) else np.zeros((0, WINDOW), np.int64)
        word = np.concatenate([[0], (distinct & np.uint64(WORD_ROWS - 2)).astype(np.int64) + 1])
        yield begin, end, Words(windows, rows, first, word, gram, np.concatenate([[0], at]))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


FIXED = 20, 22  # fractional bits of factors whose products are summed exactly: word vectors, states


class _FixedProduct:
    """x @ weights on whole numbers, which add up to the same in any order.

    A plain product rounds by a row's place among the others, so that equal
    texts would differ by what is scored beside them.
    """

    def __init__(self, weights: np.ndarray, bits: int):
        self._unit = np.float64(1 << bits)
        self._weights = np.rint(weights * self._unit) / self._unit**2

    def of(self, x: np.ndarray) -> np.ndarray:
        whole = x * self._unit
        return (np.rint(whole, out=whole) @ self._weights).astype(np.float32)


class Network:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.word = draw(WORD_ROWS, WIDTH, scale=0.1)
        self.gram = draw(GRAM_ROWS, WIDTH, scale=0.1)
        self.word[0] = self.gram[0] = 0
        self.dense: dict[str, np.ndarray] = {}
        for d in "fb":
            self.dense["w" + d] = draw(2 * WIDTH, 3 * STATE, scale=(2 * WIDTH) ** -0.5)
            self.dense["u" + d] = draw(STATE, 3 * STATE, scale=STATE**-0.5)
            self.dense["c" + d] = np.zeros(3 * STATE, np.float32)
        self.dense["att"] = draw(2 * STATE, scale=0.3)
        self.dense["out"] = draw(2 * STATE, scale=0.3)
        self.dense["bias"] = np.full(1, -1.0, np.float32)
        self.scale, self.shift = 1.0, 0.0  # calibration of the logit of the most toxic window

    def inputs(self, words: Words, used: np.ndarray | None = None, drop: np.ndarray | None = None) -> np.ndarray:
        """Vectors of the distinct words (or of ``used``): word vector beside the scaled sum of n-gram vectors."""
        of_word = self.word[words.word if used is None else words.word[used]]
        if drop is not None:
            of_word = of_word * drop[:, None]
        starts, counts = _grams_of(words, used)
        rows = words.gram if used is None else words.gram[_ranges(starts, counts)]
        sums = np.zeros((len(of_word), WIDTH), np.float32)
        has = counts > 0
        if has.any():
            sums[has] = np.add.reduceat(self.gram[rows], (np.cumsum(counts) - counts)[has], axis=0)
        return np.concatenate([of_word, sums / np.sqrt(np.maximum(counts, 1))[:, None].astype(np.float32)], axis=1)

    def _run(self, index: np.ndarray, given: np.ndarray, mask: np.ndarray, d: str, keep: list | None) -> np.ndarray:
        """States of one direction: (steps, windows, STATE)."""
        n, steps = index.shape
        u = self.dense["u" + d]
        fixed = _FixedProduct(u, FIXED[1])
        h = np.zeros((n, STATE), np.float32)
        states = np.zeros((steps, n, STATE), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, own = given[index[:, t]], fixed.of(h) if keep is None else h @ u
            gates = _sigmoid(x[:, : 2 * STATE] + own[:, : 2 * STATE])
            z, r = gates[:, :STATE], gates[:, STATE:]
            new = np.tanh(x[:, 2 * STATE :] + r * own[:, 2 * STATE :])
            if keep is not None:
                keep.append((t, h, z, r, new, own[:, 2 * STATE :]))
            h = (new + z * (h - new)) * mask[:, t, None]
            states[t] = h
        return states

    def _pooled(self, index: np.ndarray, vectors: np.ndarray, keeps: tuple | None = None):
        mask = (index > 0).astype(np.float32)
        both = []
        for k, d in enumerate("fb"):
            w = self.dense["w" + d]
            given = (vectors @ w if keeps else _FixedProduct(w, FIXED[0]).of(vectors)) + self.dense["c" + d]
            both.append(self._run(index, given, mask, d, keeps[k] if keeps else None))
        states = np.concatenate(both, axis=2)
        score = np.where(mask.T > 0, np.einsum("tnh,h->tn", states, self.dense["att"]), -1e9)
        weight = np.exp(score - score.max(0))
        weight /= np.cumsum(weight, axis=0)[-1]  # in order, however many windows there are
        return mask, states, weight, np.einsum("tn,tnh->nh", weight, states)

    def logits(self, words: Words) -> np.ndarray:
        """One logit per window."""
        if not len(words.windows):
            return np.zeros(0, np.float32)
        vectors = self.inputs(words)
        blocks = (words.windows[i : i + BLOCK] for i in range(0, len(words.windows), BLOCK))
        out = [np.einsum("nh,h->n", self._pooled(block, vectors)[3], self.dense["out"]) for block in blocks]
        return np.concatenate(out) + self.dense["bias"][0]

    def gradients(self, words: Words, pick: np.ndarray, target: np.ndarray, rng: np.random.Generator):
        """Loss and gradients of the cross-entropy over the picked windows."""
        used, index = np.unique(words.windows[pick], return_inverse=True)
        index = index.reshape(len(pick), WINDOW)
        if used[0] != 0:
            used, index = np.concatenate([[0], used]), index + 1
        drop = (rng.random(len(used)) > DROPPED).astype(np.float32)
        vectors = self.inputs(words, used, drop)
        keeps: tuple[list, list] = ([], [])
        mask, states, weight, pooled = self._pooled(index, vectors, keeps)
        out = pooled @ self.dense["out"] + self.dense["bias"][0]
        p = _sigmoid(out)
        g_out = (p - target) / len(pick)
        grads = {"out": pooled.T @ g_out, "bias": g_out.sum(keepdims=True)}
        g_pool = g_out[:, None] * self.dense["out"]
        g_states = weight[:, :, None] * g_pool
        g_weight = np.einsum("nh,tnh->tn", g_pool, states)
        g_score = weight * (g_weight - (weight * g_weight).sum(0))
        grads["att"] = np.einsum("tn,tnh->h", g_score, states)
        g_states += g_score[:, :, None] * self.dense["att"]
        g_vectors = np.zeros_like(vectors)
        for k, d in enumerate("fb"):
            u, w = self.dense["u" + d], self.dense["w" + d]
            g_u, carried = np.zeros_like(u), 0.0
            g_given = np.zeros((len(used), 3 * STATE), np.float32)
            for t, h, z, r, new, own in reversed(keeps[k]):
                g = (g_states[t][:, k * STATE : (k + 1) * STATE] + carried) * mask[:, t, None]
                g_new = g * (1 - z) * (1 - new * new)
                g_z = g * (h - new) * z * (1 - z)
                g_r = g_new * own * r * (1 - r)
                g_own = np.concatenate([g_z, g_r, g_new * r], axis=1)
                g_x = np.concatenate([g_z, g_r, g_new], axis=1)
                g_u += h.T @ g_own
                carried = g * z + g_own @ u.T
                np.add.at(g_given, index[:, t], g_x)
            grads["u" + d], grads["w" + d] = g_u, vectors.T @ g_given
            grads["c" + d] = g_given.sum(0)
            g_vectors += g_given @ w.T
        loss = -np.mean(np.where(target > 0, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
        starts, counts = _grams_of(words, used)
        rows = words.gram[_ranges(starts, counts)]
        per_gram = np.repeat(g_vectors[:, WIDTH:] / np.sqrt(np.maximum(counts, 1))[:, None], counts, axis=0)
        tables = [(self.word, words.word[used], g_vectors[:, :WIDTH] * drop[:, None]), (self.gram, rows, per_gram)]
        return loss, grads, tables

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return _sigmoid(self.scale * logit.astype(np.float64) + self.shift)


def _grams_of(words: Words, used: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    starts, counts = words.gram_starts[:-1], np.diff(words.gram_starts)
    return (starts, counts) if used is None else (starts[used], counts[used])


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)


class _Steps:
    """Adam for the dense parameters, Adagrad for the touched rows of the tables."""

    def __init__(self, net: Network, rate: float):
        self.net, self.rate, self.t = net, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.v = {k: np.zeros_like(v) for k, v in net.dense.items()}
        self.seen = {id(x): np.zeros(len(x), np.float32) for x in (net.word, net.gram)}

    def take(self, grads: dict[str, np.ndarray], tables: list) -> None:
        self.t += 1
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.99**self.t)
            self.net.dense[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        for table, rows, g in tables:
            touched, at = np.unique(rows, return_inverse=True)
            total = np.stack([np.bincount(at, g[:, c], len(touched)) for c in range(WIDTH)], axis=1).astype(np.float32)
            seen = self.seen[id(table)]
            seen[touched] += (total * total).mean(1)
            table[touched] -= 10 * self.rate * total / (np.sqrt(seen[touched]) + 1e-6)[:, None]
            table[0] = 0


def train(texts: list[str], labels: np.ndarray, epochs: int | None = None, seed: int = 7) -> Network:
    """Fits the network to labelled texts; fewer texts are seen more often, in smaller batches.

    In each epoch a toxic text is represented by a window drawn in favour of
    high logits, a clean one by its highest window and one at random.
    """
    net, rng = Network(seed), np.random.default_rng(seed)
    parts = list(read_words(pa.array(texts, pa.string())))
    if not parts or len(set(labels.tolist())) < 2:
        net.dense["bias"][:] = 8.0 if len(labels) and labels.min() == 1 else -8.0
        net.dense["out"][:] = 0
        return net
    words = _joined(parts)
    # Every sixth text sets the threshold and is not fitted to, unless there are too few for that.
    kept = np.arange(len(labels)) % 6 == 5
    if min(labels.sum(), len(labels) - labels.sum()) < 60:
        kept[:] = False
    epochs = epochs or int(np.clip(6000 // len(texts), 12, 40))
    batch = int(np.clip(len(texts) // 16, 16, 256))
    steps = _Steps(net, 0.01)
    for epoch in range(epochs):
        logit = net.logits(words)
        noise = rng.gumbel(size=len(logit)) * (1.5 / (1 + epoch))
        best, other = _best_of(words.rows, logit + noise), _best_of(words.rows, rng.random(len(logit)))
        clean = labels[words.rows[best]] == 0
        pick = np.concatenate([best, other[clean]])
        pick = pick[~kept[words.rows[pick]]]
        target = labels[words.rows[pick]].astype(np.float32)
        order = rng.permutation(len(pick))
        steps.rate = 0.02 if epoch < epochs // 2 else 0.007
        for i in range(0, len(order), batch):
            some = order[i : i + batch]
            _, grads, tables = net.gradients(words, pick[some], target[some], rng)
            steps.take(grads, tables)
    logit = net.logits(words)
    best = _best_of(words.rows, logit)
    if kept.any():
        best = best[kept[words.rows[best]]]
    net.scale, net.shift = _calibrated(logit[best], labels[words.rows[best]])
    return net


def _joined(parts: list[tuple[int, int, Words]]) -> Words:
    """Words of several chunks as one; a word may occur once per chunk."""
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    words, grams = 1, 0
    for begin, _, w in parts:
        out[0].append(np.where(w.windows > 0, w.windows + (words - 1), 0))
        out[1].append(w.rows + begin)
        out[2].append(w.first)
        out[3].append(w.word[1:])
        out[4].append(w.gram)
        out[5].append(w.gram_starts[1:-1] + grams)
        words += len(w.word) - 1
        grams += len(w.gram)
    joined = [np.concatenate(x) for x in out]
    return Words(joined[0], joined[1], joined[2], np.append(0, joined[3]), joined[4], np.concatenate([[0], joined[5], [grams]]))


def _best_of(rows: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The window of each text with the highest value; rows are sorted."""
    order = np.lexsort((-value, rows))
    first = np.ones(len(rows), bool)
    first[1:] = rows[order][1:] != rows[order][:-1]
    return order[first]


def _calibrated(logit: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit with smoothed targets."""
    logit, n1 = logit.astype(np.float64), max(1, int(label.sum()))
    n0 = max(1, len(label) - n1)
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = 1 / len(label)
    scale, shift = 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(scale * logit + shift)
        g, c = weight * (p - target), weight * p * (1 - p)
        hess = np.array([[(c * logit * logit).sum() + 1e-4, (c * logit).sum()], [(c * logit).sum(), c.sum() + 1e-4]])
        step = np.linalg.solve(hess, np.array([(g * logit).sum() + 1e-4 * (scale - 1), g.sum() + 1e-4 * shift]))
        scale, shift = scale - np.clip(step[0], -1, 1), shift - np.clip(step[1], -1, 1)
    return (float(scale), float(shift)) if scale > 0.05 else (1.0, 0.0)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitting(sizes: list[tuple], chars: int) -> list:
    """Ids of the (label, order, id, characters) that fit into ``chars`` per label, in that order; one that does not is skipped."""
    used: dict[int, int] = {}
    out = []
    for label, _, key, size in sorted(sizes):
        if used.get(label, 0) + size <= chars:
            used[label] = used.get(label, 0) + size
            out.append(key)
    return out


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, per_label: int, chars: int
) -> DataFrame:
    """At most ``per_label`` texts and ``chars`` characters of each label: (id, label, text).

    Rows are taken in the order of a hash of their id; a text that does not fit
    is passed over.  A label given more than once counts as its largest value;
    null labels and ids are left out.
    """
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where("_id is not null and _text is not null")
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_label"))
        .join(own.select("_id").distinct(), "_id", "left_semi")
        .withColumn("_order", F.xxhash64("_id"))
    )
    picked = [known.where(F.col("_label") == k).orderBy("_order", "_id").limit(per_label) for k in (0, 1)]
    both = F.broadcast(picked[0].union(picked[1]))  # at most 2 * per_label rows
    texts = stored(own.join(both, "_id").dropDuplicates(["_id"]), "sample")
    sizes = texts.select("_label", "_order", "_id", F.length("_text")).collect()
    ids = docs.sparkSession.createDataFrame([(i,) for i in fitting([tuple(r) for r in sizes], chars)], texts.select("_id").schema)
    return texts.join(F.broadcast(ids), "_id", "left_semi").select("_id", "_label", "_text")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Trains on a bounded sample of the rows that are not held out.

    One task reads the stored sample and trains; the driver takes the network,
    some megabytes whatever the sample, and never the texts.
    """
    sample = labelled_sample(docs, labels, "toxic", id_col, text_col, SAMPLE_PER_LABEL, SAMPLE_CHARS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((i, t, y) for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        texts, marks = [t for _, t, _ in rows], np.array([y for _, _, y in rows], np.int64)
        del rows
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(texts, marks))], pa.binary())], ["network"])

    trained = sample.repartition(1).mapInArrow(run, "network binary").collect()
    return pickle.loads(trained[0][0]) if trained else train([], np.zeros(0, np.int64))


def _scores(net: Network, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, windows, first word of the most toxic window or -1) of each text."""
    n = len(column)
    score, count, worst = np.zeros(n), np.zeros(n, np.int64), np.full(n, -1, np.int64)
    for begin, end, words in read_words(column):
        logit = net.logits(words)
        best = _best_of(words.rows, logit)
        at = words.rows[best] + begin
        score[at], worst[at] = net.probability(logit[best]), words.first[best]
        count[begin:end] = np.bincount(words.rows, minlength=end - begin)
    return score, count, worst


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted, n_windows, worst_word) for every row of ``docs``.

    Every window of every whole text is scored.  ``worst_word`` is the first
    word of the most toxic window.  A null text, an empty one or one without
    words has no window: score 0.0, no worst word.  Rows that repeat an id are
    scored each by its own text; the id may be null; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score, count, worst = _scores(net, batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(count), pa.array(worst, mask=worst < 0)],
                ["id", "score", "predicted", "n_windows", "worst_word"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(
        run, f"id {kind}, score double, predicted int, n_windows long, worst_word long"
    )
    return out.withColumnRenamed("id", id_col)


def kept(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``scored`` does not mark, with all columns; each row is decided by itself."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_scores(net, batch.column(at))[0] < 0.5))

    return docs.mapInArrow(run, docs.schema)
