"""Spelling variants: words one edit apart, found in bidirectional FM-indexes.

A word of ``length`` code points is split in two halves.  One edit leaves one
of the halves as it is, so words are dealt out by the left half for one
search, by the right half for the other, and near words meet in a block of
either.  A block indexes its words, delimited, as one text in both
directions.  The first search matches the left half exactly and extends to the
right allowing one error, the second the right half and extends to the left.
A state of a search is a pair of suffix-rank intervals, of the text and of the
reversed text, that every step keeps in step.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ronda.llm.store import partitions, stored

FLUSH = 200_000  # words that a task counts before it gives them on
LONG = 1 << 20  # code points from which the runs of a text are not listed before they are counted
BLOCK = 4096  # words of a block
STEP = 32  # symbols between two stored counts of an index
DELIMITER = 0

LEFT, RIGHT = 0, 1


class BiIndex:
    """FM-index of a text of small symbol codes and of its reverse."""

    def __init__(self, text: np.ndarray, longest: int):
        self.symbols = int(text.max(initial=0)) + 1
        self.size = len(text)
        self.first = np.zeros(self.symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.symbols), out=self.first[1:])
        self.suffixes = _suffixes(text, longest)
        self._before = _Ranks(np.roll(text, 1)[self.suffixes], self.symbols)  # what stands left of each suffix
        mirrored = text[::-1].copy()
        self._after = _Ranks(np.roll(mirrored, 1)[_suffixes(mirrored, longest)], self.symbols)

    def everything(self, n: int) -> np.ndarray:
        """(begin, begin in the reverse, length) of the empty match, ``n`` times."""
        state = np.zeros((n, 3), np.int64)
        state[:, 2] = self.size
        return state

    def extended(self, state: np.ndarray, symbol: np.ndarray, side: int) -> np.ndarray:
        """Intervals after one more symbol on the ``side``."""
        ranks = self._before if side == LEFT else self._after
        own, other = (0, 1) if side == LEFT else (1, 0)
        begin, length = state[:, own], state[:, 2]
        smaller_b, equal_b = ranks.of(symbol, begin)
        smaller_e, equal_e = ranks.of(symbol, begin + length)
        out = np.empty_like(state)
        out[:, own] = self.first[symbol] + equal_b
        out[:, other] = state[:, other] + smaller_e - smaller_b
        out[:, 2] = equal_e - equal_b
        return out

    def branches(self, state: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, symbol) of every symbol that follows a match on the ``side``."""
        ranks = self._before if side == LEFT else self._after
        own = 0 if side == LEFT else 1
        small = state[:, 2] <= self.symbols
        at = np.flatnonzero(small)
        lengths = state[at, 2]
        rows = np.repeat(at, lengths)
        place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + state[rows, own]
        seen = np.unique(rows * self.symbols + ranks.text[place])
        wide = np.flatnonzero(~small)
        every = (wide[:, None] * self.symbols + np.arange(self.symbols)[None, :]).ravel()
        both = np.concatenate([seen, every])
        return both // self.symbols, both % self.symbols


class _Ranks:
    """Counts of symbols before a place: stored every ``STEP`` symbols, the rest is looked at."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.text = text
        blocks = len(text) // STEP + 1
        padded = np.full(blocks * STEP, symbols, text.dtype if symbols < 256 else np.int32)
        padded[: len(text)] = text
        self._windows = padded.reshape(blocks, STEP)
        cells = np.arange(len(text)) // STEP * (symbols + 1) + text
        counts = np.bincount(cells, minlength=blocks * (symbols + 1)).reshape(blocks, symbols + 1).astype(np.int32)
        self._equal = np.cumsum(counts, 0, dtype=np.int32) - counts
        self._smaller = np.cumsum(self._equal, 1, dtype=np.int32) - self._equal

    def of(self, symbol: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many of the symbols before ``place`` are smaller than, and equal to, ``symbol``."""
        block = place // STEP
        window = self._windows[block]
        inside = np.arange(STEP)[None, :] < (place - block * STEP)[:, None]
        own = symbol[:, None].astype(self._windows.dtype)
        smaller = self._smaller[block, symbol] + ((window < own) & inside).sum(1)
        equal = self._equal[block, symbol] + ((window == own) & inside).sum(1)
        return smaller, equal


def _suffixes(text: np.ndarray, longest: int) -> np.ndarray:
    """Starts of the suffixes (of the text read in a ring) in the order of their first ``longest`` symbols, by doubling."""
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    covered = 1
    while True:
        ahead = np.roll(rank, -covered % len(text))
        keys = rank * (len(text) + int(rank.max()) + 1) + ahead
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        fresh = np.zeros(len(text), np.int64)
        fresh[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(fresh)
        covered *= 2
        if covered >= longest or covered >= len(text) or rank[order[-1]] == len(text) - 1:
            return order


class Vocabulary:
    """Distinct words of one block behind a :class:`BiIndex`."""

    def __init__(self, words: list[str]):
        self.words = words
        self._codes = {c: k + 1 for k, c in enumerate(sorted(set("".join(words))))}
        self._width = max(map(len, words))
        coded = [self.coded(w) for w in words]
        ends = np.cumsum([len(w) + 1 for w in words])
        text = np.zeros(int(ends[-1]) + 1, np.uint8 if len(self._codes) < 255 else np.int32)
        for word, end in zip(coded, ends.tolist(), strict=True):
            text[end - len(word) : end] = word
        self._starts = np.concatenate([[0], ends[:-1]])
        self.index = BiIndex(text, self._width + 3)

    def coded(self, word: str) -> np.ndarray:
        return np.array([self._codes[c] for c in word], np.int64)

    def _which(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of whole words, delimiters included, that are matched."""
        n = state[:, 2]
        rows = np.repeat(np.arange(len(state)), n)
        place = state[rows, 0] + np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n)
        return rows, np.searchsorted(self._starts, self.index.suffixes[place], "right") - 1

    def near(self, asked: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """(asked, found): words of equal length with one other code point, or with one more, right of the left
        half (``side`` RIGHT) or left of the right half.

        A code point put into a run of its like counts at the end of the run,
        so every pair is found by one search, once.
        """
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        lengths = np.array([len(self.words[k]) for k in asked], np.int64)
        for length in np.unique(lengths):
            own = asked[lengths == length]
            for s in range(0, len(own), BLOCK):
                pairs.append(self._near(own[s : s + BLOCK], int(length), side))
        return np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs])

    def _near(self, own: np.ndarray, length: int, side: int) -> tuple[np.ndarray, np.ndarray]:
        index, half = self.index, length // 2
        codes = np.zeros((len(own), length + 2), np.int64)  # a delimiter at either end
        codes[:, 1:-1] = [self.coded(self.words[k]) for k in own]
        # The half that stays, from its inner end outwards, then the delimiter.
        exact = range(half, -1, -1) if side == RIGHT else range(half + 1, length + 2)
        rest = range(half + 1, length + 2) if side == RIGHT else range(half, -1, -1)
        state = index.everything(len(own))
        for k in exact:
            state = index.extended(state, codes[:, k], 1 - side)
        rows, errors = np.arange(len(own)), np.zeros(len(own), bool)
        for k in rest:
            own_next = codes[rows, k]
            clean = np.flatnonzero(~errors)
            at, symbol = index.branches(state[clean], side)
            at = clean[at]
            other = symbol != DELIMITER
            # One more code point before the next of this side.  On the right it may not be like that next one; on the
            # left not like the one it stands before, which is the one matched last.
            before = own_next[at] if side == RIGHT else codes[rows[at], k + 1]
            more = other & (symbol != before)
            if side == LEFT and k == half:  # between the halves: found by the other search
                more[:] = False
            wrong = other & (symbol != own_next[at]) & (own_next[at] != DELIMITER)
            added = index.extended(index.extended(state[at[more]], symbol[more], side), own_next[at[more]], side)
            replaced = index.extended(state[at[wrong]], symbol[wrong], side)
            kept = index.extended(state, own_next, side)
            rows = np.concatenate([rows, rows[at[more]], rows[at[wrong]]])
            errors = np.concatenate([errors, np.ones(int(more.sum() + wrong.sum()), bool)])
            state = np.concatenate([kept, added, replaced])
            alive = state[:, 2] > 0
            rows, errors, state = rows[alive], errors[alive], state[alive]
        row, word = self._which(state[errors])
        return own[rows[errors][row]], word


def occurrences(docs: DataFrame, id_col: str, text_col: str, least: int, edit_every: int | None) -> DataFrame:
    """(word, n): lower-cased runs of letters with ``least`` code points or more, counted over all texts."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def given() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                lowered = text.encode().lower().decode()
                own = Counter(runs.findall(lowered) if len(lowered) < LONG else map(re.Match.group, runs.finditer(lowered)))
                if doc is None or edit_every is None:
                    counts.update(own)
                else:
                    begun = zlib.crc32(b"%d:" % doc)
                    for word, n in own.items():
                        h = zlib.crc32(word.encode(), begun)
                        if h % edit_every == 0:
                            cut = h % len(word)
                            word = word[:cut] + word[cut + 1 :]
                            if len(word) < least:
                                continue
                        counts[word] += n
                if len(counts) >= FLUSH:
                    yield given()
        if counts:
            yield given()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _dealt(words: DataFrame, block_rows: int) -> DataFrame:
    """(block, side, asks, word, n): every word in the blocks where its near words look for it.

    A word is indexed by either half of its own length, under which it asks as
    well, and by the halves that a word without one of its code points would
    have.  A half that very many words share is cut into blocks, and who asks
    goes to all of them.
    """
    size = F.length("word")
    shorter = size - 1
    halves = F.array(
        *[
            F.struct(F.lit(side).alias("side"), length.alias("length"), half.alias("half"), F.lit(asks).alias("asks"))
            for side, length, half, asks in (
                (RIGHT, size, F.left("word", F.floor(size / 2).cast("int")), True),
                (LEFT, size, F.expr("substr(word, CAST(floor(length(word) / 2) AS INT) + 1)"), True),
                (RIGHT, shorter, F.left("word", F.floor(shorter / 2).cast("int")), False),
                (LEFT, shorter, F.expr("substr(word, CAST(floor((length(word) - 1) / 2) AS INT) + 2)"), False),
            )
        ]
    )
    rows = words.withColumn("h", F.explode(halves)).select(F.xxhash64("h.side", "h.length", "h.half").alias("key"), "h.side", "h.asks", "word", "n")
    spread = partitions(words.sparkSession)
    blocks = max(spread, -(-4 * words.count() // block_rows))
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > block_rows)
    hot = hot.select("key", F.ceil(F.col("rows") / block_rows).cast("int").alias("parts"))
    marked = rows.join(hot, "key", "left")
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    one = F.array(F.struct(F.coalesce(part, F.lit(0)).alias("part"), F.lit(True).alias("indexed"), F.col("asks").alias("asks")))
    every = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), (p == part).alias("indexed"), F.col("asks").alias("asks"))
    )
    placed = marked.withColumn("p", F.explode(F.when(F.col("parts").isNotNull() & F.col("asks"), every).otherwise(one)))
    block = F.when(F.col("parts").isNull(), F.pmod("key", F.lit(blocks))).otherwise(F.xxhash64("key", "p.part"))
    return placed.select(block.alias("block"), "side", F.col("p.indexed").alias("indexed"), F.col("p.asks").alias("asks"), "word", "n")


def _pairs(table: pa.Table) -> pa.Table:
    """(word, other, n): the near words within a block, in both directions."""
    words = table.column("word").to_pylist()
    side = int(table.column("side")[0].as_py())
    indexed, asks = (np.array(table.column(c).to_pylist(), bool) for c in ("indexed", "asks"))
    numbers = dict(zip(words, table.column("n").to_pylist(), strict=True))
    distinct = sorted(numbers)
    number = {w: k for k, w in enumerate(distinct)}
    at = np.array([number[w] for w in words], np.int64)
    is_indexed = np.zeros(len(distinct), bool)
    is_indexed[at[indexed]] = True
    found = Vocabulary(distinct)
    a, b = found.near(np.unique(at[asks]), side)
    ok = is_indexed[b]  # words that only ask stand in the text for their code points
    a, b = a[ok], b[ok]
    longer = np.array([len(distinct[y]) > len(distinct[x]) for x, y in zip(a, b, strict=True)], bool)
    a, b = np.concatenate([a, b[longer]]), np.concatenate([b, a[longer]])
    n = np.array([numbers[w] for w in distinct], np.int64)
    return pa.table({"word": pa.array([distinct[k] for k in a], pa.string()), "other": pa.array([distinct[k] for k in b], pa.string()), "n": n[b]})


def near_words(words: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """(word, other, n): for every row (word, n), the other words that one insertion, deletion or replacement away.

    Words are distinct and have two code points or more.
    """
    dealt = _dealt(words, block_rows)
    return dealt.groupBy("block", "side").applyInArrow(_pairs, "word string, other string, n long")


def variant_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_length: int = 6,
    least_count: int = 5,
    times: int = 5,
    edit_every: int | None = None,
    block_rows: int = BLOCK,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every frequent word of all texts.

    Words are maximal runs of ASCII and Latin-1 letters (U+00C0 to U+00FF), in
    lower case (A-Z only), with ``least_length`` code points or more, that
    occur ``least_count`` times or more.  Words are near if one inserted,
    deleted or replaced code point makes one of the other.  ``form`` is the
    near word of largest ``n``, of equal ones the smallest in code-point
    order, if it occurs at least ``times`` as often; ``root`` is where forms
    end.  With ``edit_every`` a run whose crc32, with the document's id before
    it, is divisible by the number loses one code point first.

    Null and empty texts have no words, rows that repeat an id count again, and
    runs of rows without an id are never edited.  Texts and words of any length
    are taken whole; an empty table gives an empty table.  Other columns are
    ignored.
    """
    counted = occurrences(docs, id_col, text_col, least_length, edit_every).where(F.col("n") >= least_count)
    words = stored(counted, "words")
    pairs = near_words(words, block_rows)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    form_n = -F.col("best.less")
    is_form = F.coalesce(form_n >= times * F.col("n"), F.lit(False))
    forms = stored(
        words.join(best, "word", "left").select(
            "word",
            F.when(is_form, F.col("best.other")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, form_n).alias("form_n"),
        ),
        "forms",
    )
    # A form occurs several times as often as its word, so chains end; every round doubles what is followed.
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("top"))
        further = stored(roots.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        roots = further.select("word", "root")
        if not further.where("moved").limit(1).count():
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
