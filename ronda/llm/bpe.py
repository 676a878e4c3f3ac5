"""BPE encoding by a trie of words that share the encodings of their prefixes.

The distinct words of a batch are inserted into a trie, which is then walked
depth first.  A node's state is the last token of the encoding of its prefix:
the one token that ends there and may stand behind the state of the node where
it begins.  Two tokens may stand side by side if no merge crosses their
boundary while both are built.  A prefix is thus encoded once for all words
that share it, and a word's ids are read off the states on its path.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, pre_tokenizers

from ronda.llm.packing import byte_symbols

# How the tokenizer cuts a text into words, and its mark of a word's end.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
WORD_END = "</w>"

PART = 500  # texts whose words share a trie
KEPT_WORDS = 600_000  # encodings a task keeps from one trie to the next; more are worked out again
KEPT_PAIRS = 600_000  # and pairs of tokens


class Vocabulary:
    """Tokens, merges and their order, from a tokenizer file.

    Bytes are characters of code 0 to 255 here; a token that ends a word is
    kept apart from the one of the same bytes that does not.
    """

    def __init__(self, definition: str):
        told = json.loads(definition)
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        symbols = byte_symbols()
        plain = str.maketrans({c: chr(b) for c, b in symbols.items()})
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        vocabulary = told["model"]["vocab"]
        self.names = [""] * (1 + max(*vocabulary.values(), *self.special.values()))
        for token, i in {**vocabulary, **self.special}.items():
            self.names[i] = token
            if token in self.special:
                continue
            if token.endswith(WORD_END):
                self.final[token.removesuffix(WORD_END).translate(plain)] = i
            else:
                self.inner[token.translate(plain)] = i
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(told["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = vocabulary[left], vocabulary[right]
            self.rank[pair] = rank
            self.parts[vocabulary[left + right]] = pair
        self._beside: dict[tuple[int, int], bool] = {}
        self._alone: dict[int, bool] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one edge of a token while it is built, first to last, with the time each is merged."""
        chain, ends = [token], [float("inf")]
        while chain[-1] in self.parts:
            pair = self.parts[chain[-1]]
            ends.append(self.rank[pair])
            chain.append(pair[side])
        return list(zip(chain[::-1], ends[::-1], strict=True))

    def beside(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' text is these two tokens."""
        known = self._beside.get((left, right))
        if known is None:
            if len(self._beside) > KEPT_PAIRS:
                self._beside.clear()
            known = self._beside[left, right] = self._uncrossed(left, right)
        return known

    def _uncrossed(self, left: int, right: int) -> bool:
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            merge = self.rank.get((a[i][0], b[j][0]))
            # Of equal merges the leftmost comes first: one inside the left token, but not inside the right one.
            if merge is not None and merge < a[i][1] and merge <= b[j][1]:
                return False
            if a[i][1] == b[j][1] == float("inf"):
                return True
            if a[i][1] <= b[j][1]:
                i += 1
            else:
                j += 1

    def alone(self, token: int) -> bool:
        """Whether the encoding of the token's text is the token; if not, no encoding holds it."""
        known = self._alone.get(token)
        if known is None:
            pair = self.parts.get(token)
            known = pair is None or (self.alone(pair[0]) and self.alone(pair[1]) and self._joins(*pair))
            self._alone[token] = known
        return known

    def _joins(self, left: int, right: int) -> bool:
        """Whether no earlier merge crosses the boundary before these two are merged."""
        at = self.rank[left, right]
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            merge = self.rank.get((a[i][0], b[j][0]))
            if merge is not None and merge < at and merge < a[i][1] and merge <= b[j][1]:
                return False
            if a[i][1] == b[j][1] == float("inf"):
                return True
            if a[i][1] <= b[j][1]:
                i += 1
            else:
                j += 1

    @cached_property
    def lengths(self) -> list[int]:
        """Characters of each token."""
        out = [0] * len(self.names)
        for table in (self.inner, self.final):
            for token, i in table.items():
                out[i] = len(token)
        return out

    @cached_property
    def reach(self) -> tuple[dict[str, int], dict[str, int]]:
        """Longest token, inside a word and at its end, that ends with each three characters."""
        out: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for table, longest in zip((self.inner, self.final), out, strict=True):
            for token in table:
                if len(token) > 2:
                    longest[token[-3:]] = max(len(token), longest.get(token[-3:], 0))
        return out

    def _state(self, prefix: str, states: list[int], final: bool) -> int:
        """The last token of the encoding of ``prefix``, given those of all shorter prefixes."""
        table, end = (self.final if final else self.inner), len(prefix)
        begin = max(0, end - self.reach[final].get(prefix[-3:], 2))
        while begin < end:
            token = table.get(prefix[begin:])
            if token is not None and self.alone(token) and (begin == 0 or self.beside(states[begin], token)):
                return token
            begin += 1
        raise ValueError("the vocabulary lacks a byte")

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each distinct word."""
        trie: dict = {}
        for word in words:
            node = trie
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word
        out: dict[str, list[int]] = {}
        states = [-1]  # of the prefixes on the path, shortest first
        todo: list[tuple[int, str, dict]] = [(1, c, child) for c, child in trie.items()]
        path = ""
        while todo:
            depth, c, node = todo.pop()
            parent = path[: depth - 1]
            path = parent + c
            del states[depth:]
            word = node.get("")
            if word is not None:
                ids, end, token = [], depth, self._state(path, states, True)
                while True:
                    ids.append(token)
                    end -= self.lengths[token]
                    if not end:
                        break
                    token = states[end]
                out[word] = ids[::-1]
            if len(node) > (word is not None):
                states.append(self._state(path, states, False))
                todo.extend((depth + 1, k, child) for k, child in node.items() if k)
        return out


def normalised(text: str) -> str:
    """NFC, then the lower case of each character by itself."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # a capital sigma at a word's end is no case of its own here
            text = text.replace("Σ", "σ")
    return text.lower()


@cache
def _doubtful() -> re.Pattern:
    """Code points above U+FFFF, and those below that Python's Unicode tables leave unassigned."""
    free = [c for c in range(0x10000) if unicodedata.category(chr(c)) == "Cn"]
    return re.compile("[" + "".join(f"\\u{c:04x}" for c in free) + "\\U00010000-\\U0010ffff]")


def has_unassigned(text: str) -> bool:
    """Whether a text holds a code point that Python's Unicode tables leave unassigned.

    On all others they, the ``regex`` module and the tokenizer's library agree
    about letters, digits, blanks, cases and compositions.
    """
    if text.isascii() or _doubtful().search(text) is None:
        return False
    return any(unicodedata.category(c) == "Cn" for c in set(text))


class Encoder:
    """Encodes texts; keeps the words of earlier tries up to a bound."""

    def __init__(self, definition: str):
        self.definition = definition
        self.vocabulary = Vocabulary(definition)
        self.words = regex.compile(WORDS)
        special = self.vocabulary.special
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # place of each word in the next two
        self.starts, self.ids = array("q", [0]), array("i")

    @cached_property
    def library(self) -> tuple:
        """The library's normalizer and its cutter by the same pattern."""
        return Tokenizer.from_str(self.definition).normalizer, pre_tokenizers.Split(Regex(WORDS), "removed", invert=True)

    def _words(self, text: str) -> list[str]:
        """Words of a text without special tokens.

        Where it holds a code point that tables of one Unicode version know and
        those of another do not, the library cuts it.
        """
        if not has_unassigned(text):
            return self.words.findall(normalised(text))
        normalizer, cutter = self.library
        return [word for word, _ in cutter.pre_tokenize_str(normalizer.normalize_str(text))]

    def _cut(self, text: str) -> list[str]:
        """Words of a text; a special token is a word after a blank, which no other word has."""
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return self._words(text)
        out: list[str] = []
        for k, piece in enumerate(self.special.split(text)):
            out.extend([" " + piece] if k % 2 else self._words(piece))
        return out

    def _learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self._forget()
            fresh = list(words)
        raw = {w: w if w.isascii() else w.encode().decode("latin-1") for w in fresh if w[0] != " "}
        found = self.vocabulary.encode_words(list(raw.values()))
        for word in fresh:
            self.known[word] = len(self.known)
            self.ids.extend(found[raw[word]] if word in raw else [self.vocabulary.special[word[1:]]])
            self.starts.append(len(self.ids))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        cut = [self._cut(t) for t in texts]
        flat = [w for words in cut for w in words]
        self._learn(set(flat))
        word = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        table, starts = np.frombuffer(self.ids, np.int32), np.frombuffer(self.starts, np.int64)  # no copies
        per_word = starts[word + 1] - starts[word]
        ends = np.cumsum(per_word)
        ids = table[np.arange(per_word.sum()) + np.repeat(starts[word] - (ends - per_word), per_word)]
        of_words = np.cumsum([0, *(len(w) for w in cut)])
        return ids, np.diff(np.append(0, ends)[of_words])


_encoders: dict[str, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """One encoder for all tasks of a Python worker, so that they share its words."""
    if definition not in _encoders:
        _encoders.clear()
        _encoders[definition] = Encoder(definition)
    return _encoders[definition]


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) per row; a null text is an empty one, an empty text has no ids.

    Rows stand for themselves: repeated or null ids are kept, other columns are
    ignored; an empty table gives no rows.  Special tokens written out in a text
    become their ids.  A text is held whole by its task, with its words.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(definition.value)
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                ids, counts = coder.encode([t or "" for t in part.column(1).to_pylist()])
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def _written(names: pa.Array, ids: pa.Array, counts: np.ndarray) -> pa.Array:
    """Texts of ids laid end to end, ``counts`` of them each: the tokens joined by blanks."""
    offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(ids)), " ")


def decoded(rows: DataFrame, tokenizer: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col``: its tokens joined by blanks, as a tokenizer without decoder does.

    No ids, or null, are an empty text; an id outside the vocabulary is an error.
    """
    with open(tokenizer, encoding="utf-8") as f:
        definition = rows.sparkSession.sparkContext.broadcast(f.read())
    columns = rows.columns
    at = columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(_encoder(definition.value).vocabulary.names, pa.string())
        for batch in batches:
            for k in range(0, batch.num_rows, PART):
                part = batch.slice(k, PART)
                ids = part.column(at)
                counts = pc.list_value_length(ids).fill_null(0).to_numpy()
                yield pa.RecordBatch.from_arrays([*part.columns, _written(names, ids.flatten(), counts)], [*columns, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{schema}, `{into}` string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) per row: ``encoded`` and ``decoded`` in one pass of one worker."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(definition.value)
        names = pa.array(coder.vocabulary.names, pa.string())
        for batch in batches:
            for at in range(0, batch.num_rows, PART):
                part = batch.slice(at, PART)
                ids, counts = coder.encode([t or "" for t in part.column(1).to_pylist()])
                flat = pa.array(ids)
                offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(offsets, flat), _written(names, flat, counts)],
                    ["id", "ids", "decoded"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256)."""
    written = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return round_trip(docs, tokenizer, id_col, text_col).select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(written.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
