"""Word-piece counts with a longest-match automaton: linear time, no pieces built.

The vocabulary is a trie. A node's failure link leads to the node of what is
left of its string after the greedy pieces at its front are taken off, and
``popped`` is how many pieces that takes (both computed once, breadth first).
Reading a word follows an edge, or fails and adds the popped count, so the
length of the greedy longest-match split comes without the pieces themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Splits lower-cased text into words (fixed by the vocabulary file's own pre-tokeniser).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
COUNTS = "n_words bigint, n_pieces bigint, n_unknown bigint"


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of bytes in byte-level vocabularies: printable Latin-1 stays, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Automaton:
    """Greedy longest-match over ``pieces``, sequences of symbols."""

    def __init__(self, pieces: Iterable[tuple]):
        self.edge: dict[tuple[int, object], int] = {}
        parent, label, final, depth = [0], [None], [False], [0]
        for piece in pieces:
            node = 0
            for symbol in piece:
                step = self.edge.get((node, symbol))
                if step is None:
                    step = self.edge[node, symbol] = len(parent)
                    parent.append(node)
                    label.append(symbol)
                    final.append(False)
                    depth.append(depth[node] + 1)
                node = step
            if node:
                final[node] = True
        # fail[v]: -1 if no piece starts v's string
        self.fail, self.popped, self.final = [-1] * len(parent), [0] * len(parent), final
        for v in sorted(range(1, len(parent)), key=depth.__getitem__):
            if final[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            at, count, symbol = self.fail[parent[v]], self.popped[parent[v]], label[v]
            while at >= 0:
                step = self.edge.get((at, symbol))
                if step is not None:
                    self.fail[v], self.popped[v] = step, count
                    break
                count += self.popped[at]
                at = self.fail[at]

    def count(self, symbols: Iterable) -> int:
        """The number of greedy pieces; -1 if some rest starts with no piece."""
        edge, fail, popped = self.edge, self.fail, self.popped
        node = total = 0
        for symbol in symbols:
            while (step := edge.get((node, symbol))) is None:
                if fail[node] < 0:
                    return -1
                total += popped[node]
                node = fail[node]
            node = step
        while node:
            if fail[node] < 0:
                return -1
            total += popped[node]
            node = fail[node]
        return total


def read_vocabulary(path: str) -> bytes:
    """The vocabulary file's bytes, read on the driver; its size is that of a vocabulary, not of the data."""
    with open(path, "rb") as f:
        return f.read()


def word_symbols(word: bytes) -> tuple[int, ...]:
    """A word's bytes; its last byte is a symbol of its own (plus 256), as the vocabulary writes it with ``</w>``."""
    return (*word[:-1], word[-1] + 256)


@lru_cache(maxsize=2)
def automaton(vocabulary: bytes) -> Automaton:
    """The automaton of a tokenizers-library JSON file whose word-final pieces end in ``</w>``."""
    back = {c: b for b, c in _byte_letters().items()}
    pieces = []
    for piece in json.loads(vocabulary)["model"]["vocab"]:
        closed = piece.endswith(WORD_END)
        body = piece[: -len(WORD_END)] if closed else piece
        if all(c in back for c in body):
            pieces.append(word_symbols(bytes(back[c] for c in body)) if closed and body else tuple(back[c] for c in body))
    return Automaton(pieces)


class WordCounts(dict):
    """word -> pieces, filled as words come and emptied when it holds ``most`` words."""

    def __init__(self, machine: Automaton, most: int = 500_000):
        super().__init__()
        self.machine, self.most = machine, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = self.machine.count(word_symbols(word.encode("utf-8", "surrogatepass")))
        return n


@lru_cache(maxsize=2)
def _counts(vocabulary: bytes) -> tuple[WordCounts, regex.Pattern]:
    return WordCounts(automaton(vocabulary)), regex.compile(WORDS)


def count_pieces(text: str | None, counts: WordCounts, words: regex.Pattern) -> tuple[int, int, int]:
    """(words, pieces, words that the vocabulary can't split, each counted as one piece)."""
    found = words.findall((text or "").lower())
    pieces = list(map(counts.__getitem__, found))
    unknown = pieces.count(-1)
    return len(found), sum(pieces) + 2 * unknown, unknown


def token_counts(spark: SparkSession, docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_words, n_pieces, n_unknown of the whole text.

    A map without a shuffle; the vocabulary file is broadcast. Null and empty
    texts and texts of white space have 0 words and pieces. A null key stays
    null, repeated rows stay repeated, an empty table gives no rows, other
    columns are left out.
    """
    held = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = _counts(held.value)
        for batch in batches:
            rows = [count_pieces(t.as_py(), counts, words) for t in batch.column("text")]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.int64()) for c in columns)], names=[key, "n_words", "n_pieces", "n_unknown"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, {COUNTS}")
