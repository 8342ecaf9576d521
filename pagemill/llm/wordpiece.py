"""Greedy word-piece counts by one linear pass of a longest-match automaton.

The vocabulary is a trie: pieces that begin a word below one root, pieces that
go on below another.  For each node, `fail` is where matching goes on once no
further unit fits, and `popped` is how many pieces the text up to there makes;
both are computed once, in breadth-first order.  Counting a word then needs one
step per byte and no list of pieces.

Words are runs of bytes other than space and \\t..\\r.  A word that can't be
spelled counts as one unknown piece.

Defined results: a null or empty text has no words and no pieces; a null key is
carried; repeated rows give repeated results; only key and text are read.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.bpe import _byte_alphabet, _Remembered
from pagemill.runtime import ship_package

REMEMBERED_WORDS = 150_000
NOWHERE = -1

_counters: dict[str, PieceCounter] = {}


class PieceCounter:
    """initial and inner pieces as bytes; inner ones are those that go on within a word."""

    def __init__(self, initial: Iterable[bytes], inner: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}, {}]
        self.piece = bytearray(2)
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                at = root
                for unit in piece:
                    after = self.next[at].get(unit)
                    if after is None:
                        after = self.next[at][unit] = len(self.next)
                        self.next.append({})
                        self.piece.append(0)
                    at = after
                if piece:
                    self.piece[at] = 1
        self.fail = [NOWHERE] * len(self.next)
        self.popped = [0] * len(self.next)
        self._link()
        self.words = _Remembered(self.count, REMEMBERED_WORDS)

    def _link(self) -> None:
        waiting = deque((root, unit, node) for root in (0, 1) for unit, node in self.next[root].items())
        while waiting:
            parent, unit, node = waiting.popleft()
            if self.piece[node]:
                self.fail[node], self.popped[node] = 1, 1
            else:
                at, made = self.fail[parent], self.popped[parent]
                while at != NOWHERE and unit not in self.next[at]:
                    made += self.popped[at]
                    at = self.fail[at]
                if at != NOWHERE:
                    self.fail[node], self.popped[node] = self.next[at][unit], made
            waiting.extend((node, u, n) for u, n in self.next[node].items())

    def count(self, word: bytes) -> int:
        step, fail, popped = self.next, self.fail, self.popped
        at = made = 0
        for unit in word:
            while (after := step[at].get(unit)) is None:
                made += popped[at]
                at = fail[at]
                if at == NOWHERE:
                    return 1
            at = after
        while at > 1:
            made += popped[at]
            at = fail[at]
            if at == NOWHERE:
                return 1
        return made

    def count_text(self, text: str | None) -> tuple[int, int]:
        words = (text or "").encode("utf-8").split()
        return len(words), sum(map(self.words.__getitem__, words))


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """(initial, inner) of a byte-level vocabulary: a piece with a leading space begins a word."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    value = {c: b for b, c in enumerate(_byte_alphabet())}
    pieces = [bytes(value[c] for c in x) for x in vocab if all(c in value for c in x)]
    return [x[1:] for x in pieces if x[:1] == b" "], [x for x in pieces if x[:1] != b" "]


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        initial, inner = byte_level_pieces(path)
        # a word whose first byte begins no initial piece starts with the byte itself
        begun = {x[0] for x in initial if x}
        _counters[path] = PieceCounter([*initial, *(x for x in inner if len(x) == 1 and x[0] not in begun)], inner)
    return _counters[path]


def token_counts(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_pieces)."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [pieces.count_text(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["key", "n_words", "n_pieces"])

    chosen = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "key long, n_words long, n_pieces long").withColumnRenamed("key", key)
