"""BPE encoding and decoding.

Encoding is the backtracking algorithm: one Aho-Corasick pass finds the longest
token that starts at each symbol of a word; the encoder takes them greedily,
accepts a token only if the pair-compatibility test says that the merges of
(previous, token) would leave that pair standing, falls back to the token's
longest proper prefix otherwise, and backs up over dead ends, each marked once.
The result equals the merge procedure's and the time is linear in the word.
Decoding gathers from one byte table with an offset per token id.

Defined results: a null text is read as the empty text (no ids, empty decoded
text); a null key is carried through; rows are independent, so repeated rows and
ties change nothing; other columns of the input are not looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.runtime import ship_package

#: Words whose ids are remembered by one Python worker, twice: the latest and those before.
REMEMBERED_WORDS = 120_000
#: Tokens decoded at once, which bounds the memory for a very long text.
DECODE_BLOCK = 1 << 16
#: White space as the tokenizer's pattern \\s takes it (str.split() would also split at \\x1c-\\x1f).
SPACES = re.compile("[\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROL_SEPARATORS = re.compile("[\x1c-\x1f]")

_codecs: dict[str, WordBpe] = {}


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letters = {b: chr(b) for b in plain}
    for extra, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + extra)
    return [letters[b] for b in range(256)]


class _Remembered(dict):
    """Values made once; beyond `most` keys they become the old ones, of which those asked for again come back."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """A byte-level BPE with word ends, read from a tokenizers JSON file.

    A word is a string of symbols: its bytes as chr(0..255), the last one
    as chr(256 + byte), so that "ends a word" is part of the alphabet.
    Tokens are numbered by merge rank, the alphabet first.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        alphabet = _byte_alphabet()
        symbol = {c: chr(b) for b, c in enumerate(alphabet)} | {c + suffix: chr(256 + b) for b, c in enumerate(alphabet)}
        self.names = [x for x in symbol if x in vocab]
        number = {name: i for i, name in enumerate(self.names)}
        spelled = [symbol[x] for x in self.names]
        self.split = [(i, i) for i in range(len(self.names))]
        self.merged: dict[tuple[int, int], int] = {}
        for left, right in merges:
            a, b = number[left], number[right]
            if (whole := left + right) not in number:
                number[whole] = len(self.names)
                self.names.append(whole)
                spelled.append(spelled[a] + spelled[b])
                self.split.append((a, b))
            self.merged.setdefault((a, b), number[whole])
        self.length = [len(x) for x in spelled]
        self.packed = [vocab[x].to_bytes(4, "little") for x in self.names]
        self.automaton = ahocorasick.Automaton()
        at = {x: i for i, x in enumerate(spelled)}
        for x, i in at.items():
            self.automaton.add_word(x, i)
        self.automaton.make_automaton()
        self.shorter = [next((at[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in at), -1) for x in spelled]
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.compatible = _Remembered(lambda pair: self._stands(*pair), REMEMBERED_WORDS // 2)
        self.words = _Remembered(self._encode_chunk, REMEMBERED_WORDS)
        # offset table: every token's text and the space that joins tokens
        names = {**{i: x for x, i in vocab.items()}, **{i: x for x, i in self.special.items()}}
        pieces = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.piece_length = np.array([len(x) for x in pieces], np.int64)
        self.piece_offset = np.concatenate([[0], np.cumsum(self.piece_length)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def _stands(self, a: int, b: int) -> bool:
        """Whether merging the symbols of a and b ends in exactly the tokens (a, b).

        Unmakes the later of the two tokens again and again; the pair falls
        if some merge across the border has an earlier turn than the merge
        that made one of its sides (for equal rank the left one goes first).
        """
        base = len(self.names)
        before = base
        while True:
            across = self.merged.get((a, b))
            if across is not None and across < before:
                return False
            left, right = self.split[a], self.split[b]
            if a > b and left[1] != a:
                before, a = a, left[1]
            elif right[0] != b:
                before, b = b + 1, right[0]
            elif left[1] != a:
                before, a = a, left[1]
            else:
                return True

    def encode_symbols(self, text: str) -> list[int]:
        """Tokens (by rank number) of one word given as symbols."""
        n = len(text)
        longest = [0] * n
        length, shorter, compatible = self.length, self.shorter, self.compatible
        for end, token in self.automaton.iter(text):
            longest[end + 1 - length[token]] = token  # later ends are longer
        token = longest[0]
        if length[token] == n:
            return [token]
        alive = [True] * (n + 1)
        out: list[int] = []
        last, at = -1, 0
        while True:
            end = at + length[token]
            if alive[end] and (last < 0 or compatible[last, token]):
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, longest[end]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                alive[at] = False
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def _encode_chunk(self, chunk: str) -> bytes:
        """Ids of one white-space-free piece of normalised text, as little-endian 32-bit."""
        if not chunk.isalpha():
            words = self.pattern.findall(chunk)
            if len(words) > 1:
                # a word is remembered apart from the marks that it stands with
                return b"".join([self.words[w] for w in words])
            if not words:
                return b""
        raw = chunk.encode("utf-8")
        packed = self.packed
        return b"".join([packed[t] for t in self.encode_symbols(raw[:-1].decode("latin-1") + chr(256 + raw[-1]))])

    def _encode_plain(self, text: str) -> list[bytes]:
        if text.isascii():
            text = text.lower()
        else:
            # per character, as the tokenizer does: a final capital sigma is not special
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        chunks = SPACES.split(text) if CONTROL_SEPARATORS.search(text) else text.split()
        words = self.words
        return [words[x] for x in chunks]

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, little-endian unsigned 32-bit."""
        if not text:
            return b""
        if self.special_split is None or "<|" not in text:
            return b"".join(self._encode_plain(text))
        out: list[bytes] = []
        for part in self.special_split.split(text):
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
            elif part:
                out += self._encode_plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """Token texts joined by one space (the file names no decoder)."""
        numbers = np.frombuffer(ids, "<u4")
        parts = []
        for at in range(0, len(numbers), DECODE_BLOCK):
            some = numbers[at : at + DECODE_BLOCK]
            size = self.piece_length[some]
            ends = np.cumsum(size)
            where = np.repeat(self.piece_offset[some] - (ends - size), size) + np.arange(ends[-1])
            parts.append(self.piece_bytes[where].tobytes())
        return b"".join(parts)[:-1].decode("utf-8")


def codec(path: str) -> WordBpe:
    """One codec per Python worker and file."""
    if path not in _codecs:
        _codecs[path] = WordBpe(path)
    return _codecs[path]


def _rows(batches: Iterator[pa.RecordBatch], limit: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, limit):
            yield batch.slice(at, limit)


def encode(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids): ids is binary, little-endian unsigned 32-bit numbers."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in _rows(batches):
            ids = [bpe.encode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["key", "n_tokens", "ids"])

    chosen = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "key long, n_tokens long, ids binary").withColumnRenamed("key", key)


def decode(df: DataFrame, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded) from (key, n_tokens, ids)."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in _rows(batches):
            texts = [bpe.decode(x or b"") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.string())], ["key", "n_tokens", "ids", "decoded"])

    chosen = df.select(F.col(key).alias("key"), "n_tokens", "ids")
    return chosen.mapInArrow(run, "key long, n_tokens long, ids binary, decoded string").withColumnRenamed("key", key)


def round_trip(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """encode, then decode, in one pass: (key, n_tokens, ids, decoded). One Python worker a task holds the tables."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in _rows(batches):
            ids = [bpe.encode(x) for x in batch.column(1).to_pylist()]
            texts = pa.array([bpe.decode(x) for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), texts], ["key", "n_tokens", "ids", "decoded"])

    chosen = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(run, "key long, n_tokens long, ids binary, decoded string").withColumnRenamed("key", key)


def hex_digest(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


def round_trip_digests(df: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode, decode, and reduce ids and decoded text to SHA-256 digests."""
    done = round_trip(df, tokenizer, text, key)
    return done.select(key, "n_tokens", hex_digest("ids").alias("ids_sha256"), hex_digest("decoded").alias("decoded_sha256"))
