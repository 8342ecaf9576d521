"""Content-defined cutting of a unit sequence into anchored runs of windows.

A *unit* is a byte or a word (as a 64-bit hash).  A *window* is ``length``
consecutive units.  Every window owns one *anchor*: the ``gram``-unit substring
of smallest hash inside it (leftmost on ties).  Equal windows own equal anchors
at equal offsets, whatever document they stand in, so comparing windows only
with windows of the same anchor loses nothing.  Consecutive windows with the
same anchor form one *run*; runs number about ``2 / (length - gram)`` of the
units, which is what makes exact whole-corpus comparison affordable.

Everything here is numpy over whole arrays: no Python loop over units.
"""

from __future__ import annotations

import numpy as np

MULT = np.uint64(0x9E3779B97F4A7C15)
MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOW32 = np.uint64(0xFFFFFFFF)
HIGH32 = np.uint64(0xFFFFFFFF00000000)
#: Units handled at once; longer sequences are cut into overlapping blocks.
BLOCK = 1 << 20

_powers: dict[str, np.ndarray] = {}


def _power_table(name: str, base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, grown on demand."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 4096)
        with np.errstate(over="ignore"):
            have = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, base, np.uint64)]))
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def prefix_hash(units: np.ndarray) -> np.ndarray:
    """P with P[i] = sum of units[j] * MULT_INV**j for j < i (length n + 1)."""
    out = np.zeros(len(units) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(units * _power_table("inv", MULT_INV, len(units)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of units[start:end] for each pair, independent of where it stands."""
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * _power_table("pow", MULT, len(prefix))[starts])


def gram_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` consecutive units."""
    n = len(prefix) - size
    with np.errstate(over="ignore"):
        return mix((prefix[size:] - prefix[:-size]) * _power_table("pow", MULT, len(prefix))[:n])


def pair_name(names: np.ndarray, offset: int) -> np.ndarray:
    """The name of (names[i], names[i + offset]) for each i that has both."""
    with np.errstate(over="ignore"):
        return mix(names[: len(names) - offset] * MULT + mix(names[offset:]))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive keys, by block prefix and suffix minima."""
    n = len(keys)
    if width == 1:
        return keys.copy()
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = keys
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def runs(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, anchor hash) of each run of one sequence.

    Windows are numbered by their first unit.  Blocks overlap by
    ``length - 1`` units, so a run may be cut at a block's edge; that only
    makes it two runs with the same anchor, at a place that need not agree
    between documents, which costs comparisons but never a match.
    """
    n = len(units) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    parts = [_block(units[at : min(at + BLOCK, n) + length - 1], length, gram, at) for at in range(0, n, BLOCK)]
    if len(parts) == 1:
        return parts[0]
    return tuple(np.concatenate(x) for x in zip(*parts))  # type: ignore[return-value]


def _block(units: np.ndarray, length: int, gram: int, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    hashes = gram_hash(prefix_hash(units), gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    anchors = sliding_min((hashes & HIGH32) | place, length - gram + 1) & LOW32
    first = np.flatnonzero(np.concatenate([np.ones(1, bool), anchors[1:] != anchors[:-1]]))
    count = np.diff(np.append(first, len(anchors)))
    return first + offset, count, hashes[anchors[first].astype(np.int64)]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of text separated by spaces and \\t..\\r."""
    raw = np.frombuffer(data, np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, counts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the n units that lie in a window of the given runs of windows."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts + length - 1, -1)
    return np.cumsum(change[:n]) > 0
