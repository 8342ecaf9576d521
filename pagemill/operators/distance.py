"""Edit distances of many pairs at once, by furthest points on diagonals.

After e edits, a diagonal's furthest point follows from its own and its two
neighbours' after e - 1, and then runs along equal characters, eight bytes at a
time.  A pair takes work in the square of its distance, not of its length, and
the result is exact.  Pairs of like length are worked on together.
"""

from __future__ import annotations

import numpy as np

NOWHERE = -(1 << 40)
#: Diagonals that are held at once, at most, but for one pair.
CELLS = 1 << 20


def _packed(texts: list[list[str]]) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], int]:
    """For each list: its characters, these as overlapping words of eight bytes, and where each text starts; characters in a word."""
    width, code, most = 1, "latin-1", 0xFD
    if not all(t.isascii() for ts in texts for t in ts):
        high = max(ord(max(t)) for ts in texts for t in ts if t)
        width, code = (1, "latin-1") if high <= most else (2, "utf-16-le") if high <= 0xFFFD else (4, "utf-32-le")
    chars, words, starts = [], [], []
    for ts, last in zip(texts, (b"\xff", b"\xfe")):
        # ends that equal no character, nor each other, stop every run
        end = (last + b"\xff" * (width - 1)) * (8 // width)
        raw = end.join([*(t.encode(code) for t in ts), b""])
        chars.append(np.frombuffer(raw, f"<u{width}"))
        words.append(np.ndarray((len(raw) // width - 8 // width + 1,), "<u8", raw, strides=(width,)))
        starts.append(np.cumsum([0, *(len(t) + 8 // width for t in ts[:-1])], dtype=np.int64))
    return chars, words, starts, 8 // width


def _together(a: list[str], b: list[str]) -> np.ndarray:
    (first, second), (left, right), (at, bt), per = _packed([a, b])
    m, n = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    out, rows = np.zeros(len(a), np.int64), np.arange(len(a))

    def run(x: np.ndarray, ks: np.ndarray) -> None:
        # most points stand before unequal characters, and stay
        p, q = (x + at[:, None]).ravel(), (x + (bt[:, None] + ks)).ravel()
        on = np.flatnonzero(first.take(p, mode="clip") == second.take(q, mode="clip"))
        flat = x.reshape(-1)
        on = on[flat[on] >= np.maximum(0, -ks)[on % len(ks)]]
        p, q = p[on], q[on]
        while len(on):
            differ = left[p] ^ right[q]
            same = np.bitwise_count((differ - np.uint64(1)) & ~differ).astype(np.int64) * per >> 6
            flat[on] += same
            more = np.flatnonzero(same == per)
            on, p, q = on[more], p[more] + per, q[more] + per

    far, e = np.zeros((len(a), 1), np.int64), 0
    run(far, np.zeros(1, np.int64))
    while True:
        last = n - m
        ended = (np.abs(last) <= e) & (far[np.arange(len(far)), np.clip(last + e, 0, 2 * e)] >= m)
        if ended.any():
            out[rows[ended]] = e
            far, rows, at, bt, m, n = (x[~ended] for x in (far, rows, at, bt, m, n))
            if not len(rows):
                return out
        e += 1
        ks = np.arange(-e, e + 1)
        before = np.full((len(far), 2 * e + 3), NOWHERE, np.int64)
        before[:, 2:-2] = far
        far = np.maximum(np.maximum(before[:, 1:-1], before[:, 2:]) + 1, before[:, :-2])
        np.minimum(far, np.minimum(m[:, None], n[:, None] - ks), out=far)
        run(far, ks)


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """The least number of inserted, deleted and replaced characters between a[i] and b[i], for each i."""
    size = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), np.int64, len(a))
    out = np.where([not x or not y for x, y in zip(a, b)], size, 0)
    todo = np.array([i for i in np.argsort(size, kind="stable").tolist() if a[i] and b[i] and a[i] != b[i]], np.int64)
    while len(todo):
        # as many of the longest as fit
        fit = np.flatnonzero(size[todo[-1]] * np.arange(1, len(todo) + 1) <= CELLS)
        todo, now = np.split(todo, [len(todo) - max(1, len(fit))])
        out[now] = _together([a[i] for i in now], [b[i] for i in now])
    return out
