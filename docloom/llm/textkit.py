"""Vectorised tokens and hashes over whole texts.

Texts of a batch are laid end to end in one byte buffer, each followed by a
blank, so numpy works on all of them at once. Words are maximal runs without
the six ASCII blanks; A-Z is folded to a-z and nothing else is changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit values."""
    x = np.array(x, dtype=np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
#: An odd base, so that it has an inverse modulo 2**64.
_BASE = 0xD1342543DE82EF95
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for slot, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[slot] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of every text; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together, one text at least."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Tokens:
    """Words of some texts: spans, 64-bit hashes and where each text's words begin."""

    def __init__(self, texts: list[bytes]):
        self.buf = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8) if texts else np.zeros(1, np.uint8) + 32
        blank = _BLANK[self.buf]
        edge = np.flatnonzero(np.diff(blank.view(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
        self.text_start = np.concatenate([np.zeros(1, np.int64), ends])[: len(texts)]
        self.first = np.searchsorted(self.start, np.concatenate([[0], ends]))  # text i has words first[i]:first[i+1]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each case-folded word."""
        power, inverse = _powers(len(self.buf) + 1)
        total = np.zeros(len(self.buf) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[_FOLD[self.buf]] * power[: len(self.buf)], out=total[1:])
        value = (total[self.end] - total[self.start]) * inverse[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64) * _MULT)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles.

    A text with fewer words has one shingle, its whole sequence; one without
    words has none.
    """
    out: list[np.ndarray] = []
    for a, b in chunks(texts):
        tok = Tokens(texts[a:b])
        h = tok.hashes()
        m = len(h) - width + 1
        if m > 0:
            s = np.zeros(m, np.uint64)
            for k in range(width):
                s = mix(s * _MULT + h[k : k + m] + np.uint64(k + 1))
        for i in range(b - a):
            lo, hi = tok.first[i], tok.first[i + 1]
            if hi - lo >= width:
                out.append(np.unique(s[lo : hi - width + 1]))
            elif hi > lo:
                one = np.full(1, hi - lo, np.uint64)
                for x in h[lo:hi]:
                    one = mix(one * _MULT + x + np.uint64(77))
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
    return out
