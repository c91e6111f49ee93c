"""Words of a batch of texts and hashed features of each distinct word, in whole-array steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import Rolling, flat, mixed

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def sliced(texts: pa.Array, most: int, overlap: int) -> Iterator[tuple[np.ndarray, pa.Array, bool, bool]]:
    """Row numbers, texts, and whether these begin and end with their rows' texts.

    All texts of up to most words come at once, then longer ones in slices of most + overlap words, most words apart."""
    buf, offs = flat(texts)
    size = np.diff(offs)
    short = size <= 2 * most  # a word takes two bytes, but for the last
    if short.any():
        at = np.flatnonzero(short)
        yield at, texts if short.all() else texts.take(pa.array(at)), True, True
    for row in np.flatnonzero(~short).tolist():
        lower, _ = flat(pc.utf8_lower(texts.slice(row, 1)))
        begin, end = _bounds(lower, np.array([0, len(lower)]))
        for at in range(0, max(1, len(begin) - overlap), most):
            last = min(len(begin), at + most + overlap)
            part = lower[begin[at] : end[last - 1]] if len(begin) else lower[:0]
            yield np.array([row]), pa.array([part.tobytes()], pa.binary()).cast(pa.string()), at == 0, last == len(begin)


def _bounds(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word."""
    inside = _TOKEN[buf]
    first, last = inside.copy(), inside.copy()
    if len(buf):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(buf))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Words:
    """Words are runs of ASCII letters and digits and of non-ASCII code points, lower-cased.

    row, letter: of each word its text's number and whether it has a letter; inverse: its distinct
    word; hashes, and the features below: of each distinct word."""

    def __init__(self, texts: pa.Array | list):
        column = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.string())
        buf, offs = flat(pc.utf8_lower(column))
        start, end = _bounds(buf, offs)
        self.rows = len(offs) - 1
        self.row = np.searchsorted(offs, start, "right") - 1
        self.hashes, at, self.inverse = np.unique(
            Rolling(buf, 5).of(start, end) if len(start) else np.zeros(0, np.uint64), return_index=True, return_inverse=True
        )
        self.buf, self.start, self.length = buf, start[at], (end - start)[at]
        letters = np.concatenate([[0], np.cumsum(_LETTER[buf])])
        self.letter = letters[end] > letters[start]

    def stems(self, most: int) -> np.ndarray:
        """Hashes of the first `most` bytes of each distinct word."""
        if not len(self.length):
            return np.zeros(0, np.uint64)
        return Rolling(self.buf, 6).of(self.start, self.start + np.minimum(self.length, most))

    def __len__(self) -> int:
        return len(self.inverse)

    def trigrams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashed byte trigrams of ^word$ for all distinct words, and the offset of each word's first."""
        n = self.length
        offs = np.concatenate([[0], np.cumsum(n)])
        if not len(n):
            return np.zeros(0, np.int64), offs[:-1]
        inner = np.arange(offs[-1]) - np.repeat(offs[:-1], n)
        at = np.repeat(self.start, n) + inner
        mid = self.buf[at].astype(np.uint64)
        left = np.where(inner == 0, 2, self.buf[np.maximum(at - 1, 0)]).astype(np.uint64)
        right = np.where(inner == np.repeat(n, n) - 1, 3, self.buf[np.minimum(at + 1, len(self.buf) - 1)]).astype(np.uint64)
        return (mixed(left << np.uint64(16) | mid << np.uint64(8) | right) % np.uint64(size)).astype(np.int64), offs[:-1]

    def affixes(self, size: int, longest: int = 4) -> np.ndarray:
        """Hashed prefixes and suffixes of 1 to `longest` bytes: (distinct words, 2 * longest)."""
        out = []
        for side in (0, 1):
            code = np.full(len(self.length), 7 + side, np.uint64)
            for k in range(longest):
                at = self.start + k if side == 0 else self.start + self.length - 1 - k
                inside = k < self.length
                byte = self.buf[np.clip(at, 0, max(0, len(self.buf) - 1))].astype(np.uint64) if len(self.buf) else np.zeros(0, np.uint64)
                code = code * np.uint64(257) + np.where(inside, byte + np.uint64(1), np.uint64(0))
                out.append((mixed(code + np.uint64(1 << 40) * np.uint64(k + 1)) % np.uint64(size)).astype(np.int64))
        return np.stack(out, 1) if out else np.zeros((0, 0), np.int64)


def chains(row: np.ndarray, rows: int, width: int, stride: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of `width` words over each row's words: first word, length and row.

    With stride == width (the default) every word is in one window; a smaller stride overlaps. A row without words has none."""
    stride = stride or width
    n = np.bincount(row, minlength=rows)
    begin = np.concatenate([[0], np.cumsum(n)[:-1]]) if rows else np.zeros(0, np.int64)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -(-(n - width) // stride)))
    of = np.repeat(np.arange(rows), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = begin[of] + nth * stride
    return first, np.minimum(width, begin[of] + n[of] - first), of
