"""Words of a batch of texts as one coded column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import SPACE, flat

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: True for the bytes of words, where ASCII white space parts them.
DARK = np.ones(256, bool)
DARK[list(SPACE)] = False


def coded_words(texts: pa.Array, dark: np.ndarray = DARK) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words (A-Z lower-cased bytes), and for each word in order its number among them, its text's number and its first byte.

    A word is a maximal run of bytes of which `dark` holds, within one text; null texts have none."""
    buf, offs = flat(texts)
    inside = dark[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offs[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    at = np.append(np.cumsum(inside)[start] - 1, inside.sum()).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(_LOWER[buf[inside]])]).dictionary_encode()
    return words.dictionary, words.indices.to_numpy().astype(np.int64), np.searchsorted(offs, start, "right") - 1, start


def as_text(words: pa.Array) -> pa.Array:
    return words.cast(pa.large_string()).cast(pa.string())
